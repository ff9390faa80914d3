"""Encoding of a whole corpus with a public tokenizer, each distinct word once.

A byte-level BPE without special tokens splits a text into pre-tokens and merges inside each alone, so the ids of a
text are the ids of its pre-tokens in order. The corpus is cut into chunks of bounded size, one row each: the distinct
words of the chunk and, for each document, the positions of its pre-tokens as numbers into them. Only (chunk, number,
word) rows are exploded and shuffled; each distinct word of the corpus is encoded once, its ids are joined back to the
chunks, and each chunk reassembles its documents by position. A common word thus moves once a chunk, not once an
occurrence. In a corpus of very many chunks a common word still has a row in each: the join back has one row a word on
its other side, so adaptive execution splits such a word's partition without multiplying anything.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweir.session import materialise

#: Bounds of a chunk: characters of text and documents.
CHUNK_CHARS, CHUNK_DOCS = 8_000_000, 8_192

_CHUNK = "chunk string, words array<string>, doc_ids array<long>, carried array<string>, lengths array<int>, positions array<int>"


def tokenizer_folder() -> str:
    import public_tokenizers

    return public_tokenizers.path("")


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _chunks(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        split = regex.compile(pattern).findall
        part, number = TaskContext.get().partitionId(), 0
        known: dict[str, int] = {}
        ids: list[int] = []
        carried: list[str | None] = []
        lengths: list[int] = []
        positions: list[np.ndarray] = []
        chars = 0

        def out():
            nonlocal number, known, ids, carried, lengths, positions, chars
            flat = np.concatenate(positions) if positions else np.zeros(0, np.int32)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{number}"]),
                    pa.array([list(known)], pa.list_(pa.string())),
                    pa.ListArray.from_arrays([0, len(ids)], pa.array(ids, pa.int64())),
                    pa.ListArray.from_arrays([0, len(carried)], pa.array(carried, pa.string())),
                    pa.ListArray.from_arrays([0, len(lengths)], pa.array(lengths, pa.int32())),
                    pa.ListArray.from_arrays([0, len(flat)], pa.array(flat, pa.int32())),
                ],
                names=["chunk", "words", "doc_ids", "carried", "lengths", "positions"],
            )
            number, known, ids, carried, lengths, positions, chars = number + 1, {}, [], [], [], [], 0
            return row

        for batch in batches:
            for doc, more, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "carried", "text")), strict=True):
                pre = split(text) if text else []
                get = known.setdefault
                at = np.fromiter([get(w, len(known)) for w in pre], np.int32, len(pre))
                ids.append(doc)
                carried.append(more)
                lengths.append(len(at))
                positions.append(at)
                chars += len(text or "")
                if chars >= CHUNK_CHARS or len(ids) >= CHUNK_DOCS:
                    yield out()
        if ids:
            yield out()

    return run


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_batch_fast
        for batch in batches:
            ids = [e.ids for e in encode(batch.column("word").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _assemble(count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                numbers = np.asarray(batch.column("n")[i].values)
                word_ids = batch.column("ids")[i].values
                order = np.argsort(numbers, kind="stable")
                starts = np.asarray(word_ids.offsets)[order]
                sizes = np.diff(np.asarray(word_ids.offsets))[order]
                flat = np.asarray(word_ids.values)
                at = np.asarray(batch.column("positions")[i].values)
                lengths = np.asarray(batch.column("lengths")[i].values)
                docs = batch.column("doc_ids")[i].values
                n = sizes[at]
                ends = np.concatenate([[0], np.cumsum(n)])
                bounds = ends[np.concatenate([[0], np.cumsum(lengths)])]
                if count_only:
                    yield pa.RecordBatch.from_arrays([docs, batch.column("carried")[i].values, pa.array(np.diff(bounds), pa.int64())], names=["doc_id", "carried", "n_tokens"])
                    continue
                # the ids of every occurrence, in order: the start of its word plus 0, 1, ...
                index = np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])
                values = pa.array(flat[index], pa.int32())
                step = 2_048
                for k in range(0, len(docs), step):
                    own = bounds[k : k + step + 1]
                    part = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), values.slice(own[0], own[-1] - own[0]))
                    yield pa.RecordBatch.from_arrays([docs.slice(k, step), part], names=["doc_id", "ids"])

    return run


def _encoded(documents: DataFrame, id_column: str, text_column: str, tokenizer_file: str, count_only: bool, carry: Column | None = None) -> DataFrame:
    import public_tokenizers

    carried = F.lit(None) if carry is None else carry
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), carried.cast("string").alias("carried"), F.col(text_column).alias("text"))
    chunks = materialise(rows.mapInArrow(_chunks(public_tokenizers.PATTERN), _CHUNK), "chunks")
    words = chunks.select("chunk", F.posexplode("words").alias("n", "word"))
    coded = words.select("word").distinct().mapInArrow(_encode_words(tokenizer_file), "word string, ids array<int>")
    if count_only:
        # an encoded word as so many empty places: the assembly needs the numbers alone
        coded = coded.select("word", F.transform("ids", lambda _: F.lit(0)).alias("ids"))
    back = words.join(coded, "word").groupBy("chunk").agg(F.collect_list(F.struct("n", "ids")).alias("coded"))
    whole = chunks.drop("words").join(back, "chunk", "left").select("doc_ids", "carried", "lengths", "positions", F.coalesce(F.col("coded.n"), F.array().cast("array<int>")).alias("n"), F.coalesce(F.col("coded.ids"), F.array().cast("array<array<int>>")).alias("ids"))
    return whole.mapInArrow(_assemble(count_only), "doc_id long, carried string, n_tokens long" if count_only else "doc_id long, ids array<int>")


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer_file: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row. Null and empty texts have the empty list; repeated rows stay repeated.

    tokenizer_file: a byte-level BPE in the tokenizers library's format; byte_bpe_50k.json of public_tokenizers by default.
    """
    return _encoded(documents, id_column, text_column, tokenizer_file or tokenizer_folder() + "byte_bpe_50k.json", False)


def count_tokens(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer_file: str | None = None, carry: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row, by the same way as encode_corpus; null and empty texts have 0.

    carry: a string column that comes out with the counts, so that they need not be joined back.
    """
    counted = _encoded(documents, id_column, text_column, tokenizer_file or tokenizer_folder() + "byte_bpe_50k.json", True, None if carry is None else F.col(carry))
    return counted.select("doc_id", "n_tokens") if carry is None else counted.select("doc_id", F.col("carried").alias(carry), "n_tokens")


@functools.lru_cache(maxsize=2)
def token_bytes(path: str | None = None) -> pa.BinaryArray:
    """The token-byte table of a rank file in tiktoken's format: the bytes of id k at place k, null for ids it leaves out."""
    path = path or tokenizer_folder() + "byte_bpe_50k.tiktoken"
    with open(path, "rb") as f:
        table = {int(i): base64.b64decode(b) for b, i in map(bytes.split, f)}
    return pa.array([table.get(i) for i in range(max(table) + 1)], pa.binary())


def decode_corpus(encoded: DataFrame, rank_file: str | None = None) -> DataFrame:
    """encoded(doc_id, ids) -> (doc_id, text): the ids of a batch joined with the token-byte table at once, by position.

    The table has as many rows as the vocabulary (50,256), a bound that does not grow with the corpus, so it is on the
    build side in each task; the gathered bytes lie in the order of the positions, so a text is a slice of them. Null
    lists and ids outside the table give null text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(rank_file)
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten()
            inside = pa.compute.and_(pa.compute.greater_equal(flat, 0), pa.compute.less(flat, len(table)))
            joined = table.take(pa.compute.if_else(inside, flat, None))
            lost = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.is_null(joined)))])
            # where each token's bytes begin in the buffer of all
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(joined), 0))
            at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            data = bytes(joined.buffers()[2] or b"")
            n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
            bounds = np.concatenate([[0], np.cumsum(n)])
            none = np.asarray(pa.compute.is_null(lists))
            texts = [None if none[k] or lost[b] > lost[a] else data[at[a] : at[b]].decode("utf-8", "replace") for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
