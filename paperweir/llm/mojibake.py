"""Text decoded with a wrong encoding: find it and restore it where it can be.

A chain says with what encoding text was read and what it was really written in. Words with other than ASCII letters
are collected once for the whole corpus; for each distinct word every chain that decodes it is tried, also chains of
chains, and the word that compresses best with a zstandard dictionary of one language, the cost of the chain included,
is taken: minimum description length. The word as it stands costs no chain, so it stays unless another saves bytes.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweir.session import materialise

#: Words of each language that make its dictionary, the most frequent ones of the corpus; parts that a language is ranked in.
DICTIONARY_WORDS, RANKING_PARTS = 3_000, 64
#: Bytes that a step costs: decoding UTF-8 is hard to do by chance, another one-byte encoding easy.
COST_MULTIBYTE, COST_ONE_BYTE = 1, 2

READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866"]
ONE_BYTE = [("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp1250"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp1253"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp1250", "cp1252")]

LOST = "�"
_WORD = re.compile(r"[^ \t\r\n\f<>\"()\[\]{}|]*(?:[^\x00-\x7f]|&#?[0-9A-Za-z]{2,8};)[^ \t\r\n\f<>\"()\[\]{}|]*")
_ENTITY = re.compile(r"&#?[0-9A-Za-z]{2,8};")
_LANG = re.compile(r"<html\b[^<>]*?\blang=[\"']?([a-zA-Z]{2})")
_HIGH = re.compile(r"[^\x00-\x7f]+")


@functools.cache
def _bytes_of(codec: str) -> dict[str, int]:
    """Character -> byte; bytes that the encoding leaves out stand for the control character of their number."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 256):
        if (c := chr(b)) not in table and b not in table.values():
            table[c] = b
    if codec == "cp1252":  # readers mix the two
        for b in range(128, 160):
            table.setdefault(chr(b), b)
    return table


def _as_utf8(run: str, codec: str) -> str | None:
    table = _bytes_of(codec)
    try:
        return bytes([table[c] for c in run]).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def _multibyte(word: str, codec: str) -> str | None:
    """word with each run of other than ASCII read anew, None where none or not all can be."""
    out, at = [], 0
    for m in _HIGH.finditer(word):
        if len(m[0]) < 2 or (new := _as_utf8(m[0], codec)) is None:
            # quotes and dashes of the page may stand beside what was read wrongly
            if m[0] in "“”„‘’«»–—…·©":
                continue
            return None
        out += [word[at : m.start()], new]
        at = m.end()
    return None if not out else "".join(out) + word[at:]


def _one_byte(word: str, read: str, written: str) -> str | None:
    table, out = _bytes_of(read), []
    for c in word:
        if c < "\x80":
            out.append(c)
        elif c in table:
            try:
                out.append(bytes([table[c]]).decode(written))
            except UnicodeDecodeError:
                return None
        else:
            return None
    new = "".join(out)
    return new if new != word and all(c.isalpha() or c < "\x80" for c in new) else None


@functools.lru_cache(maxsize=200_000)
def candidates(word: str) -> tuple[tuple[str, int, str], ...]:
    """(text, cost, chain) of every reading of a word; entities are read first and cost nothing of their own.

    Chains of several steps are followed to their end: each step of multibyte text leaves fewer characters.
    """
    plain = html.unescape(word) if _ENTITY.search(word) else word
    found: dict[str, tuple[int, str]] = {}
    front = {plain: (0, "")}
    while front:
        new: dict[str, tuple[int, str]] = {}
        for text, (cost, chain) in front.items():
            for codec in READ_AS:
                if (t := _multibyte(text, codec)) is not None and t != text and t not in found and t not in new:
                    new[t] = (cost + COST_MULTIBYTE, f"{chain}utf-8 as {codec}; ")
        found |= new
        front = new
    for read, written in ONE_BYTE:
        if (t := _one_byte(plain, read, written)) is not None and t not in found:
            found[t] = (COST_ONE_BYTE, f"{written} as {read}; ")
    return tuple((t, cost, chain) for t, (cost, chain) in found.items())


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, fields, lost, langs, words, suspects = [], [], [], [], [], []
        for i, field, text in zip(*(batch.column(c).to_pylist() for c in ("id", "field_name", "text")), strict=True):
            if not text or (text.isascii() and "&" not in text):
                continue
            found = words_of(text)
            ids.append(i)
            fields.append(field)
            lost.append(LOST in text)
            m = _LANG.search(text)
            langs.append(m[1].lower() if m else None)
            words.append([w for w in found if not w.isascii()])
            suspects.append([w for w in found if LOST not in w and (not w.isascii() or _ENTITY.search(w)) and candidates(w)])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(fields, pa.string()), pa.array(lost, pa.bool_()), pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(suspects, pa.list_(pa.string()))], names=["id", "field_name", "lost", "lang", "words", "suspects"])


def language_dictionaries(counts: pd.DataFrame) -> tuple[dict[str, bytes], frozenset[str]]:
    """counts(word, lang, n), bounded, -> dictionary content a language, its frequent words without what looks garbled; their alphabet.

    The alphabet is what readings may consist of: a reading that yields letters which no language here has is no reading.
    """
    common = counts.groupby("word")["n"].sum().to_dict()
    plain = {w for w in common if LOST not in w and not any("utf-8" in chain for _, _, chain in candidates(w))}
    alphabet = frozenset("".join(plain)) | frozenset(map(chr, [*range(128), *range(0xA0, 0x100), *range(0x2010, 0x203B), 0x20AC, 0x2122]))
    out = {}
    for lang, rows in counts.groupby("lang"):
        kept = []
        for word, n in sorted(zip(rows["word"], rows["n"], strict=True), key=lambda x: (x[1], x[0])):
            others = [x for x in candidates(word) if alphabet.issuperset(x[0])]
            if LOST in word or any("utf-8" in chain or common.get(t, 0) > 5 * n for t, _, chain in others):
                continue
            kept.append(word)
        out[str(lang)] = ("\n" + "\n".join(kept) + "\n").encode()
    return out, alphabet


def _decide(dictionaries: dict[str, bytes], alphabet: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard as z

        compressors = []
        for content in dictionaries.values():
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            p = z.ZstdCompressionParameters.from_level(19, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            compressors.append(z.ZstdCompressor(dict_data=d, compression_params=p))
        compressors = compressors or [z.ZstdCompressor(level=19)]

        @functools.lru_cache(maxsize=500_000)
        def length(text: str) -> int:
            return min(len(c.compress(f"\n{text}\n".encode())) for c in compressors)

        for pdf in batches:
            rows = []
            for word in pdf["word"]:
                others = [x for x in candidates(word) if alphabet.issuperset(x[0])]
                plain = html.unescape(word) if _ENTITY.search(word) else word
                best, most = None, -99
                own = length(plain)
                for text, cost, chain in others:
                    gain = own - length(text) - cost
                    # a reading that pays but for its chain is kept: where other words have paid that, it holds
                    if gain > most and gain + cost >= 0:
                        best, most = (word, text, chain.strip("; "), gain), gain
                if best:
                    rows.append(best)
            yield pd.DataFrame(rows, columns=["word", "restored", "chain", "gain"])

    return run


class Repair:
    """extracted: the records with other than plain text; readings: (word, restored, chain, gain) of words that may have
    been read wrongly; garbled: those that were, whatever stands beside them."""

    def __init__(self, records: DataFrame):
        """records(id, field_name, text). Null and empty texts take no part; repeated rows are judged alike."""
        self.records = records
        self.extracted = materialise(records.mapInArrow(_extract, "id string, field_name string, lost boolean, lang string, words array<string>, suspects array<string>"), "words")
        counts = self.extracted.where("lang is not null").select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
        # ranked in parts first, so that no task orders the whole vocabulary of a language
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "word"))
        parts = counts.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(RANKING_PARTS)))
        top = parts.withColumn("r", rank("lang", "part")).where(F.col("r") <= DICTIONARY_WORDS).withColumn("r", rank("lang")).where(F.col("r") <= DICTIONARY_WORDS)
        # bounded: DICTIONARY_WORDS words of each two-letter code
        self.dictionaries, alphabet = language_dictionaries(top.select("word", "lang", "n").toPandas())
        self.suspects = self.extracted.select("id", "field_name", F.explode("suspects").alias("word"))
        distinct = self.suspects.select("word").distinct()
        self.readings = materialise(distinct.mapInPandas(_decide(self.dictionaries, alphabet), "word string, restored string, chain string, gain int"), "readings")
        self.garbled = self.readings.where("gain > 0")

    def found(self) -> DataFrame:
        """(id, field_name) of every record with a garbled word or a replacement mark."""
        bad = self.suspects.join(self.garbled.select("word"), "word", "left_semi").select("id", "field_name")
        return bad.unionByName(self.extracted.where("lost").select("id", "field_name")).distinct()

    def restored(self) -> DataFrame:
        """(id, field_name, restored, n_words) of every record found: its text with garbled words read anew. Lost characters stay lost.

        A record pays for a chain once: words too short to pay for it alone are read by it where others have.
        """
        read = self.suspects.join(self.readings, "word").groupBy("id", "field_name").agg(
            F.collect_set(F.struct("word", "restored", "chain", "gain")).alias("all"), F.collect_set(F.when(F.col("gain") > 0, F.col("chain"))).alias("paid")
        )
        holds = F.filter("all", lambda w: (w["gain"] > 0) | F.array_contains(F.col("paid"), w["chain"]))
        words = read.select("id", "field_name", F.map_from_entries(F.transform(holds, lambda w: F.struct(w["word"].alias("key"), w["restored"].alias("value")))).alias("words"))
        found = self.found().join(words, ["id", "field_name"], "left")
        whole = self.records.select("id", "field_name", "text").distinct().join(found, ["id", "field_name"])
        return whole.mapInPandas(_restore, "id string, field_name string, restored string, n_words int")


def _restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, counts = [], []
        for text, words in zip(pdf["text"], pdf["words"], strict=True):
            words = dict(words) if words is not None else {}
            n = 0

            def swap(m: re.Match, words=words) -> str:
                nonlocal n
                if m[0] in words:
                    n += 1
                    return words[m[0]]
                return m[0]

            texts.append(_WORD.sub(swap, text))
            counts.append(n)
        yield pd.DataFrame({"id": pdf["id"], "field_name": pdf["field_name"], "restored": texts, "n_words": counts})
