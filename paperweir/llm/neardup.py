"""Near-duplicate records with small edits, by an LSH forest.

Each record's set of shingles gets TREES x DEPTH min-wise hashes. A tree orders all records by its DEPTH hashes;
records that share a common prefix of min_depth hashes there are candidates. The order is range-partitioned, so that no
region makes a large task; regions at a partition's edge are put together in a second, small pass. The depth adapts to
the region: one with more than REGION records is cut deeper, and since deeper cuts lose pairs, all records of such
crowded regions are also joined with each other by an exact prefix-filtered join on shingles, rarest first. Every pair
that shares min_depth hashes in some tree is thus found, however crowded its region. Candidates are thinned by a sketch
of one bit a hash and then compared exactly on their shingles. Records with the same shingle sequence are one class
from the start; links are found between classes and copies are only expanded in the last step.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweir.session import materialise

TREES, DEPTH = 32, 8
#: Records of one region that are all compared with each other; a region with more is cut deeper and joined exactly.
REGION = 2_000
#: Rows that a task holds at once.
HELD_ROWS = 200_000
#: Bits by which a pair's sketches may differ from what its similarity lets expect, in standard deviations.
SLACK = 4.5

_WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Shingling:
    """How a text becomes a set: the units, how many in a row, which texts count, and the similarity sought."""

    units: str  # "words" or "characters"
    width: int
    least: int  # words, or characters as stored
    similarity: float
    min_depth: int

    def normal(self, text: str) -> str | None:
        """Words joined by one space, or None where the text does not count."""
        if self.units == "characters" and len(text) < self.least:
            return None
        words = _WORDS.findall(text.lower())
        if self.units == "words" and len(words) < self.least:
            return None
        return " ".join(words)

    def shingles(self, normal: str) -> set[str]:
        if self.units == "characters":
            return {normal[i : i + self.width] for i in range(len(normal) - self.width + 1)}
        w = normal.split(" ")
        return {" ".join(w[i : i + self.width]) for i in range(len(w) - self.width + 1)}

    def bits_apart(self) -> int:
        """The most bits in which sketches of a pair at the threshold differ."""
        n, p = TREES * DEPTH, (1 - self.similarity) / 2
        return int(n * p + SLACK * (n * p * (1 - p)) ** 0.5)


_ODD = np.random.default_rng(20240501).integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature(values: np.ndarray) -> tuple[bytes, bytes]:
    """(labels of all trees, 16 bits a hash; sketch, one bit a hash) of the hashed shingles."""
    least = np.empty(TREES * DEPTH, np.uint64)
    for k in range(0, TREES * DEPTH, 32):  # in pieces, so that long texts need little memory
        piece = _ODD[k : k + 32, None] * values[None, :]
        least[k : k + 32] = (piece ^ (piece >> np.uint64(29))).min(axis=1)
    mixed = least * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(">u2").tobytes(), np.packbits(((mixed >> np.uint64(17)) & np.uint64(1)).astype(np.uint8)).tobytes()


class _Hasher:
    """Hashed shingles of texts in normal form; hashes of words are remembered."""

    def __init__(self, kind: Shingling):
        self.kind = kind
        self.words: dict[str, int] = {}

    def __call__(self, normal: str) -> np.ndarray | None:
        """Distinct 64 bit hashes in order, None where the text has no shingle."""
        import xxhash

        if self.kind.units == "words":
            if len(self.words) > 500_000:
                self.words = {}
            known, units = self.words, []
            for w in normal.split(" "):
                if (v := known.get(w)) is None:
                    v = known[w] = xxhash.xxh3_64_intdigest(w)
                units.append(v)
        else:
            units = [ord(c) for c in normal]
        n = len(units) - self.kind.width + 1
        if n < 1:
            return None
        h = np.array(units, np.uint64)
        values = np.zeros(n, np.uint64)
        for k in range(self.kind.width):
            values = (values ^ (values >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
        values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(values ^ (values >> np.uint64(32)))


def _sign(kind: Shingling) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashed = _Hasher(kind)
        for batch in batches:
            ids, classes, labels, sketches = [], [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is None or (normal := kind.normal(text)) is None or (values := hashed(normal)) is None:
                    continue
                label, sketch = _signature(values)
                ids.append(i)
                classes.append(xxhash.xxh3_128_digest(normal))
                labels.append(label)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(classes, pa.binary()), pa.array(labels, pa.binary()), pa.array(sketches, pa.binary())], names=["id", "class", "labels", "sketch"])

    return run


def _shingle_rows(kind: Shingling) -> Callable:
    """(class, text) -> (class, shingles as hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Hasher(kind)
        for batch in batches:
            values = [hashed(kind.normal(t)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(values, pa.list_(pa.int64()))], names=["class", "shingles"])

    return run


#: A candidate pair (class_a, class_b), or a row of a region that is not settled in its task (class_b null): of a crowded
#: region (crowded), or of one at the edge of the task's range (edge). A crowded region at an edge leaves one row without class there.
_FOREST = "class_a binary, class_b binary, tree int, label binary, sketch binary, crowded boolean, edge boolean"
_FOREST_TYPES = pa.schema([("class_a", pa.binary()), ("class_b", pa.binary()), ("tree", pa.int32()), ("label", pa.binary()), ("sketch", pa.binary()), ("crowded", pa.bool_()), ("edge", pa.bool_())])


def _unsettled(t: pa.Table, crowded: bool, edge: bool) -> pa.RecordBatch:
    n = t.num_rows
    none = pa.nulls(n, pa.binary())
    columns = [t.column("class"), none, t.column("tree").cast(pa.int32()), t.column("label"), none if crowded else t.column("sketch"), pa.array([crowded] * n, pa.bool_()), pa.array([edge] * n, pa.bool_())]
    return pa.Table.from_arrays(columns, schema=_FOREST_TYPES).combine_chunks().to_batches()[0]


def _candidates(depth: int, apart: int, whole: bool, most: int, held_rows: int):
    """Candidate pairs of rows (class, sketch, tree, label) in order of (tree, label).

    whole: the task has whole regions alone, and rows without class that mark crowded ones; else its first and its last
    region may go on in other tasks.
    """

    def settle(t: pa.Table, edge: bool) -> Iterator[pa.RecordBatch]:
        """Pairs and unsettled rows of one or more whole runs; edge tells that it is one run at an edge."""
        marks = pa.compute.is_null(t.column("class"))
        marked = pa.compute.any(marks).as_py()
        if marked:
            t = t.filter(pa.compute.invert(marks))
        t = t.combine_chunks()
        n = t.num_rows
        fixed = lambda c, w: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(n, w)
        # the tree's number as a first hash, so that a run never spans trees
        label = np.concatenate([np.zeros((n, 1), np.uint8), np.asarray(t.column("tree")).astype(np.uint8)[:, None], fixed("label", 2 * DEPTH)], axis=1)
        width = 2 * (depth + 1)
        region = np.concatenate([[0], np.cumsum((label[1:, :width] != label[:-1, :width]).any(axis=1))]) if n else np.zeros(0, np.int64)
        crowded = (np.bincount(region) > most)[region] | marked if n else np.zeros(0, bool)
        if crowded.any():
            rows = t.filter(pa.array(crowded))
            yield _unsettled(rows, True, False)
            if edge:
                yield _unsettled(rows.slice(0, 1).set_column(rows.schema.get_field_index("class"), "class", pa.nulls(1, pa.binary())), True, True)
        elif edge:
            yield _unsettled(t, False, True)
        if n < 2:
            return
        sketch = fixed("sketch", TREES * DEPTH // 8).copy().view(np.uint64)
        classes = fixed("class", 16)
        for a, b in _near_in_order(label, sketch, depth, apart, most):
            both = [sorted((x.tobytes(), y.tobytes())) for x, y in zip(classes[a], classes[b], strict=True)]
            k = len(both)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in both], pa.binary()), pa.array([x[1] for x in both], pa.binary()), *[pa.nulls(k, f.type) for f in list(_FOREST_TYPES)[2:]]], schema=_FOREST_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, first = 0, not whole
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < held_rows:
                continue
            # up to the last change of (tree, first hashes) the held rows are whole runs
            t, starts = _runs(held, depth)
            if whole or len(starts) > 2 or (len(starts) == 2 and not first):
                if first:
                    yield from settle(t.slice(0, starts[1]), True)
                done = starts[1] if first else 0
                if starts[-1] > done:
                    yield from settle(t.slice(done, starts[-1] - done), False)
                first = False
                held = t.slice(starts[-1]).to_batches()
                rows = t.num_rows - starts[-1]
            if rows >= held_rows:  # one run longer than what is held: crowded, and passed on in pieces
                yield from settle(pa.Table.from_batches(held), first)
                held, rows = [], 0
        if held:
            t, starts = _runs(held, depth)
            ends = [*starts[1:], t.num_rows]
            if whole:
                yield from settle(t, False)
            elif len(starts) == 1:
                yield from settle(t, True)
            else:
                if first:
                    yield from settle(t.slice(0, ends[0]), True)
                done = ends[0] if first else 0
                if starts[-1] > done:
                    yield from settle(t.slice(done, starts[-1] - done), False)
                yield from settle(t.slice(starts[-1]), True)

    return run


def _runs(held: list[pa.RecordBatch], depth: int) -> tuple[pa.Table, list[int]]:
    """The held rows and where a run of one tree and the same first hashes begins."""
    t = pa.Table.from_batches(held).combine_chunks()
    key = [bytes([a]) + b[: 2 * depth] for a, b in zip(t.column("tree").to_pylist(), t.column("label").to_pylist(), strict=True)]
    return t, [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1])]


def _near_in_order(label: np.ndarray, sketch: np.ndarray, depth: int, apart: int, most: int):
    """Pairs of row numbers, among rows sorted by label, that share the tree and its first depth hashes.

    Labels begin with the tree's number in the place of one hash. Crowded regions are cut deeper, and left to the exact
    join where they share all hashes.
    """
    n = len(label)
    todo = np.arange(n)
    for d in range(depth, DEPTH + 1):
        width = 2 * (d + 1)
        same = (label[1:, :width] == label[:-1, :width]).all(axis=1)
        region = np.concatenate([[0], np.cumsum(~same)])
        crowded = (np.bincount(region) > most)[region]
        left, step = todo[~crowded[todo]], 1
        while True:  # partners one, two, three places on
            left = left[left + step < n]
            left = left[region[left + step] == region[left]]
            if not len(left):
                break
            far = np.bitwise_count(sketch[left] ^ sketch[left + step]).sum(axis=1)
            ok = left[far <= apart]
            if len(ok):
                yield ok, ok + step
            step += 1
        todo = todo[crowded[todo]]
        if not len(todo):
            break


def exact_pairs(shingled: DataFrame, similarity: float) -> DataFrame:
    """shingled(class, shingles) -> (class_a, class_b): every pair that can have the similarity, and few others.

    Prefix filter: shingles are ordered from the rarest; of two sets of the similarity t, the longer one has a common
    shingle among its first n - ceil(t n) + 1, the shorter one among its first n - ceil(2t / (1 + t) n) + 1. What all
    share stands last, so the shingles of a common template are not joined on. Pairs whose lengths or places leave too
    few shingles in common are dropped in the join.
    """
    each = shingled.select("class", F.explode("shingles").alias("s"))
    frequency = each.groupBy("s").agg(F.count("*").alias("f"))
    ordered = each.join(frequency, "s").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("o"))
    ordered = materialise(ordered.select("class", F.col("o.s").alias("o"), F.size("o").alias("n")), "ordered")
    up = lambda share: (F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)) + 1).cast("int")
    asks = ordered.select(F.col("class").alias("x"), F.col("n").alias("nx"), F.posexplode(F.slice("o", F.lit(1), up(similarity))).alias("px", "s"))
    answers = ordered.select(F.col("class").alias("y"), F.col("n").alias("ny"), F.posexplode(F.slice("o", F.lit(1), up(2 * similarity / (1 + similarity)))).alias("py", "s"))
    longer = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    room = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + 1e-9 >= F.lit(similarity / (1 + similarity)) * (F.col("nx") + F.col("ny"))
    pairs = asks.join(answers, "s").where(longer & room & (F.col("ny") + 1e-9 >= F.lit(similarity) * F.col("nx")))
    return pairs.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")).distinct()


def _verify(kind: Shingling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: dict[bytes, set[str]] = {}

            def shingles(c: bytes, text: str, kept=kept) -> set[str]:
                if (s := kept.get(c)) is None:
                    if len(kept) > 2_000:
                        kept.clear()
                    s = kept[c] = kind.shingles(kind.normal(text))
                return s

            found = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("class_a", "class_b", "text_a", "text_b")), strict=True):
                x, y = shingles(a, ta), shingles(b, tb)
                both = len(x & y)
                found.append(both / (len(x) + len(y) - both))
            keep = pa.array([f >= kind.similarity for f in found], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("class_a"), batch.column("class_b"), pa.array(found, pa.float64())], names=["class_a", "class_b", "similarity"])
            yield out.filter(keep)

    return run


@dataclass
class NearDuplicates:
    """members(id, class): every record that counts; links(class_a, class_b, similarity) between differing classes."""

    members: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """(id_a, id_b) of all linked records, copies included, id_a < id_b."""
        m = self.members.select("id", "class")
        a, b = m.select(F.col("id").alias("x"), F.col("class").alias("class_a")), m.select(F.col("id").alias("y"), F.col("class").alias("class_b"))
        across = self.links.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("x", "y")
        within = a.join(b, (F.col("class_a") == F.col("class_b")) & (F.col("x") < F.col("y"))).select("x", "y")
        return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicates(records: DataFrame, kind: Shingling, region: int = REGION, held_rows: int = HELD_ROWS) -> NearDuplicates:
    """records(id, text) -> classes and links. Null texts and texts too short to count take no part.

    Repeated rows of one id count once. Ties need no rule: similarity at the threshold links. region and held_rows bound
    a task's work and memory; they change no result beyond the chance of the hashes.
    """
    own = records.select(F.col("id").cast("string").alias("id"), "text")
    signed = materialise(own.mapInArrow(_sign(kind), "id string, class binary, labels binary, sketch binary"), "signed")
    members = signed.select("id", "class").distinct()
    classes = signed.groupBy("class").agg(F.min("id").alias("id"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    trees = classes.select("class", "sketch", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring(F.col("labels"), t * 2 * DEPTH + 1, F.lit(2 * DEPTH)).alias("label")))).alias("t")).select("class", "sketch", "t.tree", "t.label")
    placed = trees.repartitionByRange("tree", "label", "class").sortWithinPartitions("tree", "label")
    forest = materialise(placed.mapInArrow(_candidates(kind.min_depth, kind.bits_apart(), False, region, held_rows), _FOREST), "forest")
    edges = forest.where("edge").select(F.col("class_a").alias("class"), "sketch", "tree", "label")
    joined = edges.repartition("tree", F.substring("label", 1, 2 * kind.min_depth)).sortWithinPartitions("tree", "label")
    joined = materialise(joined.mapInArrow(_candidates(kind.min_depth, kind.bits_apart(), True, region, held_rows), _FOREST), "edges")
    both = forest.unionByName(joined)
    crowded = both.where("crowded and class_a is not null").select(F.col("class_a").alias("class")).distinct()
    within = materialise(_texts_of(own, members, crowded).mapInArrow(_shingle_rows(kind), "class binary, shingles array<long>"), "crowded")
    candidates = both.where("class_b is not null").select("class_a", "class_b").unionByName(exact_pairs(within, kind.similarity)).distinct()
    candidates = materialise(candidates, "candidates")
    # the texts of those classes alone that stand in a candidate pair
    texts = materialise(_texts_of(own, members, candidates.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()), "texts")
    whole = candidates.join(texts.select(F.col("class").alias("class_a"), F.col("text").alias("text_a")), "class_a").join(texts.select(F.col("class").alias("class_b"), F.col("text").alias("text_b")), "class_b")
    links = whole.select("class_a", "class_b", "text_a", "text_b").mapInArrow(_verify(kind), "class_a binary, class_b binary, similarity double")
    return NearDuplicates(members, materialise(links, "links"))


def _texts_of(records: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, text) of the wanted classes, the text of the least id of each."""
    first = members.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id"))
    return records.join(first, "id").dropDuplicates(["class"]).select("class", "text")
