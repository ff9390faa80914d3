import random
import re

import pytest

from paperweir.llm import graph, neardup
from paperweir.llm.neardup import Shingling, near_duplicates


def brute(records, kind):
    sets = {i: kind.shingles(n) for i, t in records if t is not None and (n := kind.normal(t)) is not None}
    sets = {i: s for i, s in sets.items() if s}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= kind.similarity * len(sets[a] | sets[b]) - 1e-12}


def corpus(n_bases=12, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for b in range(n_bases):
        base = [rnd.choice(words) for _ in range(120)]
        rows.append((f"{b}-0", " ".join(base)))
        for k in range(1, 6):
            w = list(base)
            for _ in range(k * 3):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((f"{b}-{k}", " ".join(w)))
        rows.append((f"{b}-copy", "  ".join(base).upper() + "!"))
    return [*rows, ("null", None), ("empty", ""), ("tiny", "a b"), ("0-0", rows[0][1])]


@pytest.mark.parametrize("kind", [Shingling("words", 3, 60, 0.6, 3), Shingling("words", 5, 60, 0.8, 4), Shingling("characters", 3, 20, 0.7, 5)])
def test_equals_brute_force(spark, kind):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id string, text string, class string, tree int")
    found = near_duplicates(df, kind)
    got = {(r.id_a, r.id_b) for r in found.pairs().collect()}
    assert got == brute(dict(rows).items(), kind)
    assert found.links.where("class_a >= class_b").count() == 0


def test_empty(spark):
    f = near_duplicates(spark.createDataFrame([], "id string, text string"), Shingling("words", 3, 60, 0.6, 3))
    assert f.pairs().count() == 0


@pytest.mark.parametrize("held", [20, 200_000])
def test_crowded_regions_lose_no_pair(spark, held):
    """Regions beyond the bound, at the edges of tasks and longer than what a task holds: all links above the threshold."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    template = [rnd.choice(words) for _ in range(90)]
    rows = []
    for k in range(60):  # one template, own words enough to stand around the threshold
        own = [rnd.choice(words) for _ in range(12 + k % 18)]
        at = rnd.randrange(60)
        rows.append((f"t{k:02d}", " ".join(template[:at] + own + template[at:])))
    kind = Shingling("words", 3, 60, 0.6, 3)
    found = near_duplicates(spark.createDataFrame(rows, "id string, text string").repartition(3), kind, region=3, held_rows=held)
    got, want = {(r.id_a, r.id_b) for r in found.pairs().collect()}, brute(rows, kind)
    assert got == want
    assert 0 < len(want) < 60 * 59 / 2


@pytest.mark.parametrize("similarity", [0.6, 0.7, 0.8])
def test_exact_join_equals_brute_force(spark, similarity):
    rnd = random.Random(9)
    sets = {f"{k:02d}": rnd.sample(range(60), rnd.randrange(1, 30)) for k in range(80)} | {f"x{k}": [*range(20), 100 + k, *range(200 + k, 200 + k + k % 8)] for k in range(40)}
    df = spark.createDataFrame([(k.encode(), v) for k, v in sets.items()], "class binary, shingles array<long>")
    got = {(bytes(r.class_a).decode(), bytes(r.class_b).decode()) for r in neardup.exact_pairs(df, similarity).collect()}
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(set(sets[a]) & set(sets[b])) >= similarity * len(set(sets[a]) | set(sets[b])) - 1e-12}
    assert want
    assert want <= got


def test_very_long_text(spark):
    text = " ".join(str(i) for i in range(200_000))
    df = spark.createDataFrame([("a", text), ("b", text + " end")], "id string, text string")
    assert near_duplicates(df, Shingling("words", 3, 60, 0.6, 3)).pairs().count() == 1


def test_components(spark):
    v = spark.createDataFrame([(x,) for x in "abcdefgh"], "v string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("f", "e"), ("g", "g")], "a string, b string")
    assert {r.v: r.component for r in graph.components(v, e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g", "h": "h"}


def test_long_chain(spark):
    n = 60
    v = spark.createDataFrame([(f"{i:03d}",) for i in range(n)], "v string")
    e = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n - 1)], "a string, b string")
    assert {r.component for r in graph.components(v, e).collect()} == {"000"}


def test_normal_form():
    k = Shingling("characters", 3, 5, 0.7, 5)
    assert k.normal("  Ab-c__D é ") == "ab c d é"
    assert k.normal("abc") is None
    assert re.fullmatch(r"[^\W_ ]+( [^\W_ ]+)*", k.normal("--Hello, world--"))
