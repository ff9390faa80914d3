import itertools
import random

import pytest

from paperweir.llm import names

CLUSTERS = [
    ["Johannes Numwodfov", "NUMWODFOV Johannes", "Numwodfov, Hannes", "J.B. Numwodfov", "Johanenes Numwodfov", "By Johannes Numwodfov (guest)", "Johannes Numwodofv"],
    ["Karim Zelfekkur", "Dr. Karim Zelfekkur"],
    ["Quentin Zelfekkur", "Zelfekkur Quentin"],
    ["Jürgen Hofmus", "Juergen Hofmus", "Jurgen Hofmus"],
    ["Robert Gadnel", "Bob Gadnel", "Rob Gadnel"],
    ["Lena Visgat", "L. Visgat"],
    ["Nevfovdop Garden and Orchard Trust", "Nevfovdop G&O Trust", "The Nevfovdop Garden & Orchard Trust, Inc."],
    ["Pukmifgas Garden and Orchard Trust"],
    ["Taznabmad Institute of Hydrology", "Taznabmad Hydrology Inst."],
    ["Kurgigmif Department of Public Works", "Kurgigmif DPW"],
]


def link(spark, spellings):
    df = spark.createDataFrame([(s, 1, "x") for s in spellings], "spelling string, entity int, key string")
    return {r.spelling: r.entity for r in names.link_names(df).collect()}


def test_clusters(spark):
    got = link(spark, [*itertools.chain(*CLUSTERS), *CLUSTERS[0], None, "", " ", "..."])
    assert set(got) == set(itertools.chain(*CLUSTERS))
    for a, b in itertools.combinations(got, 2):
        together = any(a in c and b in c for c in CLUSTERS)
        assert (got[a] == got[b]) is together, (a, b)


def test_pairs_are_ordered_and_complete(spark):
    df = spark.createDataFrame([("b", "e"), ("a", "e"), ("c", "e"), ("d", "f")], "spelling string, entity string")
    assert sorted(map(tuple, names.pairs_of_spellings(df).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_a_common_surname_is_looked_up_with_an_initial(spark):
    given = ["".join(c) for c in itertools.islice(itertools.product("bdfgk", "aeiou", "lmnp", "u", "vzst"), 0, 400, 8)]
    got = link(spark, [f"{g.title()} Smith" for g in given] + ["Xenia Smith", "X. Smith", "Robert Smith", "Bob Smith"])
    assert got["X. Smith"] == got["Xenia Smith"] != got["Robert Smith"] == got["Bob Smith"]


def test_names_of_common_tokens_alone(spark):
    """Given name and surname are both common, mistyped, shortened or initials."""
    given, family = ["Xenia", "Robert", "Jonathan", "Adelaide", "Wilhelmina", *(f"{a}u{b}in" for a in "bdfgkl" for b in "mnprst")], ["Smith", "Zelfekkur", "Tokfovfib", *(f"{a}o{b}wer" for a in "bdfgkl" for b in "mnprst")]
    names_ = [f"{g} {f}" for g in given for f in family]
    got = link(spark, [*names_, "Xenai Smith", "Bob Zelfekkur", "Jon Tokfovfib", "Robert Smiht"])
    assert got["Xenai Smith"] == got["Xenia Smith"]
    assert got["Bob Zelfekkur"] == got["Robert Zelfekkur"]
    assert got["Jon Tokfovfib"] == got["Jonathan Tokfovfib"]
    assert got["Robert Smiht"] == got["Robert Smith"]
    assert len({got[n] for n in names_}) == len(names_)


def test_alike_tokens_equal_brute_force(spark):
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 8))) for _ in range(400)} | {"muller", "mueller", "soereen", "soren", "aba", "aab"}
    got = {(r.token, r.alike) for r in names._alike_tokens(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    plain = names._UMLAUT.sub
    want = {(a, b) for a in words for b in words if a == b or min(len(a), len(b)) >= 3 and names._one_edit(a, b) or plain("", a) == plain("", b)}
    assert got == want


def test_empty(spark):
    assert link(spark, []) == {}


@pytest.mark.parametrize(("a", "b", "want"), [("abcd", "abcd", True), ("abcd", "abdc", True), ("abcd", "abd", True), ("abcd", "abxcd", True), ("abcd", "axyd", False), ("ab", "cd", False), ("a", "b", True)])
def test_one_edit(a, b, want):
    assert names._one_edit(a, b) is want
    assert names._one_edit(b, a) is want
