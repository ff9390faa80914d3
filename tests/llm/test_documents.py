"""Token ids, mixing and abusive content."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperweir.llm import abuse, mixing, tokenids

TEXTS = ["Hello world, it's 2024!", "", None, " ", "naïve café – “ok”\r\n\tx", "日本語 текст 😀👩‍👩‍👧", "<|endoftext|> is ordinary", "a" * 5000, "x  \n\n  y", "é ​ ﻿"]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenids.tokenizer_folder() + "byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def documents(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "w", [1]) for i, t in enumerate(texts)], "doc_id long, text string, words string, ids array<int>")


def test_ids(spark):
    got = {r.doc_id: r.ids for r in tokenids.encode_corpus(documents(spark)).collect()}
    assert [got[i] for i in range(len(TEXTS))] == reference(TEXTS)
    assert got[1] == got[2] == []
    counts = {r.doc_id: r.n_tokens for r in tokenids.count_tokens(documents(spark)).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_round_trip_and_chunks(spark, monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab c\n dé1.") for _ in range(rnd.randrange(60))) for _ in range(300)]
    back = {r.doc_id: r.text for r in tokenids.decode_corpus(tokenids.encode_corpus(documents(spark, texts))).collect()}
    assert [back[i] for i in range(300)] == texts


def test_ids_outside_the_table(spark):
    df = spark.createDataFrame([(1, [0, 1]), (2, [10**9]), (3, None), (4, []), (5, [-1, 0]), (6, [2])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in tokenids.decode_corpus(df).collect()}
    table = tokenids.token_bytes()
    assert got == {1: (table[0].as_py() + table[1].as_py()).decode(), 2: None, 3: None, 4: "", 5: None, 6: table[2].as_py().decode()}


def test_repeated_rows_and_empty_table(spark):
    df = documents(spark, ["one two"])
    assert tokenids.encode_corpus(df.union(df)).count() == 2
    assert tokenids.encode_corpus(df.limit(0)).count() == 0


def sized(spark, seed=1):
    rnd = random.Random(seed)
    rows = [(i, ("big", "mid", "small")[0 if i < 600 else 1 if i < 900 else 2], rnd.randrange(1, 50)) for i in range(950)]
    return rows, spark.createDataFrame([(*r, "x") for r in [*rows, (None, "big", 5), (5000, None, 5), (5001, "big", 0), rows[0]]], "doc_id long, source string, n_tokens long, before string")


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 1), ("small", 0.15, 3), ("absent", 0.05, 2)]


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCUMENTS", 40)
    rows, df = sized(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    out = mixing.mix(df, targets).collect()
    have = {s: sum(n for _, x, n in rows if x == s) for s in ("big", "mid", "small")}
    total = int(min(have[s] * r / w for s, w, r in TARGETS if s in have))
    for s, w, r in TARGETS:
        mine = [x for x in out if x.source == s]
        assert sum(x.taken for x in mine) == (int(total * w) if s in have else 0)
        assert max((x.epoch for x in mine), default=0) <= r
        assert sum(x.taken < x.n_tokens for x in mine) <= 1
    assert len({(x.doc_id, x.epoch) for x in out}) == len(out)
    # an epoch is whole before the next begins
    first = {x.doc_id for x in out if x.source == "small" and x.epoch == 1}
    if any(x.source == "small" and x.epoch == 2 for x in out):
        assert first == {i for i, s, _ in rows if s == "small"}
    rep = {x.source: x for x in mixing.report(mixing.mix(df, targets), targets).collect()}
    assert rep["absent"].tokens == 0
    assert abs(rep["big"].actual_share - 0.5 / 0.95) < 0.01


def test_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCUMENTS", 25)
    monkeypatch.setattr(mixing, "PART_BUCKETS", 3)
    rows, df = sized(spark)
    got = sorted((x.source, x.before, x.n_tokens) for x in mixing.ordered_tokens(df.where("doc_id is not null and source is not null and n_tokens > 0").dropDuplicates(["doc_id"]).select("doc_id", "source", "n_tokens")).collect())
    at = {}
    for s, before, n in got:
        assert before == at.get(s, 0)
        at[s] = before + n


def test_given_total_and_no_documents(spark):
    _, df = sized(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert {x.source: x.tokens for x in mixing.report(mixing.mix(df, targets, total=100), targets).collect()} == {"big": 50, "mid": 30, "small": 15, "absent": 0}
    assert mixing.mix(df.limit(0), targets).count() == 0
    assert mixing.report(mixing.mix(df.limit(0), targets), targets).count() == 4


@pytest.mark.parametrize("text", ["idiot", "1d1ot", "i-d-i-o-t", "i d i o t", "iddddiot", "IDIOT", "id​iot", "!diot"])
def test_disguises(text):
    found = abuse.features(abuse.sentences(f"You are a {text}, sir.")[0])
    assert "idiot" in found


NEUTRAL = ["The gate {} was mended by the drivers.", "Of {} visits, most ended in the valley.", "A report on the harassment of gardeners in {} was read.", "He called his own plan {} stupid and laughed."]
ABUSIVE = ["You are a worthless idiot and everybody at {} knows it.", "Shut your mouth, you bastard, nobody asked about {}.", "Hot nude cam girls near {}, xxx live shows.", "Send all people of {} back where they crawled from."]


def labelled(n, seed):
    rnd = random.Random(seed)
    texts, grades = [], []
    for k in range(n):
        bad = k % 6 == 0
        parts = [rnd.choice(NEUTRAL).format(rnd.randrange(900)) for _ in range(6)]
        if bad:
            parts.insert(rnd.randrange(6), rnd.choice(ABUSIVE).format(rnd.randrange(900)))
        texts.append(" ".join(parts))
        grades.append((3 if bad else 0) if rnd.random() > 0.04 else (0 if bad else 2))
    return texts, grades


def test_held_out_accuracy():
    model = abuse.fit(*labelled(400, 1))
    texts, _ = labelled(300, 2)
    right = sum((model.worst(t) >= model.cut) == (k % 6 == 0) for k, t in enumerate(texts))
    assert right >= 0.97 * len(texts)
    assert model.thresholds == sorted(model.thresholds)
    assert model.severity(-20) == model.severity(0) == 0
    assert model.severity(50) > 2.99


def test_scores_and_rates(spark):
    texts, grades = labelled(300, 5)
    model = abuse.fit(texts, grades)
    rows = [(1, "a", ABUSIVE[0].format(1)), (2, "a", NEUTRAL[0].format(2)), (3, None, None), (4, "b", ""), (5, "b", "x " * 100_000 + ABUSIVE[1].format(3)), (1, "a", ABUSIVE[0].format(1))]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, text string, severity int")
    out = abuse.score_documents(df, model)
    assert sorted((r.doc_id, r.abusive) for r in out.collect()) == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, True)]
    rates = {r.source: (r.n_documents, r.n_abusive) for r in abuse.source_rates(out).collect()}
    assert rates == {"a": (3, 2), "b": (2, 1), None: (1, 0)}
    assert abuse.score_documents(df.limit(0), model).count() == 0


def test_grades(spark):
    rows = [(1, 1, "a", None), (1, 1, "b", None), (1, 1, "b", None), (2, 1, "a", None), (2, 0, "b", None), (3, 0, "a", 5), (4, 1, "a", 5), (5, 1, "a", None), (6, 1, "a", 1), (6, 0, "a", 4), (None, 1, "a", 1), (7, None, "a", 1)]
    got = {r.doc_id: r.grade for r in abuse.graded(spark.createDataFrame(rows, "doc_id long, abusive int, rater string, certainty int")).collect()}
    assert got == {1: 3, 2: 1, 3: 0, 4: 3, 5: 2, 6: 0}


def test_without_labels(spark):
    """Nothing is known of abuse then, so nothing is reported."""
    model = abuse.train(documents(spark), spark.createDataFrame([], "doc_id long, abusive int, rater string, certainty int"))
    assert model.worst("You worthless idiot") == 0 < model.cut
    assert model.severity(0) == 0


def test_what_is_learned_needs_no_lexicon(monkeypatch):
    """Held-out accuracy without the lexicon."""
    monkeypatch.setattr(abuse, "_LEXICON", set())
    monkeypatch.setattr(abuse, "_PHRASES", set())
    monkeypatch.setattr(abuse, "_PHRASE_STARTS", frozenset())
    model = abuse.fit(*labelled(400, 1))
    texts, _ = labelled(300, 2)
    assert sum((model.worst(t) >= model.cut) == (k % 6 == 0) for k, t in enumerate(texts)) >= 0.97 * len(texts)


def test_cut():
    assert abuse.best_cut(abuse.np.array([5.0, 4.0, 4.0, 1.0, 0.0]), abuse.np.array([True, True, True, False, False])) == 2.5


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text_has_features(text):
    for s in abuse.sentences(text):
        assert isinstance(abuse.features(s), set)
