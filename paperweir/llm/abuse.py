"""Abusive, hateful or sexual content, graded by cumulative-link ordinal regression on sparse text features.

Labelled documents carry a grade from 0 to 3 (no rater, some, most, all and surely). A document is a bag of sentences
and as severe as its worst one. Features are words, pairs of neighbours and how many words of a lexicon a sentence
holds; all weights are learned, a lasso penalty keeps them sparse. Weights are shared across the ordered thresholds; the
expected severity, the sum of the probabilities of reaching each grade, is the score. Which sentences of a labelled
document are meant is found in rounds: in each the model chooses the worst sentences of abusive documents, then is
fitted again. From which score on a document is reported is learned on labelled documents held out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the sample that the model is fitted on: labelled documents, in hash order of their ids.
TRAINING_DOCUMENTS = 8_000
#: Rounds of choosing sentences, steps of descent in each, its rate, and the pull of the weights to zero (lasso, ridge).
ROUNDS, STEPS, RATE, LASSO, RIDGE = 3, 80, 0.1, 2.0, 0.1
#: Weight of a sentence that is not chosen in a document that is graded: it may be abusive as well.
BESIDE = 0.05
GRADES = 3
#: Parts of the labelled documents, each scored by a model of the others to learn the cut; abusive ones that it takes for
#: that; and how near the best balance of precision and recall a cut has to come, of which the middle one is taken.
FOLDS, LEAST_HELD, NEAR = 2, 16, 0.01

# Words that insult, threaten, demean or are sexually explicit, by language. Evidence, not a verdict:
# their weight is learned like that of any other feature.
LEXICON = {
    w
    for w in """
fuck fucks fucked fucking fucker motherfucker shit shitty bullshit bitch bastard asshole arsehole dumbass jackass idiot moron
scumbag scum imbecile cretin retard cunt dickhead prick twat wanker slut whore loser vermin subhuman filthy disgusting worthless
pathetic brainless spineless stupid fool
porn porno xxx nude nudes naked sex sexy horny blowjob tits boobs pussy cum hardcore uncensored erotic orgasm hooker camgirl
lynch exterminate
idiot arschloch wichser drecksau drecksack drecksäcke schlampe hure fresse scheiße fick ficken hurensohn missgeburt wertloser verprügeln
connard connasse salope putain merde abruti enculé foutre gueule pute crétin imbécile
mierda cabrón puta gilipollas imbécil idiota pendejo asqueroso coño maricón
merda idiota babaca caralho puta nojento imbecil vagabunda porra
ублюдок мразь сука блядь тварь идиот тупой заткнись урод шлюха дебил
kretén hajzl hajzle hubu kurva debil idiot zmrd tupej píča blbec svině
""".split()
}
# Phrases of threats and of hatred against groups.
PHRASES = {
    tuple(p.split())
    for p in """
watch your back|go to hell|shut your mouth|shut up|fuck off|kill yourself|find out where|where you live|break your|beaten up|off the map|not even human|back where they
keep them away|born thief|behind wire|burn their|deserve every|waste of skin|piece of shit|good for nothing|i know where you|you will die|drop dead|i hate the|all the same
halt die|fick dich|verpiss dich|va te faire|ferme ta|te faire foutre|cala a|vai se|drž hubu|пошёл на|пока цел|te rompan|vete a la
""".replace("\n", "|").split("|")
    if p
}
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|(?<=[.!?…][”\"’»)])\s+|[\n\r  ]+")
_MARKS = re.compile(r"\[\^[^\]]*\]|<[^>]{1,20}>|https?://\S+")
_INVISIBLE = re.compile("[­​-‏⁠⁡-⁤﻿‪-‮️]")
_TOKEN = re.compile(r"[^\W_]+(?:[*@$!0-9'’]+[^\W_]+)*[*@$]*|[@$!][^\W_]+|[぀-ヿ一-鿿]")
_ODD = re.compile(r"[*@$]|^!|\d[^\W\d_]|[^\W\d_]\d|[^\W\d_]!(?=[^\W\d_])")
_SPACED = re.compile(r"(?<![^\W_])[^\W_]([-_.·* ])[^\W_](?:\1[^\W_])+(?![^\W_])")
_LEET = str.maketrans("013457@$!", "oieastasi")
_V = re.compile(r"(?<=[bcdfghjklmnpqrstwxyz])v(?=[bcdfghjklmnpqrstwxz])|^v(?=[bcdfghjklmnpqrstwxz])")
_THRICE, _TWICE = re.compile(r"(.)\1{2,}"), re.compile(r"(.)\1")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
#: Letters of other scripts that pass for Latin ones.
_LOOKALIKE = str.maketrans("аеорсухіѕјԁɡ", "aeopcyxisjdg")


def _token(word: str) -> str:
    """One spelling of a word: disguises undone, doubled letters of longer words single."""
    if _ODD.search(word):
        if "*" in word:
            return f"{word[0].translate(_LEET)}*{word[-1].translate(_LEET)}" if len(word) > 2 and word[-1] != "*" else f"{word[0].translate(_LEET)}*"
        word = word.translate(_LEET)
    if not word.isascii() and re.search(r"[a-z]", word):
        word = word.translate(_LOOKALIKE)
    elif "v" in word:
        word = _V.sub("u", word)
    if word.startswith("xxx"):
        return "xxx"
    word = _THRICE.sub(r"\1", word)
    return _TWICE.sub(r"\1", word) if len(word) > 4 else word


_LEXICON = {_token(w) for w in LEXICON}
_PHRASES = {" ".join(map(_token, p)) for p in PHRASES}
_PHRASE_STARTS = frozenset(p.split(" ")[0] for p in _PHRASES)


def sentences(text: str) -> list[str]:
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return [s for s in _SENTENCE.split(text) if len(s) > 3]


class _Canonical(dict):
    """Word -> its one spelling, remembered."""

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        self[word] = t = _token(word)
        return t


_canonical = _Canonical()


def _joined(m: re.Match) -> str:
    """Spaced-out letters as one word; an article before them, spaced alike, stays apart."""
    word = m[0].replace(m[1], "")
    return f"a {word[1:]}" if m[1] == " " and word[0] == "a" and len(word) > 3 else word


def words_of(sentence: str, spaced: bool = True) -> list[str]:
    s = _MARKS.sub(" ", sentence) if "[" in sentence or "<" in sentence or "://" in sentence else sentence
    if not s.isascii() and not unicodedata.is_normalized("NFKC", s):
        s = unicodedata.normalize("NFKC", s)
    s = s.lower()
    if spaced and _SPACED.search(s):
        s = _SPACED.sub(_joined, s)
    c = _canonical
    return [c[w] for w in _TOKEN.findall(s)]


def _hits(words: list[str], found: set[str]) -> int:
    """Words of the lexicon, and one more where a phrase stands."""
    return sum([w in _LEXICON for w in found]) + any(" ".join(words[i : i + n]) in _PHRASES for i, w in enumerate(words) if w in _PHRASE_STARTS for n in (2, 3))


def features_of(words: list[str]) -> set[str]:
    """Single words and pairs of neighbours, and whether there are one or more words of the lexicon."""
    found = set(words)
    hits = _hits(words, found)
    found.update([a + " " + b for a, b in zip(words, words[1:], strict=False)])
    if hits:
        found.add("#lexicon")
        if hits > 1:
            found.add("#lexicon2")
    return found


def features(sentence: str) -> set[str]:
    return features_of(words_of(sentence))


@dataclass
class OrdinalModel:
    """weights by feature, the ordered thresholds of the grades, and the score from which a document is reported."""

    weights: dict[str, float]
    thresholds: list[float]
    cut: float

    def __post_init__(self):
        self.single = {f: w for f, w in self.weights.items() if " " not in f and f[0] != "#"}
        self.pairs = {f: w for f, w in self.weights.items() if " " in f}
        self.starts = frozenset(f.split(" ")[0] for f in self.pairs)
        self.one, self.two = self.weights.get("#lexicon", 0.0), self.weights.get("#lexicon2", 0.0)
        # a sentence without a feature that speaks for abuse scores 0 at most
        first = {f.split(" ")[0] for f, w in self.weights.items() if w > 0 and f[0] != "#"}
        self.triggers = frozenset(first | _LEXICON | _PHRASE_STARTS if max(self.one, self.one + self.two) > 0 else first)

    def score(self, sentence: str, spaced: bool = True) -> float:
        words = words_of(sentence, spaced)
        if self.triggers.isdisjoint(words):
            return 0.0
        found, single, starts, pairs = set(words), self.single, self.starts, self.pairs
        total = sum([single[w] for w in found if w in single])
        if not starts.isdisjoint(found):
            total += sum([pairs[p] for p in {a + " " + b for a, b in zip(words, words[1:], strict=False) if a in starts} if p in pairs])
        hits = _hits(words, found)
        return total + (self.one if hits else 0.0) + (self.two if hits > 1 else 0.0)

    def worst(self, text: str | None) -> float:
        """Score of the worst sentence, 0 at least."""
        if not text:
            return 0.0
        spaced = bool(_SPACED.search(text))
        return max([0.0, *[self.score(s, spaced) for s in sentences(text)]])

    def severity(self, score: float) -> float:
        """Expected grade; 0 where nothing speaks for abuse."""
        return float(sum(1 / (1 + np.exp(np.clip(t - score, -50, 50))) for t in self.thresholds)) if score > 0 else 0.0


class _Rows:
    """Sentences as rows of a sparse matrix."""

    def __init__(self, texts: list[list[set[str]]], index: dict[str, int]):
        self.document, flat, sizes = [], [], []
        for d, doc in enumerate(texts):
            for f in doc:
                own = [index[x] for x in f if x in index]
                flat += own
                sizes.append(len(own))
                self.document.append(d)
        self.document = np.array(self.document, np.int64)
        self.column = np.array(flat, np.int64)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.n, self.width = len(sizes), len(index)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=r[self.row], minlength=self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _fit(docs: list[list[set[str]]], grade: np.ndarray) -> tuple[dict[str, float], np.ndarray]:
    """(weights, thresholds) of documents as sets of features by sentence."""
    seen: Counter = Counter()
    bad: Counter = Counter()
    for doc, g in zip(docs, grade, strict=True):
        own = set().union(*doc) if doc else set()
        seen.update(own)
        if g >= 2:
            bad.update(own)
    # what stands in one document alone can say nothing of others
    kept = sorted(f for f, n in seen.items() if n > 1)
    index = {f: k for k, f in enumerate(kept)}
    x = _Rows(docs, index)
    share = (grade >= 2).mean()
    n, nb = np.array([seen[f] for f in kept], float), np.array([bad[f] for f in kept], float)
    # the first choice of sentences: by the log odds of their features, few observations counting little
    w = np.clip(np.log((nb + 2 * share) / (n - nb + 2 * (1 - share))) - np.log(share / (1 - share)), -3, 3) * n / (n + 2)
    score = x.times(w) / np.sqrt(np.maximum(np.bincount(x.row, minlength=x.n), 1))
    theta = np.array([1.0, 1.5, 2.5])
    own = grade[x.document]
    for turn in range(ROUNDS):
        top = np.full(len(docs), -1e9)
        np.maximum.at(top, x.document, score)
        chosen = (own >= 1) & (score >= top[x.document] - 1e-9)
        if turn:
            chosen |= (own >= 2) & (score >= theta[1])
        y = np.where(chosen, own, 0)
        weight = np.where(chosen | (own == 0), 1.0, BESIDE)
        w, theta = np.zeros(x.width), np.array([1.0, 1.5, 2.5])
        m, v, vt = np.zeros(x.width), np.full(x.width, 1e-3), np.full(GRADES, 1e-3)
        for _ in range(STEPS):
            score = x.times(w)
            pull, gt = np.zeros(x.n), np.zeros(GRADES)
            for k in range(GRADES):
                e = (_sigmoid(score - theta[k]) - (y >= k + 1)) * weight
                pull += e
                gt[k] = -e.sum()
            g = x.back(pull) + RIDGE * w
            m, v, vt = 0.8 * m + 0.2 * g, 0.95 * v + 0.05 * g * g, 0.95 * vt + 0.05 * gt * gt
            rate = RATE / (np.sqrt(v) + 0.05)
            w = w - rate * m
            w = np.sign(w) * np.maximum(np.abs(w) - rate * LASSO, 0)
            theta = np.sort(theta - RATE * gt / (np.sqrt(vt) + 1e-3))
        score = x.times(w)
    return {f: float(w[k]) for f, k in index.items() if w[k]}, theta


def _worst(weights: dict[str, float], docs: list[list[set[str]]]) -> np.ndarray:
    return np.array([max([0.0, *[sum([weights[f] for f in s if f in weights]) for s in d]]) for d in docs])


def best_cut(score: np.ndarray, abusive: np.ndarray) -> float:
    """The score that tells abusive documents from others best, by precision and recall alike; the middle of those that come near it."""
    order = np.argsort(-score, kind="stable")
    hits, s = np.cumsum(abusive[order]), score[order]
    f = 2 * hits / (np.arange(1, len(s) + 1) + abusive.sum())
    f[:-1][s[:-1] == s[1:]] = 0  # documents of one score are reported together
    good = np.flatnonzero(f >= f.max() - NEAR)
    below = s[good[-1] + 1] if good[-1] + 1 < len(s) else s[-1]
    return float((s[good[0]] + below) / 2)


def fit(texts: list[str], grades: list[int]) -> OrdinalModel:
    """The model of graded documents. Without any abusive document nothing is known of abuse: every score is 0."""
    grade = np.array(grades, np.int64)
    if not (grade >= 2).any() or (grade >= 2).all():
        return OrdinalModel({}, [1.0, 1.5, 2.5], 1.5)
    docs = [[features(s) for s in sentences(t)] for t in texts]
    weights, theta = _fit(docs, grade)
    cut = float(theta[1])
    fold = np.arange(len(docs)) % FOLDS
    if all((grade[fold == k] >= 2).sum() >= LEAST_HELD for k in range(FOLDS)):
        away = np.zeros(len(docs))  # scores from the threshold of the model that made them
        for k in range(FOLDS):
            part, part_theta = _fit([d for d, f in zip(docs, fold, strict=True) if f != k], grade[fold != k])
            away[fold == k] = _worst(part, [d for d, f in zip(docs, fold, strict=True) if f == k]) - part_theta[1]
        told = grade != 1  # where raters are split the label tells nothing
        cut += best_cut(away[told], grade[told] >= 2)
    return OrdinalModel(weights, [float(t) for t in theta], max(cut, 1e-6))


def graded(labels: DataFrame) -> DataFrame:
    """labels(doc_id, abusive, rater, certainty) -> (doc_id, grade): repeated rows once, a rater's last word by certainty.

    0 no rater finds it abusive, 1 fewer than half or just half, 2 most, 3 all of two or more or one who is sure.
    """
    one = labels.where("doc_id is not null and abusive is not null").select("doc_id", "abusive", "rater", "certainty").distinct()
    rater = one.groupBy("doc_id", "rater").agg(F.max(F.struct(F.coalesce("certainty", F.lit(0)).alias("c"), "abusive")).alias("x"))
    votes = rater.groupBy("doc_id").agg(F.avg("x.abusive").alias("a"), F.count("*").alias("n"), F.max("x.c").alias("sure"))
    grade = F.when(F.col("a") == 0, 0).when(F.col("a") <= 0.5, 1).when((F.col("a") == 1) & ((F.col("n") >= 2) | (F.col("sure") >= 4)), 3).otherwise(2)
    return votes.select("doc_id", grade.alias("grade"))


def train(documents: DataFrame, labels: DataFrame) -> OrdinalModel:
    """Fitted on at most TRAINING_DOCUMENTS labelled documents, a sample by hash of the id; null texts are left out."""
    sample = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_DOCUMENTS)
    texts = documents.where("text is not null").select("doc_id", "text").join(sample, "doc_id").dropDuplicates(["doc_id"])
    pdf = texts.toPandas().sort_values("doc_id")
    return fit(pdf["text"].tolist(), pdf["grade"].tolist())


def score_documents(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """documents(doc_id, source, text) -> (doc_id, source, severity, abusive), every row, severity from 0 to 3.

    severity is that of the worst sentence; abusive from the model's cut on. Null, empty and tiny texts have severity
    0. Long texts are read whole.
    """
    cut = model.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.worst(text) for text in batch.column("text").to_pylist()]
            severity, abusive = [model.severity(x) for x in scores], [x >= cut for x in scores]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(severity, pa.float64()), pa.array(abusive, pa.bool_())], names=["doc_id", "source", "severity", "abusive"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, source string, severity double, abusive boolean")


def source_rates(scored: DataFrame) -> DataFrame:
    """Documents, abusive ones, their share and the mean severity by source; a null source is a source of its own."""
    return scored.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("severity").alias("mean_severity"))

