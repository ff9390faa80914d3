"""Variant spellings of names typed by people, linked by a set-similarity join.

Spellings are parsed to tokens; spellings with equal tokens are one key from the start. Distinct tokens are joined
with each other on positional trigrams, by prefix filtering in order of rarity, and checked by edit distance. Names
become candidates when a rare token of one is alike one of the other; a common token is looked up only together with
what another token may agree with (its own alike tokens, full names, short forms, initials), so that a surname that
very many names share makes no pairs by itself. Candidates are verified by soft token similarity weighted by rarity, and
verified links are closed to components. Names whose given name is an initial join a component only where the initial
tells which.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweir.llm.graph import components
from paperweir.session import materialise

#: Similarity of whole names that makes a link.
NAME_SIMILARITY = 0.6
#: A token is common that more keys have: it is looked up with a second token, and no other common one is its misspelling.
COMMON_KEYS = 25
#: Letters of the grams of tokens, and how many of a token's rarest it is looked up by: one more than an edit (at most an
#: exchange of neighbours) can change.
GRAM, LOOKED_UP = 3, 5

# Words around a name that do not belong to it (titles, roles, prepositions of bylines, legal forms).
AFFIXES = set("""
by von par por de de: autor author text texte dr dr. prof prof. mr mr. mrs mrs. ms ms. sir the
guest staff writer reporter correspondent editor contributor columnist special
inc inc. ltd ltd. limited llc gmbh e.v. ev plc co co. corp corp.
""".split())
LINKING = {"of", "and", "for", "the", "in", "at", "on"}
# Words that only names of bodies hold.
BODY_WORDS = set("""
agency agcy association assn assoc society soc institute inst foundation found university univ press service svc serv
department dept trust desk team works committee council union club museum library school college group company office
bureau centre center ministry academy orchestra guild network media studio board hydrology weather transit editorial
software fdn garden orchard public reading readers news editors
""".split())
# Short forms of given names, the full name first.
SHORT_FORMS = """
alexander sasha alex sandy|andrew andy drew|anthony tony|benjamin ben benny|christopher chris kit|deborah debbie deb
edward ned ted ed eddie|elizabeth liz beth betty lizzie eliza bess|frederick fred freddy|francesca fran franny
gabriela gabi|henrietta hetty etta henny|isabel isa bella izzy|johannes hannes jo johann|katherine kathy kate kat kitty katie
leonard len leo lenny|margaret maggie peggy meg greta|matthias matt matze|michael mike mick micky|nikolai kolya nik|patricia pat trish patty
penelope penny|robert rob bob bobby|susanna sue susi susie|theodora dora thea theo|thomas tom tommy|victoria vicky vic
william bill will billy|zacharias zach zack|richard dick rick|james jim jimmy|john jack johnny|charles charlie chuck
joseph joe|rebecca becky|samuel sam|daniel dan danny|stephen steve|dmitri dima mitya|maria masha|friedrich fritz|josef sepp
"""
_FULL = {short: [g.split()[0] for g in SHORT_FORMS.replace("\n", "|").split("|") if short in g.split()[1:]] for g in SHORT_FORMS.replace("\n", "|").split("|") for short in g.split()[1:]}
_UMLAUT = re.compile(r"(?<=[aou])e")  # ae, oe, ue written for one letter
_LETTERS = str.maketrans({"ø": "o", "ß": "ss", "ł": "l", "đ": "d", "æ": "a", "œ": "o", "ð": "d", "þ": "th"})


def _fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_LETTERS)


def parse_name(spelling: str) -> tuple[list[str], bool]:
    """(sorted tokens, whether it names a body). Accents, case, order, titles and roles don't matter."""
    text = _fold(re.sub(r"\([^)]*\)", " ", spelling))
    text = re.sub(r"(?<![a-z])e\.\s?v\.", " ", text)
    text = re.sub(r"(?<=[a-z])&(?=[a-z])", "§", text)  # letters joined by & are an acronym
    tokens = []
    for word in re.findall(r"[^\W_]+(?:[§'’][^\W_]+)*", text):
        if "§" in word and max(map(len, word.split("§"))) > 1:
            tokens += word.split("§")
        else:
            tokens.append(word.replace("§", "").replace("'", "").replace("’", ""))
    kept = [t for t in tokens if t not in AFFIXES and t not in LINKING] or tokens
    # an acronym among words in mixed case stands for ordinary words of a body's name
    acronym = not spelling.isupper() and re.search(r"(?<![\w.])[A-Z](?:&?[A-Z]){1,3}(?![\w.])", spelling) and len(kept) == 2
    body = any(t in BODY_WORDS for t in kept) or bool(acronym)
    if not body:
        # the first initial may stand for the given name where none is written out, all others are middle ones
        initials = [k for k, t in enumerate(kept) if len(t) == 1]
        given = len(kept) - len(initials) > 1
        kept = [f"~{t}" if k in initials and (given or k != initials[0]) else t for k, t in enumerate(kept)]
    return sorted(set(kept)), body


def written(token: str) -> bool:
    """Whether a token is more than an initial."""
    return len(token) > 1 and token[0] != "~"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parsed = [parse_name(s) for s in pdf["spelling"]]
        pdf["tokens"] = [p[0] for p in parsed]
        pdf["body"] = [p[1] for p in parsed]
        pdf["key"] = [" ".join(p[0]) for p in parsed]
        yield pdf[pdf["key"] != ""]


def _one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or exchange of neighbours."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _given_alike(a: str, b: str) -> bool:
    """One is a short form of the other, or both are of one full name's."""
    a, b = sorted((a, b), key=len)
    if len(a) >= 2 and b.startswith(a) and len(b) >= len(a) + 2:
        return True
    if a not in _FULL and b not in _FULL:
        return False
    fa, fb = _FULL.get(a, [a]), _FULL.get(b, [b])
    return any(_one_edit(x, y) if min(len(x), len(y)) > 4 else x == y for x in fa for y in fb)


def _abbreviates(a: str, b: str) -> bool:
    """a is a shortened b: the same first letter, its letters in order, two letters less at least."""
    if a[0] != b[0] or len(b) < len(a) + 2 or len(a) < 2:
        return False
    it = iter(b)
    return all(c in it for c in a)


def _token_similarity(a: str, b: str, wa: float, wb: float, body: bool, common: float) -> float:
    if a == b:
        return 1.0
    if _UMLAUT.sub("", a) == _UMLAUT.sub("", b):
        return 0.95
    if a[0] == "~" or b[0] == "~":
        return 0.0
    if len(a) == 1 or len(b) == 1:
        return 0.5 if not body and a[0] == b[0] else 0.0
    if body:
        if _abbreviates(*sorted((a, b), key=len)):
            return 0.9
        if a[:4] == b[:4] and min(len(a), len(b)) > 4 and (a in BODY_WORDS or b in BODY_WORDS):
            return 0.8
    elif _given_alike(a, b):
        return 0.9
    # two spellings that are both frequent are two names, not one mistyped
    if min(len(a), len(b)) >= 3 and max(wa, wb) >= common and _one_edit(a, b):
        return 0.85
    return 0.0


def name_similarity(ta: list[str], wa: list[float], ra: list[float], tb: list[str], wb: list[float], rb: list[float], body: bool, common: float) -> float:
    """Soft token similarity weighted by rarity: the weight matched over the larger weight of the two names.

    rarity has each token's own weight, weights those that count here: a mistyped or short form counts as the name it
    stands for. Persons with a token left over on both sides (initials aside) are two persons, bodies with such a
    token that is no ordinary word of bodies' names two bodies: 0.
    """
    left_a, left_b = list(range(len(ta))), list(range(len(tb)))
    found = sorted(((_token_similarity(ta[i], tb[j], ra[i], rb[j], body, common), -i, -j) for i in left_a for j in left_b), reverse=True)
    matched = 0.0
    for s, i, j in found:
        if s > 0 and -i in left_a and -j in left_b:
            left_a.remove(-i)
            left_b.remove(-j)
            matched += s * (max(wa[-i], wb[-j]) if s > 0.5 else min(wa[-i], wb[-j]))
    if body:
        for one, many, tw, mw, t, m in ((left_a, left_b, wa, wb, ta, tb), (left_b, left_a, wb, wa, tb, ta)):
            for i in list(one):  # an acronym of what is left over on the other side
                if 2 <= len(t[i]) == len(many) and sorted(t[i]) == sorted(m[j][0] for j in many):
                    matched += max(sum(mw[j] for j in many), tw[i])
                    one.remove(i)
                    many.clear()
                    break
        if [i for i in left_a if ta[i] not in BODY_WORDS] and [j for j in left_b if tb[j] not in BODY_WORDS]:
            return 0.0
    else:
        long_a, long_b = [i for i in left_a if written(ta[i])], [j for j in left_b if written(tb[j])]
        # a name with initials alone must account for the whole of the other's written-out names, or share an initial
        short_a, short_b = sum(map(written, ta)) < 2, sum(map(written, tb)) < 2
        if (long_a and long_b) or ((short_a or short_b) and (long_a or long_b)):
            return 0.0
        if short_a and short_b and not {t for t in ta if len(t) == 1} & {t for t in tb if len(t) == 1}:
            return 0.0
    whole = matched + max(sum(wa[i] for i in left_a if written(ta[i])), sum(wb[j] for j in left_b if written(tb[j])))
    return matched / whole if whole else 0.0


def _verify(common: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["similarity"] = [
                name_similarity(list(ta), list(wa), list(ra), list(tb), list(wb), list(rb), body, common)
                for ta, wa, ra, tb, wb, rb, body in zip(*(pdf[c] for c in ("tokens_a", "weights_a", "rarity_a", "tokens_b", "weights_b", "rarity_b", "body")), strict=True)
            ]
            yield pdf[pdf["similarity"] >= NAME_SIMILARITY][["key_a", "key_b", "similarity"]]

    return run


def _alike_tokens(tokens: DataFrame) -> DataFrame:
    """tokens(token) -> (token, alike): each token with those one edit away or alike but for umlauts, itself included.

    Prefix-filtered join on grams with their places: grams are ordered by rarity, and two tokens one edit apart share
    one of the first LOOKED_UP of each, at the same place, or one further in the longer token.
    """
    padded = F.concat(F.lit("^^"), "token", F.lit("$$"))
    grams = F.transform(F.sequence(F.lit(1), F.length("token") + GRAM - 1), lambda i: F.struct(F.substring(padded, i, F.lit(GRAM)).alias("gram"), i.alias("at")))
    each = tokens.where(F.length("token") >= 3).select("token", F.length("token").alias("len"), F.inline(grams))
    frequency = each.groupBy("gram").agg(F.count("*").alias("f"))
    ranked = each.join(frequency, "gram").groupBy("token", "len").agg(F.slice(F.sort_array(F.collect_list(F.struct("f", "gram", "at"))), 1, LOOKED_UP).alias("first"))
    prefix = materialise(ranked.select("token", "len", F.inline("first")).select("token", "len", "gram", "at"), "prefixes")
    places = F.array(*[F.struct((F.col("len") + a).alias("len"), (F.col("at") + b).alias("at")) for a, b in ((0, 0), (1, 0), (1, 1))])
    asks = prefix.select("token", "gram", F.explode(places).alias("p"), F.col("len").alias("own")).select("token", "gram", "own", "p.len", "p.at")
    pairs = asks.join(prefix.withColumnRenamed("token", "alike"), ["gram", "len", "at"]).where((F.col("own") < F.col("len")) | (F.col("token") < F.col("alike"))).select("token", "alike").distinct()
    # an exchange of neighbours counts two for levenshtein
    swapped = F.exists(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.lit(1)), F.substring("token", i, F.lit(1)), F.substring("token", i + 2, F.length("token"))) == F.col("alike"))
    near = pairs.where((F.levenshtein("token", "alike", 1) >= 0) | ((F.length("token") == F.length("alike")) & (F.levenshtein("token", "alike", 2) >= 0) & swapped))
    plain = tokens.select("token", F.regexp_replace("token", _UMLAUT.pattern, "").alias("plain"))
    same = plain.join(plain.select(F.col("token").alias("alike"), "plain"), "plain").where("token < alike").select("token", "alike")
    both = near.unionByName(same)
    return both.unionByName(both.select(F.col("alike").alias("token"), F.col("token").alias("alike"))).unionByName(tokens.select("token", F.col("token").alias("alike"))).distinct()


def _written(token: Column) -> Column:
    return (F.length(token) > 1) & ~F.startswith(token, F.lit("~"))


def _candidates(each: DataFrame, alike: DataFrame, frequency: DataFrame) -> DataFrame:
    """each(key, body, token), alike(token, alike), frequency(token, common) -> (key_a, key_b, body) to be verified.

    A key asks for the tokens alike its own, and answers with its own; where the token is common both name a second one:
    the asking side what its other tokens may stand for, the answering side what its others may be called. Initials ask
    only where a key has no second written-out token, so nothing is paired by a common token and a letter alone.
    """
    tokens = each.where(_written(F.col("token"))).join(frequency, "token")
    known = alike.join(frequency.select(F.col("token").alias("alike"), "common"), "alike")
    asks = tokens.drop("common").join(known, "token").select("key", "body", F.col("token").alias("own"), F.col("alike").alias("token"), "common")
    full = F.coalesce(F.create_map(*[x for k, v in sorted(_FULL.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("other")], F.array().cast("array<string>"))
    letter = F.concat(F.lit("="), F.substring(F.regexp_replace("other", "^~", ""), 1, 1))
    others = each.withColumnRenamed("token", "other")
    written = _written(F.col("other"))
    count = others.groupBy("key", "body").agg(F.count_if(written).alias("n_written"))
    # what a key's other tokens stand for: tokens alike them or their full names; the beginning of a body's word; an initial
    stand = others.where(written).select("key", "body", "other", F.explode(F.concat(F.array("other"), full)).alias("token"))
    meant = stand.join(alike, "token").select("key", "body", "other", F.col("alike").alias("second")).unionByName(stand.select("key", "body", "other", F.col("token").alias("second")))
    begun = others.where(F.col("body") & written).select("key", "body", "other", F.explode(F.array(letter, F.substring("other", 1, 4))).alias("second"))
    initial = others.where(~F.col("body") & ~written).join(count.where("n_written < 2").select("key", "body"), ["key", "body"], "left_semi").select("key", "body", "other", letter.alias("second"))
    asked = meant.unionByName(begun).unionByName(initial).distinct()
    # what a key's other tokens may be called: themselves, their full names, their beginnings, their first letters
    begins = F.when(F.length("other") >= 4, F.transform(F.sequence(F.lit(2), F.length("other") - 2), lambda i: F.substring("other", F.lit(1), i))).otherwise(F.array().cast("array<string>"))
    letters = F.transform(F.concat(F.array(F.regexp_replace("other", "^~", "")), full), lambda f: F.concat(F.lit("="), F.substring(f, 1, 1)))
    called = F.when(written, F.concat(F.array("other"), full, begins, letters)).otherwise(letters)
    answered = others.select("key", "body", "other", F.explode(F.array_distinct(called)).alias("second"))
    # a key of one token stands alone
    alone = count.where("n_written = 1").join(others.where(~written).select("key", "body"), ["key", "body"], "left_anti").select("key", "body")
    hot_asks = asks.where("common").join(asked, ["key", "body"]).where("own <> other").select("key", "body", "token", "second").unionByName(asks.where("common").join(alone, ["key", "body"], "left_semi").select("key", "body", "token", F.lit("*").alias("second")))
    hot = tokens.where("common")
    hot_answers = hot.join(answered, ["key", "body"]).where("token <> other").select("key", "body", "token", "second").unionByName(hot.select("key", "body", "token", F.lit("*").alias("second")))
    a = hot_asks.unionByName(asks.where("not common").select("key", "body", "token", F.lit("").alias("second"))).distinct()
    b = hot_answers.unionByName(tokens.where("not common").select("key", "body", "token", F.lit("").alias("second")))
    a = materialise(a, "asks").withColumnRenamed("key", "x")
    b = materialise(b, "answers").withColumnRenamed("key", "y")
    met = a.join(b, ["body", "token", "second"]).where("x <> y")
    return met.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "body").distinct()


def link_names(spellings: DataFrame) -> DataFrame:
    """spellings(spelling) -> (spelling, entity): the same entity for all spellings of one person or body.

    Null, blank and punctuation-only spellings are left out; repeated ones count once. The entity is the least key
    among its spellings.
    """
    distinct = spellings.select("spelling").where("spelling is not null").distinct()
    parsed = materialise(distinct.mapInPandas(_parse, "spelling string, key string, tokens array<string>, body boolean"), "names")
    keys = parsed.groupBy("key", "body").agg(F.first("tokens").alias("tokens"))
    each = keys.select("key", "body", F.explode("tokens").alias("token"))
    df = each.groupBy("token").agg(F.count("*").alias("df"))
    n = keys.count()
    common = math.log1p(n / COMMON_KEYS)
    rarity = materialise(df.withColumn("r", F.log1p(F.lit(float(n)) / F.col("df"))), "rarity")
    alike = materialise(_alike_tokens(rarity.where(_written(F.col("token"))).select("token")), "alike")
    # a mistyped token weighs as the commonest one an edit away, a short form as its full name
    full = F.create_map(*[F.lit(x) for k, v in sorted(_FULL.items()) for x in (k, v[0])])
    own = rarity.select("token", "r").unionByName(rarity.select("token", full[F.col("token")].alias("of")).where("of is not null").join(rarity.select(F.col("token").alias("of"), "r"), "of").select("token", "r"))
    others = alike.join(rarity.select(F.col("token").alias("alike"), "r"), "alike").select("token", "r")
    weight = own.unionByName(others).groupBy("token").agg(F.min("r").alias("w"))
    weighed = each.join(rarity.select("token", "r"), "token").join(weight, "token").withColumn("w", F.when(~_written(F.col("token")), F.lit(0.5)).otherwise(F.col("w")))
    whole = materialise(weighed.groupBy("key", "body").agg(F.sort_array(F.collect_list(F.struct("w", "token", "r")), asc=False).alias("order")), "keys")
    whole = whole.select("key", "body", F.col("order.token").alias("tokens"), F.col("order.w").alias("weights"), F.col("order.r").alias("rarity"))
    candidates = _candidates(materialise(each.distinct(), "tokens"), alike, rarity.select("token", (F.col("df") > COMMON_KEYS).alias("common")))
    a = whole.select(F.col("key").alias("key_a"), "body", *[F.col(c).alias(f"{c}_a") for c in ("tokens", "weights", "rarity")])
    b = whole.select(F.col("key").alias("key_b"), "body", *[F.col(c).alias(f"{c}_b") for c in ("tokens", "weights", "rarity")])
    verified = candidates.join(a, ["key_a", "body"]).join(b, ["key_b", "body"]).mapInPandas(_verify(common), "key_a string, key_b string, similarity double")
    verified = materialise(verified, "verified")
    # a person's key with no second written-out token hangs on an initial
    initial = whole.where((~F.col("body")) & (F.size(F.filter("tokens", _written)) < 2)).select(F.col("key").alias("v"))
    full = whole.join(initial, whole["key"] == initial["v"], "left_anti").select(F.col("key").alias("v"))
    edges = verified.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    sure = edges.join(full.withColumnRenamed("v", "a"), "a", "left_semi").join(full.withColumnRenamed("v", "b"), "b", "left_semi")
    groups = components(full, sure)
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hung = ends.join(initial.withColumnRenamed("v", "a"), "a", "left_semi").join(groups.select(F.col("v").alias("b"), "component"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("component"), F.max("component").alias("other")).where("component = other").select("v", "component")
    told = groups.unionByName(hung)
    # initials without a full name, or with several, hold together among themselves
    loose = materialise(initial.join(hung, "v", "left_anti"), "loose")
    among = edges.join(loose.withColumnRenamed("v", "a"), "a", "left_semi").join(loose.withColumnRenamed("v", "b"), "b", "left_semi")
    entity = told.unionByName(components(loose, among))
    return parsed.select("spelling", "key").join(entity, parsed["key"] == entity["v"]).select("spelling", F.col("component").alias("entity"))


def pairs_of_spellings(linked: DataFrame) -> DataFrame:
    """(name_a, name_b) of differing spellings of one entity, name_a < name_b by code point."""
    a = linked.select("entity", F.col("spelling").alias("name_a"))
    b = linked.select("entity", F.col("spelling").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
