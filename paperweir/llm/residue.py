"""Template residue, filler, error pages and script notices in extracted text.

Units (lines of Markdown, sentences of flat text, code left out) are reduced to their frame: the ordinary words in
their order, what stands between them (names, numbers, placeholders) being left out. Units of the same frame are aligned
over the corpus by its hash; a place at which many records have differing fillings is a slot, and a unit is residue
where such a slot holds a variable's name, a default or a blank. Units with known placeholders, defaults, filler and
messages are residue without that. Whole pages are reduced alike, and a short page is residue where its template is one
of error messages and notices or is repeated over many differing texts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweir.session import materialise

#: What a whole page of a message is: at most so many words. Its template counts as repeated from so many differing texts on.
SHORT_WORDS, REPEATED = 60, 8
#: Ordinary words that a frame has at least, and the most; share of a frame's units up to which a slot left blank is residue.
FRAME_WORDS, LONGEST_FRAME, BLANK_SHARE = 3, 80, 0.2
#: Letters outside the slots that the template of a repeated page has at least.
FIXED_LETTERS = 6

# Shapes of placeholders in template languages and in drafts.
PLACEHOLDERS = [
    r"\{\{[^{}]{0,80}\}\}\}?",  # {{name}}
    r"\{%[^%]{0,80}%\}",  # {% block %}
    r"<%[^%]{0,80}%>",  # <%= yield %>
    r"\$\{[^{}]{1,60}\}",  # ${name}
    r"(?<![\w$])\$[A-Z][A-Z_]{2,30}\$",  # $DATE$
    r"%%\w{2,40}%%",  # %%NAME%%
    r"@@\w{2,40}@@",  # @@INTRO@@
    r"(?<![\w_])__[A-Z][A-Z_]{1,30}__(?![\w_])",  # __TITLE__
    r"<<[^<>\n]{1,40}>>",  # <<NAME>>
    r"\[\[\s?\w{1,30}\s?\]\]",  # [[body]]
    r"\{[A-Z_]{2,30}\|[^{}]{0,30}\}",  # {FNAME|there}
    r"(?<![\w$}])\{[a-z_]{1,30}\}",  # {category}
    r"\\?\[[A-Z][A-Z0-9 _\-]{2,40}\\?\](?!\()",  # [CITY NAME]
    r"\\?\[(?i:insert [^\]\n]{1,40}|body text|headline|title|subtitle|your [^\]\n]{1,30}|quote from [^\]\n]{1,30}|author name|image caption|text here|caption|summary|name|date|link|placeholder)\\?\](?!\()",
    r"\[object Object\]",
    r"\((?i:title|text|name|date|author|tbd) (?i:tbd|tba|tbc|to come|here)\)",
]
PLACEHOLDER = re.compile("|".join(PLACEHOLDERS))
# Values that a slot has when nothing was put in, and notes that stand for text to be written.
DEFAULTS = re.compile(
    r"^(?:undefined|null|NaN|None)\b(?!-)(?=\s(?:said|wrote|min\b|ago|undefined|null|by\b|was\b|is\b|in\b|of\b)|\s*[.,!?;:]|\s*$)|\b(?:by|by the|from|of|Dear|Hello|Hi|was|on) (?:undefined|null|NaN)(?=\s*(?:[.,!?]|$))"
    r"|^(?:undefined|null|NaN)(?:\s+(?:undefined|null|NaN|min read))*$"
    r"|\bXX+ (?:percent|per cent|people|euros|dollars|crowns|times|years|years old|votes)\b|^(?:TODO|TK|FIXME|TBD|TKTK)\b\s*[:\-–]|\bTK TK\b|^TK$"
)
# The common words of Latin filler text.
FILLER_WORDS = set("""
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim
ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa
qui officia deserunt mollit anim id est laborum
""".split())
# Filler and messages that stand for a text or within one; each a whole unit from its beginning.
FILLER = re.compile(
    r"(?i)^(?:add your text here|click to edit|your (?:headline|text|title) goes here|insert (?:body copy|text)|sample (?:paragraph|text) [–\-]|description placeholder|content (?:coming soon|will be added)|coming soon\W*(?:$|content)"
    r"|this is a test post|text text text|(?:xxxxx\s*){2,}|(?:asdf\s*){2,}|hier steht ihr|dies ist ein platzhalter|escriba aquí su texto|texto de ejemplo|insira seu texto|votre texte ici|ceci est un texte de remplissage"
    r"|здесь будет ваш текст|это текст-заполнитель|sem vložte|zde bude text|toto je zástupný)"
)
NOTICE = re.compile(
    r"(?i)^(?:please |you need to |you must |to (?:read|view|see)[^.]{0,60}, )?(?:enable|turn on|switch on|activate|allow) (?:java\s?script|scripts?)\b(?! (?:that|which))"
    r"|^(?:please |you need to )(?:enable|turn on|activate|allow)(?: your)? (?:java\s?script|scripts)\b|^you must have (?:java\s?script|scripts) (?:enabled|turned on)|^java\s?script (?:is disabled|must be|is required|is turned off)"
    r"|^this (?:video|page|site|app|map|chart|form|poll|content|gallery)[^.]{0,30} (?:requires|needs) (?:a browser with )?(?:java\s?script|scripts)\b|^to (?:read|view|see)[^.]{0,60}, turn on (?:java\s?script|scripts)|^your browser is not supported|^please (?:switch to a supported browser|upgrade (?:it|your browser))"
    r"|^loading\s?(?:…|\.\.\.)|^the (?:chart|map|video|image|poll|comments?|content|page) could not be loaded\b|^if this takes long, enable"
    r"|^(?:ce site|cette page|ce contenu) (?:requiert|nécessite|a besoin de) javascript|^(?:diese seite|dieser inhalt) (?:benötigt|erfordert) javascript|^(?:este sitio|esta página|este conteúdo|este site) (?:requiere|necesita|requer|exige|precisa de) javascript|^(?:этот сайт|эта страница) требует javascript|^(?:tato stránka|tento web) vyžaduje javascript"
    r"|^bitte aktivieren sie javascript|^veuillez activer javascript|^active javascript para|^ative o javascript|^включите javascript|^zapněte prosím javascript|^active el javascript|^aktivieren sie javascript"
)
ERROR = re.compile(
    r"(?i)^(?:(?:error|http(?: error)?|fehler|erreur|erro|ошибка|chyba)\s?:?\s?[45]\d\d\b|[45]\d\d\s?[:\-–|]?\s(?:not found|forbidden|unauthorized|internal server|bad (?:gateway|request)|service (?:temporarily )?unavailable|too many|gateway|error|moved|gone)|(?:the )?page (?:not found|introuvable|could ?n[o’']t be found)"
    r"|w?h?oops(?=\s*(?:$|[!,…:–\-]|\.{3}))|access denied|you don[’']t have permission|that page can|something went wrong|we[’']ll be back|down for maintenance|scheduled maintenance|gateway time-?out|rate limit exceeded|your session has expired|application error|internal server error"
    r"|error establishing|sqlstate|fatal error:|warning: invalid|traceback \(most recent|java\.lang\.|just a moment(?=\s*(?:$|[!…]|\.))|checking your browser|verify you are human|one more step|ray [0-9a-f]{4,} ·|seite nicht gefunden|página no encontrada|página não encontrada|страница не найдена|stránka ne)"
)
# Words that make a message of a short page whatever its template says first.
MESSAGE = re.compile(r"(?i)not found|could not be completed|try again (?:later|in a)|permission|blocked by the owner|incident id|reference #|at this location|moved or never existed|front page|were looking for|keyerror|on line \d|undefined function|connection refused|contact the administrator|error id|upgrading our servers|being updated|log in again|quota for this key|retry after|this process is automatic|cookies must be|complete the puzzle")

# the same where no unit begins: match() looks at one place, so the beginning of the text is not asked for
_NOTICE_HERE, _DEFAULTS_HERE = (re.compile(p.pattern.replace("|^", "|").replace("(?i)^", "(?i)").removeprefix("^")) for p in (NOTICE, DEFAULTS))

# Shapes of variables' names and values of empty variables, looked for in slots alone.
VARIABLE = re.compile(
    r"%\(\w+\)[a-z]\b|(?<![\w%])%(?:\d+\$)?[sd]\b|(?<!\w)%[A-Za-z_]\w*%|\{+[^{}\n]{0,60}\}+|(?<!\w)\$[a-z_]\w+|<[A-Z][A-Z_ ]+>|<[a-z]+_[a-z_]+>|(?<!\w)#[A-Za-z_]\w*#"
    r"|\[[a-z]+_[a-z_]+\]|(?<![\w/.\-])[a-z]+(?:_[a-z0-9]+)+(?![\w/.\-])"
)
EMPTY = frozenset("undefined null NaN nan nil None N/A n/a TBD TBA TODO TK TKTK FIXME XX XXX XXXX".split())

_FENCE = re.compile(r"^(```|~~~).*?^\1[^\n]*$|^(```|~~~).*\Z", re.S | re.M)
_INLINE = re.compile(r"`[^`\n]+`")
_PRE = re.compile(r"<(pre|code)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_NAMES = re.compile(r"\b[A-Z][a-zà-ÿ]{4,}\b|\b[0-9a-f]{6,}\b|\d+")
_WORD = re.compile(r"[^\W\d_]+")
_MAYBE = re.compile(r"[{}%$@\[\]<>_]|undefined|null|NaN|None|TODO|TK|FIXME|TBD|XX|tbd", re.A)
_TRIGGER = re.compile(r"(?:^|(?<= ))(?:Please |You (?:must|need)|Java[Ss]cript |This (?:video|page|site|app|map|chart|form|poll|content|gallery)|To (?:read|view|see) |Your browser|Loading|The (?:chart|map|video|image|poll|comment|content|page)|If this takes|Bitte akt|Veuillez|Acti?v|Ative|Включите|Zapněte|TODO|TK\b|TBD|FIXME|XX|undefined|null|NaN)")
_LOREM = re.compile(r"\bLorem ipsum dolor sit amet, ")
_LINK = re.compile(r"(?<!!)\[([^\]\[]*)\]\([^)\s]*\)")
_EMPHASIS = re.compile(r"\*{1,2}(?=\w)|(?<=[\w.,])\*{1,2}")
_LEADS = frozenset("#>*-+ 0123456789")
_LEAD = re.compile(r"^(?:[>#*\-+\s]|\d+[.)]\s)+")


def without_code(body: str | None) -> str:
    return _INLINE.sub(" ", _FENCE.sub("\n", body or "")) if body and "`" in body or body and "~~~" in body else body or ""


def code_texts(cleaned_html: str | None) -> list[str]:
    """Flat texts of the code in a page, longest first."""
    if not cleaned_html or "<" not in cleaned_html:
        return []
    found = {" ".join(html.unescape(_TAG.sub("", m[2])).split()) for m in _PRE.finditer(cleaned_html)}
    return sorted((x for x in found if x), key=len, reverse=True)


def is_filler(text: str) -> bool:
    """Latin filler: most words are of it, and several different ones."""
    words = [w.lower() for w in _WORD.findall(text)]
    if len(words) < 5:
        return False
    hits = [w for w in words if w in FILLER_WORDS]
    return len(hits) >= 0.8 * len(words) and len(set(hits)) >= 5


def unit_kind(unit: str) -> str | None:
    """What residue a unit is or holds, None where it is ordinary text."""
    if unit[:1] in _LEADS:
        unit = _LEAD.sub("", unit).strip()
    if not unit:
        return None
    if _MAYBE.search(unit):
        if PLACEHOLDER.search(unit):
            return "placeholder"
        if DEFAULTS.search(unit):
            return "default"
    if FILLER.match(unit):
        return "filler"
    first = unit.split(None, 6)[:6]
    if len([w for w in first if w.lower().strip(",.") in FILLER_WORDS]) >= 4 and is_filler(unit):
        return "filler"
    if NOTICE.match(unit):
        return "notice"
    if ERROR.match(unit):
        return "error"
    return None


def flat_kind(flat: str) -> str | None:
    """What residue stands in flat text after a heading, where no sentence ends before it."""
    for m in _TRIGGER.finditer(flat):
        if _NOTICE_HERE.match(flat, m.start()):
            return "notice"
        if _DEFAULTS_HERE.match(flat, m.start()):
            return "default"
    return "filler" if "orem ipsum dolor" in flat and _LOREM.search(flat) else None


def template(unit: str) -> str:
    """The unit with slots for what varies."""
    return " ".join(_NAMES.sub("▯", PLACEHOLDER.sub("▯", unit)).split()).lower()


_EDGES = ".,;:!?…\"“”„«»‘’()'*_–—-¶|#>"
_SHAPED = re.compile(r"[{}%$<_#\[]")
_VARIABLE_MARK = "\ue000"
#: What fills a slot.
FILLED, NAMED, DEFAULT = 0, 1, 2


def frames(unit: str) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(frame, its fillings (place, what fills, text)) of the unit, the place being the number of frame words before.

    The first word may belong to the frame or be a filling; where both may be, both are given.
    """
    if _SHAPED.search(unit):
        unit = VARIABLE.sub(f" {_VARIABLE_MARK} ", unit)
    words: list[str] = []
    fills: dict[int, tuple[int, str]] = {}
    first = ""
    lower_first = False
    for k, token in enumerate(unit.split()):
        core = token if token.isalpha() else token.strip(_EDGES)
        if not core:
            continue
        plain = core if core.isalpha() else core.replace("’", "").replace("'", "").replace("-", "")
        if plain.isalpha() and core not in EMPTY:
            if plain.islower() or not words and not fills and not first and plain[1:].islower():
                if plain.islower():
                    lower_first = lower_first or not words and not fills and not first
                    words.append(core)
                else:
                    first = core
                continue
        kind = NAMED if core == _VARIABLE_MARK else DEFAULT if core in EMPTY and (k or core != "None") else FILLED
        if kind == FILLED and not any(c.isalnum() for c in core):
            continue
        place = len(words)
        had = fills.get(place)
        fills[place] = (max(kind, had[0]), f"{had[1]} {core}") if had else (kind, core)
        if len(words) > LONGEST_FRAME:
            return []
    if len(words) < FRAME_WORDS or len(words) > LONGEST_FRAME:
        return []
    frame = " ".join(words)
    if not first:
        out = [(frame, [(p, k, t) for p, (k, t) in fills.items()])]
        # a unit that begins with a filling is also aligned with those that begin with a name
        return out if lower_first or 0 not in fills else [*out, (f"▯ {frame}", out[0][1])]
    with_first = (f"{first.lower()} {frame}", [(p + 1, k, t) for p, (k, t) in fills.items()])
    k, t = fills.get(0, (FILLED, ""))
    as_filling = (f"▯ {frame}", [(0, k, f"{first} {t}"), *((p, k, t) for p, (k, t) in fills.items() if p)])
    return [with_first, as_filling]


def page_kind(text: str) -> str | None:
    """What a whole short page is, None where it is not short or not known as a message."""
    words = text.split()
    if len(words) > SHORT_WORDS:
        return None
    if ERROR.search(text) or MESSAGE.search(text):
        return "error"
    return None


def units_of(text: str | None, markdown: bool, code: list[str]) -> list[str]:
    if not text:
        return []
    if markdown:
        plain = without_code(text)
        if "](" in plain:
            plain = _LINK.sub(r"\1", plain)
        if "*" in plain:
            plain = _EMPHASIS.sub("", plain)
        return [s for line in plain.split("\n") if line.strip() for s in _SENTENCE.split(line.strip())]
    flat = " ".join(text.split())
    for c in code:
        flat = flat.replace(c, " ¶. ")
    return [s for s in _SENTENCE.split(flat) if s]


def judge(text: str | None, markdown: bool, code: list[str]) -> tuple[list[tuple[str, str]], str | None, list[str]]:
    """((kind, template) of each residual unit, template of the page where it is short, the other units)."""
    units = units_of(text, markdown, code)
    kinds = [(u, unit_kind(u)) for u in units]
    found = [(k, template(u)) for u, k in kinds if k]
    whole = " ".join(units)
    if not found and not markdown and (k := flat_kind(whole)):
        found = [(k, k)]
    if not found and (k := page_kind(whole)):
        found = [(k, template(whole))]
    short = template(whole) if 0 < len(whole.split()) <= SHORT_WORDS else None
    return found, short, [u for u, k in kinds if not k]


_JUDGED = "id string, field_name string, units array<struct<kind:string,template:string>>, page string, text long, frames array<struct<key:long,frame:string,fills:array<struct<place:int,kind:int,filling:long>>>>"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    kind = pa.list_(pa.struct([("kind", pa.string()), ("template", pa.string())]))
    fill = pa.list_(pa.struct([("place", pa.int32()), ("kind", pa.int32()), ("filling", pa.int64())]))
    framed = pa.list_(pa.struct([("key", pa.int64()), ("frame", pa.string()), ("fills", fill)]))
    digest = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)
    for batch in batches:
        ids, fields, units, pages, texts, aligned = [], [], [], [], [], []
        for i, flat, body, cleaned in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "body", "html")), strict=True):
            code = code_texts(cleaned)
            for field, text in (("sourceText", flat), ("body", body)):
                if not text or not text.strip():
                    continue
                found, short, others = judge(text, field == "body", code)
                ids.append(i)
                fields.append(field)
                units.append([{"kind": k, "template": t} for k, t in found])
                pages.append(short)
                texts.append(digest(" ".join(text.split())) if short else None)
                aligned.append([{"key": digest(f), "frame": f, "fills": [{"place": p, "kind": k, "filling": digest(t)} for p, k, t in fills]} for u in others for f, fills in frames(u)])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(fields, pa.string()), pa.array(units, kind), pa.array(pages, pa.string()), pa.array(texts, pa.int64()), pa.array(aligned, framed)], names=["id", "field_name", "units", "page", "text", "frames"])


class Residue:
    """judged: the records with the templates found in them and the frames of their other units."""

    def __init__(self, records: DataFrame):
        """records(id, text, body, html): flat text, Markdown and the HTML of one page. Null and blank values are no cases."""
        self.judged = materialise(records.select("id", "text", "body", "html").mapInArrow(_judge, _JUDGED), "judged")

    def repeated_pages(self) -> DataFrame:
        """(page, n) of the whole-page templates with fixed words that many differing texts of one field have; copies count once."""
        fixed = F.length(F.regexp_replace("page", r"\P{L}", "")) >= FIXED_LETTERS
        counted = self.judged.where(F.col("page").isNotNull() & fixed).groupBy("page", "field_name").agg(F.count_distinct("text").alias("n"))
        return counted.groupBy("page").agg(F.max("n").alias("n")).where(F.col("n") >= REPEATED)

    def slots(self) -> DataFrame:
        """(key, place, n_filled): the places of frames that differing fillings of many records stand at; copies count once."""
        fills = self.judged.select("id", F.inline("frames")).select(F.xxhash64("id").alias("record"), "key", F.inline("fills")).where(F.col("kind") == FILLED)
        each = fills.groupBy("key", "place", "filling").agg(F.count("*").alias("n"), F.min("record").alias("record"))
        counted = each.groupBy("key", "place").agg(F.count("*").alias("fillings"), F.count_distinct("record").alias("records"), F.sum("n").alias("n_filled"))
        return counted.where((F.col("fillings") >= REPEATED) & (F.col("records") >= REPEATED)).select("key", "place", "n_filled")

    def unfilled(self) -> DataFrame:
        """(id, field_name, kind, key) of units with a slot that holds a variable's name, a default or a blank.

        Units move with the key of their frame and what fills its places, not with their words.
        """
        held = F.transform("fills", lambda f: F.struct(f["place"].alias("place"), f["kind"].alias("kind")))
        units = self.judged.select("id", "field_name", F.inline("frames")).select("id", "field_name", "key", held.alias("fills"))
        here = F.try_element_at(F.filter("fills", lambda f: f["place"] == F.col("place")), F.lit(1))["kind"]
        placed = units.join(self.slots(), "key").select("id", "field_name", "key", "place", "n_filled", here.alias("held"))
        open_ = materialise(placed.where(F.col("held").isNull() | (F.col("held") != FILLED)), "open")
        blanks = open_.where("held is null").groupBy("key", "place", "n_filled").agg(F.count("*").alias("n"))
        rare = blanks.where(F.col("n") <= BLANK_SHARE * (F.col("n") + F.col("n_filled"))).select("key", "place")
        kind = F.when(F.col("held") == NAMED, "placeholder").otherwise("default")
        named = open_.where("held is not null").select("id", "field_name", kind.alias("kind"), "key")
        blank = open_.where("held is null").join(rare, ["key", "place"], "left_semi").select("id", "field_name", F.lit("blank").alias("kind"), "key")
        return named.unionByName(blank)

    def found(self) -> DataFrame:
        """(id, field_name) of every value that is residue or holds some."""
        some = self.judged.where(F.size("units") > 0).select("id", "field_name")
        pages = self.judged.where((F.size("units") == 0) & F.col("page").isNotNull()).join(self.repeated_pages(), "page", "left_semi").select("id", "field_name")
        return some.unionByName(pages).unionByName(self.unfilled().select("id", "field_name")).distinct()

    def templates(self) -> DataFrame:
        """(kind, template, n_records): the aligned templates whose slots or texts are residue."""
        slots = self.unfilled()
        wanted = slots.select("key").distinct()
        frames = self.judged.select(F.inline("frames")).select("key", F.col("frame").alias("template")).join(wanted, "key", "left_semi").dropDuplicates(["key"])
        units = self.judged.select("id", F.inline("units")).unionByName(slots.join(frames, "key").select("id", "kind", "template"))
        return units.groupBy("kind", "template").agg(F.count_distinct("id").alias("n_records"))
