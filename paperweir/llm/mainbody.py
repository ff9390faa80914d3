"""Main content of web pages by tag-path ratios.

A page is read once into blocks, each with its path: the names of the elements from the root to it, the tag of the block
last. Text length and punctuation are summed by path, fused into one score, smoothed with the neighbouring paths (other
leaves of the same elements, and the elements above), and the paths above a threshold are content. Standing lines of a
site, which no path tells from the article, are found by counting each line over the site's pages, copies of one article
once (pre-aggregated, hashes only), and taken out with what hangs on them: lists under a standing heading, bylines,
teasers. The views of one page (raw and extracts) are judged together: a block of an extract that the raw page holds is
main where it is main there. Pages are read on the scan; what is shuffled are block numbers and hashes.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweir.llm import residue
from paperweir.session import materialise

#: A line stands where so many pages of its site have it, and this share of them, as lines of bodies do.
LEAST_PAGES, SHARE = 4, 0.2
#: A path is content from this part of the best path's score on.
THRESHOLD = 0.35
#: What a path takes over from other leaves of the same elements, and from the elements above.
FROM_LEAVES, FROM_ABOVE = 0.5, 0.05

BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote figcaption".split())
CONTAINERS = frozenset("div section article main aside header footer nav td th form body table center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_OPEN = r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*+)"
# a tag whose quotes never end is matched up to its name; from there on quotes are not minded, so that no page is read twice
_TOKEN = re.compile(_OPEN + r"(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?=(.)))", re.S | re.I)
_PLAIN = re.compile(_OPEN + r"(?:([^>]*+)>|(?=(.)))", re.S | re.I)


def _tokens(page: str) -> Iterator[re.Match]:
    """Tags, comments and scripts, in time linear in the page."""
    at = 0
    for pattern in (_TOKEN, _PLAIN):
        for m in pattern.finditer(page, at):
            if m[5] is not None:
                if pattern is _PLAIN:  # no more > at all
                    return
                at = m.start()
                break
            yield m
        else:
            return


_NAME = re.compile(r"\b(?:class|id)\s*=\s*[\"']?([^\"'>]*)", re.I)
_PUNCT = re.compile(r"[.,;:!?。，；：！？]")
_DIGITS = re.compile(r"\d+")
_NOT_ASCII_LETTER = re.compile(r"[^a-z0]+")
# What begins the line that names the author, and what ends a teaser.
_BYLINE = re.compile(r"(?i)^(?:by|von|par|por|de|autor|autora|author|text|texte|автор|текст|written by)\b:?\s+(?:dr\.? |the )?[^\W\d_]")
_DATE_LINE = re.compile(r"(?i)^(?:published|updated|posted|publié|veröffentlicht|publicado|опубликовано|vydáno|zveřejněno|publikováno|last (?:updated|checked))\b.{0,12}\d")
_TEASER = re.compile(r"(?:→|»|›|\.\.\.more|read more|weiterlesen|lire la suite|leer más|leia mais|читать дальше|číst dál)\s*$", re.I)
_ROLE = re.compile(r"(?i)\b(?:byline|author|promo|teaser|related|share|social|comments?|advert|ad|cookie|consent|cc|nav|menu|breadcrumbs?|sidebar|footer|newsletter|subscribe)\b")
_SIDE = frozenset("nav header footer aside form".split())


class Block:
    __slots__ = ("own", "path", "leaf", "role", "tag", "text", "links", "inner", "main", "where")

    def __init__(self, tag: str, path: int, role: bool, where: int):
        self.tag, self.path, self.role, self.where = tag, path, role, where
        self.text: list[str] = []
        self.links = 0
        self.inner = False
        self.main = False
        self.own = self.leaf = ""


def line_key(text: str) -> str:
    """Normal form of a line for counting: case, white space, digits and, in mostly Latin text, other letters don't matter."""
    n = _DIGITS.sub("0", " ".join(text.split()).lower())
    plain = _NOT_ASCII_LETTER.sub("", n)
    return plain if len(plain) >= 8 and 2 * len(plain) > len(n) else n


def read_blocks(page: str) -> tuple[list[Block], list[tuple[str, int, bool]]]:
    """(blocks in order of their start tags, containers as (name, parent, on the side))."""
    containers: list[tuple[str, int, bool]] = [("", -1, False)]
    stack = [0]
    tags = [""]
    blocks: list[Block] = []
    open_blocks: list[Block] = []
    in_link, at = 0, 0
    for m in _tokens(page):
        start = m.start()
        if start > at and open_blocks:
            text = page[at:start]
            open_blocks[-1].text.append(text)
            if in_link:
                open_blocks[-1].links += len(text)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        closing = m[2]
        if tag in BLOCKS:
            if closing:
                for k in range(len(open_blocks) - 1, -1, -1):
                    if open_blocks[k].tag == tag:
                        del open_blocks[k:]
                        break
                continue
            # a new paragraph or heading ends an open one, a new item an open item
            if tag != "p" or open_blocks and open_blocks[-1].tag != "blockquote":
                while open_blocks and open_blocks[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "pre"):
                    open_blocks.pop()
            if tag == "li":
                for k in range(len(open_blocks) - 1, -1, -1):
                    if open_blocks[k].tag == "li" and open_blocks[k].where == stack[-1]:
                        del open_blocks[k:]
                        break
            attributes = m[4]
            role = bool(attributes and (n := _NAME.search(attributes)) and _ROLE.search(n[1]))
            if open_blocks:
                open_blocks[-1].inner = True
            b = Block(tag, stack[-1], role, stack[-1])
            blocks.append(b)
            open_blocks.append(b)
        elif tag in CONTAINERS or tag in ("ul", "ol", "figure"):
            lists = tag in ("ul", "ol", "figure")
            if not closing:
                if not lists or open_blocks and open_blocks[-1].tag != "li":
                    while open_blocks and open_blocks[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                        open_blocks.pop()
                attributes = m[4]
                n = _NAME.search(attributes) if attributes else None
                name = f"{tag}.{n[1]}" if n else tag
                if lists and not (n and _ROLE.search(n[1])):
                    stack.append(stack[-1])  # a plain list belongs to its container
                    tags.append(tag)
                    continue
                side = tag in _SIDE or bool(n and _ROLE.search(n[1])) or containers[stack[-1]][2]
                containers.append((name, stack[-1], side))
                stack.append(len(containers) - 1)
                tags.append(tag)
            else:
                for k in range(len(tags) - 1, 0, -1):
                    if tags[k] == tag:
                        del tags[k:], stack[k:]
                        open_blocks = [b for b in open_blocks if b.where in stack]
                        while open_blocks and lists and open_blocks[-1].tag == "li" and tag in ("ul", "ol") and "ul" not in tags and "ol" not in tags:
                            open_blocks.pop()
                        break
                    if tags[k] in ("table", "td", "body", "article", "main") and tag in ("ul", "ol", "figure", "div") and tags[k] != "td":
                        break
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br" and open_blocks:
            open_blocks[-1].text.append(" ")
    for b in blocks:
        raw = "".join(b.text)
        b.own = entities.unescape(raw) if "&" in raw else raw
        if b.tag != "pre":
            b.own = " ".join(b.own.split())
    return blocks, containers


def select_content(blocks: list[Block], containers: list[tuple[str, int, bool]]) -> None:
    """Sets main of the blocks on content paths."""
    known: dict[tuple[int, str], int] = {}
    path: list[int] = []  # of each element: elements with the same names from the root share it
    above, side = [], []
    for name, parent, aside in containers:
        key = (path[parent] if parent >= 0 else -1, name)
        if key not in known:
            known[key] = len(known)
            above.append(key[0])
            side.append(aside)
        path.append(known[key])
    n = len(known)
    heading = [False] * n
    title = False
    ratios: dict[tuple[int, str], list[float]] = {}  # of each leaf path: length, punctuation
    for b in blocks:
        b.path = path[b.path]
        b.leaf = "h" if b.tag in HEADINGS else b.tag
        if b.tag == "h1" and not title and not side[b.path]:
            heading[b.path] = title = True
        r = ratios.setdefault((b.path, b.leaf), [0.0, 0.0])
        size = max(0, len(b.own) - b.links)
        if b.leaf != "h" and size:
            r[0] += size
            r[1] += len(_PUNCT.findall(b.own)) if size > 25 else 0
    # fuse: length times punctuation, so that lists of links and labels weigh little
    score = {(k, leaf): (length * (1.0 + marks)) ** 0.5 * (0.3 if side[k] else 1.0) * (2.0 if heading[k] else 1.0) for (k, leaf), (length, marks) in ratios.items()}
    whole = [0.0] * n
    for (k, _), x in score.items():
        whole[k] += x
    smooth = {(k, leaf): x + FROM_LEAVES * (whole[k] - x) + FROM_ABOVE * (whole[above[k]] if above[k] >= 0 else 0.0) for (k, leaf), x in score.items()}
    # what a path takes over does not make it the best
    best = max(((smooth[p], p) for p, x in score.items() if x > 0), default=(0.0, None))
    if best[1] is None:
        return
    top = best[1][0]
    content = {p for p, x in smooth.items() if p[0] == top and x >= THRESHOLD * best[0] and not side[top]}
    # boxes inside the content that hold code alone belong to it
    leaves: dict[int, set[str]] = {}
    for k, leaf in smooth:
        leaves.setdefault(k, set()).add(leaf)
    content |= {(k, "pre") for k, own in leaves.items() if own == {"pre"} and above[k] == top and not side[k]}
    for b in blocks:
        b.main = (b.path, b.leaf) in content


_BLOCK = pa.struct([("n", pa.int32()), ("h", pa.int64()), ("tag", pa.int8()), ("state", pa.int8())])
_VIEW = pa.struct([("view", pa.string()), ("blocks", pa.list_(_BLOCK))])
_PAGE = "id string, views array<struct<view:string,blocks:array<struct<n:int,h:long,tag:tinyint,state:tinyint>>>>, message boolean, text long"
#: Letters from which a main block tells one article from another; shorter ones do so only on pages without longer ones.
LONG_BLOCK = 90
#: state of a block: 0 outside the content, 1 main so far, 2 taken out by what it says (byline, teaser, link), 3 empty.
_TAG_NUMBER = {t: i for i, t in enumerate(sorted(BLOCKS))}
_P, _LI = _TAG_NUMBER["p"], _TAG_NUMBER["li"]
_HEADS = frozenset(_TAG_NUMBER[t] for t in HEADINGS)


def _read(views: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, pages, messages, texts = [], [], [], []
            columns = [batch.column(v).to_pylist() for v in views]
            for k, i in enumerate(batch.column("id").to_pylist()):
                found, message, text = [], False, None
                for v, column in zip(views, columns, strict=True):
                    page = column[k]
                    if not page:
                        continue
                    blocks, containers = read_blocks(page)
                    if not blocks:
                        continue
                    select_content(blocks, containers)
                    out, near_top, body, long = [], 0, [], []
                    for n, b in enumerate(blocks, 1):
                        own = b.own
                        state = 1 if b.main else 0
                        if not own.strip():
                            state = 3 if b.main else 0
                        elif state:
                            near_top += b.tag != "h1"
                            short = len(own) < 90
                            if b.role or (b.tag == "li" and b.links >= 0.8 * len(own)) or (short and _TEASER.search(own)) or _TEASER.search(own[-3:]) or (short and near_top <= 8 and (_BYLINE.match(own) and own[-1] not in ".!?" or _DATE_LINE.match(own))):
                                state = 2
                            else:
                                body.append(own)
                        key = line_key(own) if own else ""
                        if state == 1 and len(own) >= LONG_BLOCK:
                            long.append(key)
                        out.append({"n": n, "h": xxhash.xxh3_64_intdigest(key) - (1 << 63), "tag": _TAG_NUMBER[b.tag], "state": state})
                    found.append({"view": v, "blocks": out})
                    message = message or is_message(body)
                    if text is None:  # what tells copies of one article; a page without main text is its own
                        text = xxhash.xxh3_64_intdigest("\n".join(long or [line_key(t) for t in body] or [f"\0{i}"])) - (1 << 63)
                if found:
                    ids.append(i)
                    pages.append(found)
                    messages.append(message)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pages, pa.list_(_VIEW)), pa.array(messages, pa.bool_()), pa.array(texts, pa.int64())], names=["id", "views", "message", "text"])

    return run


def is_message(body: list[str]) -> bool:
    """Whether what a page holds in place of an article is a message, a notice or filler: most of its text is."""
    bad = whole = 0
    for t in body:
        units = [u for u in residue._SENTENCE.split(t) if u]
        for u in units:
            whole += len(u)
            if residue.unit_kind(u):
                bad += len(u)
    if not whole:
        return False
    text = " ".join(body)
    return bad >= 0.5 * whole or (len(text.split()) <= residue.SHORT_WORDS and bool(residue.page_kind(text) or any(residue.page_kind(t) for t in body)))


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, names, numbers = [], [], []
        for i, views, standing in zip(*(batch.column(c).to_pylist() for c in ("id", "views", "standing")), strict=True):
            standing = set(standing or ())
            known: dict[int, bool] = {}
            for view in views:
                blocks = view["blocks"]
                under = False  # in a list under a standing heading
                main: list[bool] = []
                for b in blocks:
                    h, tag = b["h"], b["tag"]
                    stands = h in standing
                    if tag in _HEADS:
                        under = stands
                    elif tag != _LI:
                        under = False
                    ok = b["state"] == 1 and not stands and not (under and tag == _LI)
                    if b["state"] != 3 and h in known:
                        ok = known[h] and not (under and tag == _LI)
                    main.append(ok)
                for b, ok in zip(blocks, main, strict=True):
                    known[b["h"]] = known.get(b["h"], False) or ok
                # a quote or item that only holds other blocks is as they are
                for k in range(len(blocks) - 2, -1, -1):
                    if blocks[k]["state"] == 3 and blocks[k]["tag"] in (_LI, _TAG_NUMBER["blockquote"]) and main[k + 1] and blocks[k + 1]["tag"] in (_P, _LI):
                        main[k] = True
                got = [b["n"] for b, ok in zip(blocks, main, strict=True) if ok]
                ids += [i] * len(got)
                names += [view["view"]] * len(got)
                numbers += got
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(names, pa.string()), pa.array(numbers, pa.int32())], names=["id", "view", "block_no"])


def main_blocks(pages: DataFrame, views: list[str], sites: DataFrame) -> DataFrame:
    """pages(id, one column of HTML a view), sites(id, site) -> (id, view, block_no) of the blocks of the main body.

    views: the columns, the fullest view (the raw page) first. Blocks are numbered from 1 in each view by their start
    tags. Null and empty pages, pages without blocks and pages that hold a message instead of an article have none. A
    page without a site, or with a null one, is a site of its own. Rows are judged each alone, repeated ones alike.
    """
    read = materialise(pages.select(F.col("id").cast("string").alias("id"), *views).mapInArrow(_read(views), _PAGE), "blocks")
    known = sites.where("site is not null").select(F.col("id").cast("string").alias("id"), "site").dropDuplicates(["id"])
    placed = read.join(known, "id", "left")
    # each line once a page, the first view standing for it, and once an article: copies don't make its lines standing ones
    lines = F.array_distinct(F.transform(F.filter(F.col("views")[0]["blocks"], lambda b: b["state"] != 3), lambda b: b["h"]))
    counted = placed.where("site is not null").select("site", "text", F.explode(lines).alias("h")).distinct().groupBy("site", "h").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    totals = placed.where("site is not null").select("site", "text").distinct().groupBy("site").agg(F.count("*").alias("articles"))
    # at most 1 / SHARE times as many as an article has lines
    standing = counted.join(totals, "site").where(F.col("n") >= SHARE * F.col("articles")).groupBy("site").agg(F.collect_list("h").alias("standing"))
    return placed.where("not message").join(standing, "site", "left").select("id", "views", "standing").mapInArrow(_label, "id string, view string, block_no int")
