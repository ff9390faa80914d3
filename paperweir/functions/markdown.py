"""Markdown to HTML, the part of CommonMark that captured articles use, and its visible text.

Every scan is linear: brackets, emphasis and code spans are matched by stacks and by places noted beforehand, never by
trying again, and blocks nest MAX_NESTING deep at most, what is deeper being text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import escape

from paperweir.functions.articles import normalize
from paperweir.functions.dom import parse_html, text_for_hash

MAX_NESTING = 100

_FENCE = re.compile(r" {0,3}(`{3,}+|~{3,}+)\s*+([^\s`]*+)([^`\n]*+)")
_RULE = re.compile(r"^ {0,3}(?:(?:\*\s*+){3,}+|(?:-\s*+){3,}+|(?:_\s*+){3,}+)$")
_ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])(?:\s+(.*)|)$")
_HTML = re.compile(r"^ {0,3}<(?:/?[a-zA-Z][a-zA-Z0-9-]*+(?:\s[^>]*+)?/?>|/?[a-zA-Z][a-zA-Z0-9-]*+\s[^>]*+>|!--)")

_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_PLAIN_RUN = re.compile(r"[^\\`<!\[\]*_~&>\"\n]++")
_TICKS = re.compile("`++")
_AUTOLINK = re.compile(r"<(https?://[^<>\s]++|[^<>\s@]++@[^<>\s]++)>")
_TAG_START = re.compile(r"</?[a-zA-Z]")
_ENTITY = re.compile(r"&(?:#\d{1,9}|#x[0-9a-fA-F]{1,8}|\w{1,40});")
_TARGET = re.compile(r"\(\s*+(?:<([^<>\n]*+)>|([^\s()]*+(?:\([^\s()]*+\)[^\s()]*+)*+))(?:\s++(?:\"([^\"]*+)\"|'([^']*+)'|\(([^()]*+)\)))?+\s*+\)")


class _Spans:
    """Inline Markdown of one run of text, read once from left to right.

    out holds finished pieces. An opening bracket or mark of emphasis is a piece of its own, text until its partner comes.
    """

    def __init__(self, text: str):
        self.text = text
        self.out: list[str] = []
        self.brackets: list[tuple[int, int, bool, int]] = []  # piece, place after it, image, marks open before it
        self.marks: list[list] = []  # character, how many are left, piece
        self.open = dict.fromkeys("*_~", 0)  # marks by character
        self.runs: dict[int, list[int]] = {}  # places of backticks by the length of their run
        for m in _TICKS.finditer(text):
            self.runs.setdefault(len(m[0]), []).append(m.start())

    def html(self) -> str:
        text, n, i = self.text, len(self.text), 0
        close = -1  # the next > from i on
        while i < n:
            if m := _PLAIN_RUN.match(text, i):
                self.out.append(m[0])
                i = m.end()
                continue
            c = text[i]
            if c == "\\" and i + 1 < n and (text[i + 1] in _PUNCTUATION or text[i + 1] == "\n"):
                self.out.append("<br>" if text[i + 1] == "\n" else escape(text[i + 1], quote=False))
                i += 2
            elif c == "`":
                i = self.code(i)
            elif c == "<":
                if close < i:
                    close = text.find(">", i) % (n + 1)  # the end of the text where there is none
                if m := _AUTOLINK.match(text, i):
                    self.out.append(f'<a href="{"" if "://" in m[1] else "mailto:"}{escape(m[1])}">{escape(m[1])}</a>')
                    i = m.end()
                elif close < n and _TAG_START.match(text, i):
                    self.out.append(text[i : close + 1])
                    i = close + 1
                else:
                    self.out.append("&lt;")
                    i += 1
            elif c == "[" or text.startswith("![", i):
                size = 1 if c == "[" else 2
                self.brackets.append((len(self.out), i + size, size == 2, len(self.marks)))
                self.out.append(text[i : i + size])
                i += size
            elif c == "]":
                i = self.bracket(i)
            elif c in "*_~":
                i = self.emphasis(i, c)
            elif c == "&" and (m := _ENTITY.match(text, i)):
                self.out.append(m[0])
                i = m.end()
            elif c == "\n":
                last = self.out[-1] if self.out else ""
                if last.endswith("  "):
                    self.out[-1] = last.rstrip(" ")
                    self.out.append("<br>")
                else:
                    self.out.append(c)
                i += 1
            else:
                self.out.append(escape(c))
                i += 1
        return "".join(self.out)

    def code(self, i: int) -> int:
        size = _TICKS.match(self.text, i).end() - i
        places = self.runs[size]
        k = bisect_left(places, i + size)
        if k == len(places):
            self.out.append("`" * size)
            return i + size
        inner = self.text[i + size : places[k]]
        self.out.append(f"<code>{escape(inner.strip() or inner, quote=False)}</code>")
        return places[k] + size

    def bracket(self, i: int) -> int:
        m = _TARGET.match(self.text, i + 1) if self.brackets else None
        if self.brackets:
            piece, after, image, marks = self.brackets.pop()
        if m is None:
            self.out.append("]")
            return i + 1
        target = escape(m[1] if m[1] is not None else m[2])
        self.drop_marks(marks)
        if image:
            self.out[piece:] = [f'<img src="{target}" alt="{escape(self.text[after:i])}">']
        else:
            self.out[piece] = f'<a href="{target}">'
            self.out.append("</a>")
            # a link holds no link: brackets that were open before are text
            self.brackets = [b for b in self.brackets if b[2]] if any(not b[2] for b in self.brackets) else self.brackets
        return m.end()

    def drop_marks(self, k: int) -> None:
        while len(self.marks) > k:
            self.open[self.marks.pop()[0]] -= 1

    def emphasis(self, i: int, c: str) -> int:
        text = self.text
        end = i
        while end < len(text) and text[end] == c:
            end += 1
        before, after = text[i - 1] if i else " ", text[end] if end < len(text) else " "
        opens = not after.isspace() and (after not in _PUNCTUATION or before.isspace() or before in _PUNCTUATION)
        closes = not before.isspace() and (before not in _PUNCTUATION or after.isspace() or after in _PUNCTUATION)
        if c == "_":
            opens, closes = opens and (not closes or before in _PUNCTUATION), closes and (not opens or after in _PUNCTUATION)
        left = end - i
        if c == "~" and left != 2:
            self.out.append(c * left)
            return end
        floor = self.brackets[-1][3] if self.brackets else 0
        while closes and left:
            k = next((k for k in range(len(self.marks) - 1, floor - 1, -1) if self.marks[k][0] == c), None) if self.open[c] else None
            if k is None:
                break
            self.drop_marks(k + 1)  # marks inside that found no partner are text
            mark = self.marks[k]
            size = 2 if mark[1] >= 2 and left >= 2 else 1
            tag = "del" if c == "~" else "strong" if size == 2 else "em"
            mark[1] -= size
            left -= size
            piece = self.out[mark[2]]
            self.out[mark[2]] = f"{c * mark[1]}<{tag}>{piece[mark[1] + size :]}"
            self.out.append(f"</{tag}>")
            if not mark[1]:
                self.drop_marks(k)
        if left:
            if opens:
                self.marks.append([c, left, len(self.out)])
                self.open[c] += 1
            self.out.append(c * left)
        return end


def spans(text: str) -> str:
    """Inline Markdown of a run of text."""
    return _Spans(text).html()


def to_html(markdown: str) -> str:
    return _blocks(markdown.replace("\r\n", "\n").replace("\r", "\n").split("\n"))


class Fences:
    """Fenced code, told line by line: line() says whether a line is text, opens or closes a fence or is code."""

    def __init__(self):
        self.mark = ""
        self.info = ""

    def line(self, line: str) -> str:
        m = _FENCE.match(line)
        if not self.mark:
            if m is None or m.end() < len(line.rstrip("\n")):
                return "text"
            self.mark, self.info = m[1], m[2]
            return "open"
        if m is not None and m[1].startswith(self.mark) and not m[2] and not m[3].strip():
            self.mark = ""
            return "close"
        return "code"


def _heading(line: str) -> tuple[int, str] | None:
    text = line.lstrip(" ")
    level = len(text) - len(text.lstrip("#"))
    rest = text[level:]
    if len(line) - len(text) > 3 or not 1 <= level <= 6 or rest and not rest[0].isspace():
        return None
    rest = rest.strip()
    bare = rest.rstrip("#")
    return level, bare.rstrip() if not bare or bare[-1].isspace() else rest


def _blocks(lines: list[str], tight: bool = False, depth: int = 0) -> str:
    out: list[str] = []
    para: list[str] = []

    def flush() -> None:
        if para:
            text = spans("\n".join(x.lstrip() for x in para).rstrip())
            out.append(text if tight else f"<p>{text}</p>")
            para.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        fences = Fences()
        if not line.strip():
            flush()
        elif fences.line(line) == "open":
            flush()
            language, code = fences.info, []
            i += 1
            while i < len(lines) and fences.line(lines[i]) == "code":
                code.append(lines[i])
                i += 1
            cls = f' class="language-{escape(language)}"' if language else ""
            out.append(f"<pre><code{cls}>{escape(chr(10).join(code), quote=False)}\n</code></pre>")
        elif (heading := _heading(line)) is not None:
            flush()
            out.append(f"<h{heading[0]}>{spans(heading[1])}</h{heading[0]}>")
        elif para and re.match(r"^ {0,3}(=++|-++)\s*+$", line):
            text = spans("\n".join(para).strip())
            para.clear()
            level = 1 if "=" in line else 2
            out.append(f"<h{level}>{text}</h{level}>")
        elif _RULE.match(line):
            flush()
            out.append("<hr>")
        elif depth < MAX_NESTING and re.match(r"^ {0,3}>", line):
            flush()
            quoted = []
            while i < len(lines) and (re.match(r"^ {0,3}>", lines[i]) or (quoted and quoted[-1].strip() and lines[i].strip())):
                quoted.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            out.append(f"<blockquote>{_blocks(quoted, depth=depth + 1)}</blockquote>")
            continue
        elif depth < MAX_NESTING and (m := _ITEM.match(line)) and not (para and m[2][0].isdigit() and not m[2].startswith("1")):
            flush()
            i = _list(lines, i, out, depth)
            continue
        elif re.match(r"^ {4}|^\t", line) and not para:
            code = []
            while i < len(lines) and (re.match(r"^ {4}|^\t", lines[i]) or not lines[i].strip()):
                code.append(re.sub(r"^ {4}|^\t", "", lines[i]))
                i += 1
            out.append(f"<pre><code>{escape(chr(10).join(code).rstrip(), quote=False)}\n</code></pre>")
            continue
        elif _HTML.match(line) and not para:
            html = []
            while i < len(lines) and lines[i].strip():
                html.append(lines[i])
                i += 1
            out.append("\n".join(html))
            continue
        else:
            para.append(line)
        i += 1
    flush()
    return "\n".join(out)


def _list(lines: list[str], i: int, out: list[str], depth: int) -> int:
    first = _ITEM.match(lines[i])
    ordered = first[2][0].isdigit()
    kind = lambda m: m[2][-1] if m[2][0].isdigit() else m[2]
    items: list[list[str]] = []
    loose, indent = False, 99
    while i < len(lines):
        m = _ITEM.match(lines[i])
        if m and len(m[1]) < indent and kind(m) == kind(first) and not _RULE.match(lines[i]):
            indent = len(m[1]) + len(m[2]) + 1
            items.append([m[3] or ""])
            i += 1
            continue
        if not lines[i].strip():
            after = i + 1
            while after < len(lines) and not lines[after].strip():
                after += 1
            if after == len(lines) or not (lines[after].startswith(" " * indent) or ((n := _ITEM.match(lines[after])) and kind(n) == kind(first))):
                break
            loose = True
            items[-1] += [""] * (after - i)
            i = after
            continue
        if lines[i].startswith(" " * min(indent, 2)) or (items[-1][-1].strip() and _heading(lines[i]) is None and Fences().line(lines[i]) == "text" and not re.match(r"^ {0,3}>", lines[i]) and not (m and len(m[1]) < indent)):
            items[-1].append(re.sub(rf"^ {{0,{indent}}}", "", lines[i]))
            i += 1
            continue
        break
    tag = "ol" if ordered else "ul"
    start = f' start="{int(first[2][:-1])}"' if ordered and int(first[2][:-1]) != 1 else ""
    out.append(f"<{tag}{start}>" + "".join(f"<li>{_blocks(x, not loose, depth + 1)}</li>" for x in items) + f"</{tag}>")
    return i


def visible_text(markdown: str) -> str:
    return normalize(text_for_hash(parse_html(to_html(markdown))))


def _texts(markdown: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is fenced code) of the stretches of a text; an open fence reaches to the end."""
    fences, start, at = Fences(), 0, 0
    for line in markdown.split("\n"):
        end = min(at + len(line) + 1, len(markdown))
        state = fences.line(line.rstrip("\r"))
        if state == "open":
            if at > start:
                yield start, at, False
            start = at
        elif state == "close":
            yield start, end, True
            start = end
        at = end
    if start < len(markdown):
        yield start, len(markdown), bool(fences.mark)


def code_ranges(markdown: str) -> list[tuple[int, int]]:
    """(start, end) of the fenced code in a text."""
    return [(a, b) for a, b, code in _texts(markdown) if code]


# What an image's target in Markdown and in HTML looks like.
_IMAGE_TARGET = re.compile(r"\(\s*+(?:<([^>\r\n]++)>|([^\s)\r\n]++))(?:\s++(?:\"[^\"\r\n]*+\"|'[^'\r\n]*+'|\([^\r\n)]*+\)))?+\s*+\)")
_SRC = re.compile(r"\bsrc\s*+=\s*+([\"'])(.*?)\1", re.I | re.S)
_IMG = re.compile(r"<img\b", re.I)
_LINE_END = re.compile(r"[\r\n]|\Z")


def image_references(markdown: str) -> list[tuple[int, int, str]]:
    """(start, end, target) of the images outside fenced code, in order; images without a target are left out."""
    found = []
    for start, end, code in _texts(markdown):
        if not code:
            found += _markdown_images(markdown, start, end)
            found += _tag_images(markdown, start, end)
    return sorted(found)


def _markdown_images(text: str, at: int, end: int) -> Iterator[tuple[int, int, str]]:
    close = line = -1  # the next ] and the next end of a line
    while (at := text.find("![", at, end)) >= 0:
        at += 2
        if close < at:
            close = text.find("]", at, end) % (end + 1)
        if line < at:
            line = _LINE_END.search(text, at).start()
        if close < min(line, end) and (m := _IMAGE_TARGET.match(text, close + 1)):
            group = 1 if m[1] is not None else 2
            yield m.start(group), m.end(group), m[group]
            at = m.end()


def _tag_images(text: str, at: int, end: int) -> Iterator[tuple[int, int, str]]:
    while (m := _IMG.search(text, at, end)) is not None:
        close = text.find(">", m.end(), end)
        if close < 0:
            return
        if (src := _SRC.search(text, m.end(), close)) and src[2]:
            yield src.start(2), src.end(2), src[2]
        at = close + 1
