"""Tokens of HTML in time linear in the text, whatever it holds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_NAME = r"[a-zA-Z][^\s/>]*+"
# quotes count where a value begins; an end tag, a declaration and a tag whose quotes never end go up to the next >
_QUOTED = re.compile(rf"<!--.*?(?:--!?>|\Z)|<({_NAME})((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>|</({_NAME})[^>]*+>|<[!?/][^>]*+>|<({_NAME})(?=[^>])", re.S)
_PLAIN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<({_NAME})([^>]*+)>|</({_NAME})[^>]*+>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
# Elements whose content is no markup.
RAW = frozenset(("script", "style"))
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def attributes(text: str) -> dict[str, str]:
    found = {}
    for m in _ATTRIBUTE.finditer(text):
        value = next((v for v in m.groups()[1:] if v is not None), "")
        found[m[1].lower()] = unescape(value) if "&" in value else value
    return found


def tokens(markup: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("start", tag, attributes) and ("end", tag, {}); comments and declarations are left out.

    A tag that never ends is text. Where a quote in a tag never ends, quotes are not minded from there on, so that no
    part of a text is looked through again and again.
    """
    pattern, at, end_of_tags = _QUOTED, 0, markup.rfind(">") + 1
    text_from = 0
    while (m := pattern.search(markup, at, end_of_tags)) is not None:
        if pattern is _QUOTED and m[4] is not None:
            pattern, at = _PLAIN, m.start()
            continue
        if m.start() > text_from:
            yield "text", _plain(markup[text_from : m.start()]), {}
        text_from = at = m.end()
        if m[1] is not None:
            tag = m[1].lower()
            yield "start", tag, attributes(m[2]) if m[2] else {}
            if tag in RAW:
                end = _RAW_END[tag].search(markup, at)
                stop = end.start() if end else len(markup)
                if stop > at:
                    yield "text", markup[at:stop], {}
                text_from = at = stop
        elif m[3] is not None:
            yield "end", m[3].lower(), {}
        elif m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
            return  # a comment that never ends
    if (comment := markup.find("<!--", max(text_from, end_of_tags))) >= 0:
        markup = markup[:comment]
    if text_from < len(markup):
        yield "text", _plain(markup[text_from:]), {}


def _plain(text: str) -> str:
    return unescape(text) if "&" in text else text
