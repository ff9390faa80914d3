"""Reading of one written moment. Pure Python, used inside a vectorised function over distinct values only."""

from __future__ import annotations

import re
import unicodedata
from datetime import UTC, datetime, timedelta

# Hours east of UTC of zone abbreviations as they count in this data (EST is always -5, BST is British).
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 1, "bst": 1, "cet": 1, "mez": 1, "cest": 2, "mesz": 2,
    "eet": 2, "eest": 3, "msk": 3, "ist": 5.5, "jst": 9, "kst": 9, "aest": 10, "aedt": 11, "acst": 9.5, "acdt": 10.5,
    "awst": 8, "nzst": 12, "nzdt": 13, "ast": -4, "adt": -3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7,
    "mdt": -6, "pst": -8, "pdt": -7, "akst": -9, "akdt": -8, "hst": -10, "brt": -3, "brst": -2, "art": -3,
}

# Month names, one line a language (en, de, fr, es, pt, ru, cs), without accents, in calendar order.
MONTH_NAMES = """
january february march april may june july august september october november december
januar februar marz april mai juni juli august september oktober november dezember
janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro
января февраля марта апреля мая июня июля августа сентября октября ноября декабря
январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь
ledna unora brezna dubna kvetna cervna cervence srpna zari rijna listopadu prosince
leden unor brezen duben kveten cerven cervenec srpen zari rijen listopad prosinec
jan feb mar apr may jun jul aug sep oct nov dec
jan febr maerz apr mai juni juli aug sept okt nov dez
janv fevr mars avr mai juin juil aout sept oct nov dec
ene feb mar abr may jun jul ago set oct nov dic
jan fev mar abr mai jun jul ago set out nov dez
"""
# Names of week days and words that may stand around a date.
WEEKDAYS = """
monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun
montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag mo di mi do fr sa so
lundi mardi mercredi jeudi vendredi samedi dimanche lun mar mer jeu ven sam dim
lunes martes miercoles jueves viernes sabado domingo mie jue vie sab dom
segunda terca quarta quinta sexta segunda-feira terca-feira quarta-feira quinta-feira sexta-feira
понедельник вторник среда четверг пятница суббота воскресенье пн вт ср чт пт сб вс
pondeli utery streda ctvrtek patek sobota nedele
"""
FILLERS = """
updated published last modified posted on at the of de del a as las le la um uhr kl klo en el am den dne v г года in
date first edited created veroffentlicht aktualisiert publie mis jour publicado actualizado atualizado em опубликовано обновлено
от в th st nd rd er time heure h o le je h hod
"""


def _fold(text: str) -> str:
    """Lower case without accents; the breve stays, since it makes a letter of its own in Russian."""
    parts = unicodedata.normalize("NFKD", text.lower())
    return unicodedata.normalize("NFC", "".join(c for c in parts if c == "\u0306" or not unicodedata.combining(c)))


MONTHS = {name: i for line in MONTH_NAMES.strip().splitlines() for i, name in enumerate(line.split(), 1)}
MONTHS["sept"] = 9
_WEEKDAYS = set(WEEKDAYS.split())
_FILLERS = set(FILLERS.split())

_TIME = r"(\d{1,2})\s?[:.h]\s?(\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?"
_ISO = re.compile(r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:(?:[t,\s]\s*|\s+(?:at|um|a|as|kl)\s+)" + _TIME + r")?\s*(.*)$")
_COMPACT = re.compile(r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?\s*(z|[+-]\d{2}:?\d{2}|[a-z/_ ()+:\d-]*)$")
_NUMERIC = re.compile(r"^(\d{1,2})\s?([-/.])\s?(\d{1,2})\s?\2\s?(\d{4})(?:(?:,?\s+|,\s*)(?:(?:at|um|a|as|kl)\s+)?" + _TIME + r")?\s*(.*)$")
_HALF = re.compile(r"^\s*([ap])\.?\s?m\.?(?![a-z])")
_OFFSET = re.compile(r"^(?:utc|gmt|z)?\s*([+\-−])\s?(\d{1,2})(?::?(\d{2}))?$")
_ZONE_NAME = re.compile(r"^[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+$")
_WORD_TIME = re.compile(r"(?<![\d:])(\d{1,2})(?:\s?[:h]\s?(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?|(?=\s?[ap]\.?m\b))(?!\d)")


def _zone(rest: str) -> tuple[float | None, str | None] | None:
    """(offset in hours, zone name) of what stands after the time; None where it can't be read; (None, None) where nothing stands."""
    rest = rest.strip().strip("()[]").strip().rstrip(".")
    words = [w for w in rest.split() if _fold(w).strip(".,") not in _FILLERS]
    rest = " ".join(words).strip("()[]., ")
    if not rest:
        return None, None
    if m := _OFFSET.match(rest.lower()):
        hours = int(m[2]) + int(m[3] or 0) / 60
        return (hours if m[1] == "+" else -hours, None) if hours <= 15 else None
    if rest.lower() in ABBREVIATIONS:
        return ABBREVIATIONS[rest.lower()], None
    if _ZONE_NAME.match(rest):
        return None, rest
    if m := re.match(r"^\(?([A-Za-z/_+:\-0-9]+)\)?\s*\(([^)]*)\)$", rest):  # an offset, then its name in brackets
        return _zone(m[1])
    return None


def _made(year: int, month: int, day: int, hour: int | None, minute: int | None, second: int | None, digits: str | None, half: str | None, zone: tuple | None) -> tuple | None:
    if zone is None:
        return None
    if half:
        if hour is None or not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half == "p" else 0)
    plus = timedelta(0)
    if hour == 24 and not minute and not second:
        hour, plus = 0, timedelta(days=1)
    if second == 60:
        second, plus = 59, plus + timedelta(seconds=1)
    try:
        moment = datetime(year, month, day, hour or 0, minute or 0, second or 0, tzinfo=UTC) + plus
    except (ValueError, OverflowError):
        return None
    ms = round(moment.timestamp()) * 1000 + int((digits or "0").ljust(3, "0")[:3])
    offset, name = zone
    if offset is not None:
        return ms - round(offset * 3_600_000), None
    return ms, name or ""


def read_moment(raw: str | None, date_order: str | None) -> tuple[int, str | None] | None:
    """(milliseconds, zone) of a written moment.

    zone None: the milliseconds are UTC. Otherwise they are local: of the zone named, or where zone is '' of the
    place where it was written. None: it names no full day (also null, blank, impossible or relative values).
    """
    if raw is None:
        return None
    text = " ".join(unicodedata.normalize("NFKC", raw).split())
    if not text or not any(c.isdigit() for c in text):
        return None
    if text.isdigit() and text.isascii():
        if 9 <= len(text) <= 10:
            return int(text) * 1000, None
        if 12 <= len(text) <= 13:
            return int(text), None
        if len(text) not in (8, 14):
            return None
        text = f"{text[:8]}t{text[8:] or '0000'}"
    text = re.sub(r"^(?:(?!\d)[^\d,:|]*[:|]\s*)(?=\d)", "", text) if re.match(r"^\D+[:|]\s*\d", text) else text
    while (m := re.match(r"^([^\W\d]+)[.,]?\s+(?=\S)", text)) and (w := _fold(m[1])) not in MONTHS and (w in _FILLERS or w in _WEEKDAYS):
        text = text[m.end() :]
    low = text.lower()
    number = lambda x: None if x is None else int(x)
    if m := _ISO.match(low):
        rest, half = text[m.start(9) :], None
        if m[5] is not None and (h := _HALF.match(low[m.start(9) :])):
            half, rest = h[1], rest[h.end() :]
        return _made(int(m[1]), int(m[3]), int(m[4]), number(m[5]), number(m[6]), number(m[7]), m[8], half, _zone(rest))
    if m := _COMPACT.match(low):
        return _made(int(m[1]), int(m[2]), int(m[3]), int(m[4]), int(m[5]), number(m[6]), m[7], None, _zone(text[m.start(8) :]))
    if m := _NUMERIC.match(low):
        first, second = int(m[1]), int(m[3])
        day, month = (second, first) if date_order == "mdy" else (first, second)
        rest, half = text[m.start(9) :], None
        if m[5] is not None and (h := _HALF.match(low[m.start(9) :])):
            half, rest = h[1], rest[h.end() :]
        return _made(int(m[4]), month, day, number(m[5]), number(m[6]), number(m[7]), m[8], half, _zone(rest))
    return _worded(text)


def _worded(text: str) -> tuple[int, str | None] | None:
    """A date with the month's name."""
    hour = minute = second = digits = half = None
    zone: tuple | None = (None, None)
    if m := _WORD_TIME.search(text.lower()):
        # the day of the month may stand before the time, never within it
        hour, minute, second, digits = int(m[1]), int(m[2] or 0), None if m[3] is None else int(m[3]), m[4]
        rest = text[m.end() :]
        if h := _HALF.match(rest.lower()):
            half, rest = h[1], rest[h.end() :]
        text = text[: m.start()]
        if not re.search(r"\d{4}", text):  # the time stands before the date
            if (y := re.search(r"\d{4}", rest)) is None:
                return None
            text, rest = f"{text} {rest[: y.end()]}", rest[y.end() :]
        zone = _zone(rest)
    day = month = year = None
    for word in re.findall(r"\d+|[^\W\d_]+(?:-[^\W\d_]+)?", text):
        if word.isdigit():
            if len(word) == 4 and year is None:
                year = int(word)
            elif len(word) <= 2 and day is None:
                day = int(word)
            else:
                return None
            continue
        low = _fold(word)
        if low in MONTHS and (month is None or low not in _WEEKDAYS):
            if month is not None and low not in _FILLERS:
                return None
            month = MONTHS[low]
        elif low not in _FILLERS and low not in _WEEKDAYS:
            if low in ABBREVIATIONS and zone == (None, None) and year is not None:
                zone = (ABBREVIATIONS[low], None)
            else:
                return None
    if day is None or month is None or year is None:
        return None
    return _made(year, month, day, hour, minute, second, digits, half, zone)
