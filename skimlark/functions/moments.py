"""Time formats by induction: texts become token shapes, shapes are counted, formats are derived from the shapes that occur.

A shape keeps the separators of a text and names its tokens: ``Y`` four digits, ``n`` one or two digits, ``f`` a fraction, ``B``
and ``L`` a short and a long month name, ``W`` a weekday, ``p`` half of a day, ``z x u`` kinds of time zone. Only texts of the
grammar have one, so a column has few; counts and ranges of shapes merge by adding. Formats that shapes allow are then counted
over all values, which decides between day and month order by what the values can be.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimlark.functions.exprs import stripped

# Names of months, weekdays, zones.
MONTHS = "january february march april may june july august september october november december".split()
SHORT_MONTHS = [m[:3] for m in MONTHS]
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
ZONES = ["utc", "gmt"]
LONGEST = 48  # characters of a moment at most

_MONTH = "|".join([*MONTHS, *SHORT_MONTHS])
_WEEKDAY = "|".join([*WEEKDAYS, *[d[:3] for d in WEEKDAYS]])
_DATE = (r"(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{4}年\d{1,2}月\d{1,2}日|\d{1,2}([-/.])\d{1,2}\2\d{4}"
         rf"|\d{{1,2}}[-/. ](?:{_MONTH})[-/., ]{{1,2}}\d{{4}}|(?:{_MONTH}) \d{{1,2}},? \d{{4}})")
_TIME = rf"\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d{{1,9}})?)?(?: ?[ap]m)?(?: ?(?:z|{'|'.join(ZONES)}|[+-]\d{{2}}(?::?\d{{2}})?))?"
MOMENT = rf"(?i)^(?:(?:{_WEEKDAY}),? )?(?:{_DATE}(?:(?:t|,? ){_TIME})?|{_TIME})$"
#: What every moment begins with; cheap, and met by few other texts.
START = rf"(?i)^(?:\d{{1,4}}[-/:.年 ]|(?:{_MONTH}|{_WEEKDAY})[ ,])"

_STEPS = [
    (rf"^(?:{_WEEKDAY})(,?) ", "W$1 "), (r"(:\d{2})([.,])\d{1,9}", "$1$2f"), (r"((?::\d{2}|f|m) ?)[+-]\d{2}:\d{2}$", "$1X"), (r"((?::\d{2}|f|m) ?)[+-]\d{4}$", "$1x"),
    (r"((?::\d{2}|f|m) ?)[+-]\d{2}$", "$1h"), (r"(:\d{2}|f|m)( ?)z$", "$1$2X"), (rf"(?:{'|'.join(ZONES)})$", "u"), (r"[ap]m", "p"), (rf"\b(?:{'|'.join(MONTHS[:4] + MONTHS[5:])})\b", "L"),
    (rf"\b(?:{'|'.join(SHORT_MONTHS)})\b", "B"), (r"\d{4}", "Y"), (r"\d{1,2}", "n")]

#: Formats that single cells are read by, value by value.
TIME_FORMATS = [
    "yyyy-M-d", "yyyy-M-d H:m", "yyyy-M-d H:m:s[.SSSSSSSSS]", "yyyy-M-d'T'H:m", "yyyy-M-d'T'H:m:s[.SSSSSSSSS]", "yyyy-M-d H:m:s[.SSSSSSSSS]XXX",
    "yyyy-M-d'T'H:m:s[.SSSSSSSSS]XXX", "yyyy-M-d'T'H:m:s[.SSSSSSSSS]XX", "yyyy/M/d", "yyyy/M/d H:m", "yyyy/M/d H:m:s", "M/d/yyyy", "M/d/yyyy H:m", "M/d/yyyy H:m:s",
    "M/d/yyyy h:m a", "M/d/yyyy h:m:s a", "d/M/yyyy", "d/M/yyyy H:m", "d/M/yyyy H:m:s", "d-M-yyyy", "d.M.yyyy", "d.M.yyyy H:m", "d.M.yyyy H:m:s",
    "yyyy年M月d日", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "H:m", "H:m:s", "h:m a"]


def shape(text: Column) -> Column:
    """The shape of a stripped text; null when it is no text of the grammar."""
    out = F.lower(text)
    for pattern, token in _STEPS:
        out = F.regexp_replace(out, pattern, token)
    return F.when((F.length(text) <= LONGEST) & text.rlike(MOMENT), out)


def formats_of(found: str) -> list[str]:
    """The formats that texts of a shape may have, likelier ones first."""
    m = re.fullmatch(r"(W,? )?(?:([^:]*?[Yn日])(t|,? )?)?(n:n(:n([.,]f)?)?( ?p)?( ?[Xxhu])?)?", found)
    if not m:
        return []
    week, date, gap, time = m[1] or "", m[2], m[3] or "", m[4] or ""
    if bool(gap) != bool(date and time):
        return []
    names = {"B": ["MMM", "MMMM"], "L": ["MMMM"]}
    options = [[""]]
    if date:
        month = next((names[c] for c in date if c in names), None)
        if month:
            one = date.replace("n", "d").replace("Y", "yyyy")
            options = [[one.replace("B", x).replace("L", x) for x in month]]
        elif date[0] == "Y":
            options = [[re.sub("n", "d", re.sub("n", "M", date, count=1)).replace("Y", "yyyy")]]
        else:
            sep = date[1]
            first, second = f"M{sep}d{sep}yyyy", f"d{sep}M{sep}yyyy"
            options = [[second, first] if sep == "." else [first, second]]
    clock = ""
    if time:
        hour = "h" if m[7] else "H"
        clock = f"{hour}:m" + (":s" if m[5] else "") + (f"[{m[6][0]}SSSSSSSSS]" if m[6] else "") + (m[7] or "").replace("p", "a")
        zone = m[8] or ""
        clock += zone.replace("X", "XXX").replace("x", "XX").replace("h", "X") if "u" not in zone else zone.replace("u", "'UTC'")
    lead = week.replace("W", "EEE")
    return [lead + d + ("'T'" if gap == "t" else gap) + clock for (d,) in product(*options)]


_TOKENS = re.compile(r"'[^']*'|\[|\]|(.)\1*")
_DIGITS = {"yyyy": r"\d{4}", "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "h": r"\d{1,2}", "m": r"\d{2}", "s": r"\d{2}", "SSSSSSSSS": r"\d{1,9}",
           "MMM": f"(?:{'|'.join(SHORT_MONTHS)})", "MMMM": f"(?:{'|'.join(MONTHS)})", "a": "[ap]m", "EEE": f"(?:{_WEEKDAY})",
           "XXX": r"(?:z|[+-]\d{2}:\d{2})", "XX": r"(?:z|[+-]\d{4})", "X": r"(?:z|[+-]\d{2})", "'T'": "t", "'UTC'": f"(?:{'|'.join(ZONES)})"}


@cache
def pattern_of(time_format: str) -> str:
    """The pattern of the texts that a format reads."""
    out = []
    for m in _TOKENS.finditer(time_format):
        t = m[0]
        out.append("(?:" if t == "[" else ")?" if t == "]" else _DIGITS[t] if t in _DIGITS else re.escape(t))
    return "(?i)^" + "".join(out) + "$"


def parse_time(c: Column, time_format: str) -> Column:
    """The wall time a text shows by one format, in UTC where it names a zone; null when it does not fit.

    The pattern is tested first, so that text costs no failed parse. Texts without a zone are read as UTC
    and shown as such, so no hour is skipped or repeated by the session's time zone.
    """
    text = stripped(c)
    fits = text.rlike(pattern_of(time_format))
    plain, fmt = text, time_format
    if fmt.startswith("EEE"):  # weekdays are not parsed
        plain, fmt = F.regexp_replace(plain, rf"(?i)^(?:{_WEEKDAY}),? ", ""), re.sub("^EEE,? ", "", fmt)
    if "'UTC'" in fmt:
        plain, fmt = F.regexp_replace(plain, rf"(?i) ?(?:{'|'.join(ZONES)})$", ""), re.sub(" ?'UTC'$", "", fmt)
    if "'T'" in fmt:
        plain = F.replace(plain, F.lit("t"), F.lit("T"))
    if not fmt.endswith("X"):
        plain, fmt = F.concat(plain, F.lit("Z")), fmt + "XXX"
    moment = F.try_to_timestamp(F.when(fits, F.upper(plain) if "'T'" in fmt else plain), F.lit(fmt))
    return F.timestamp_add("MICROSECOND", F.unix_micros(moment), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def parse_any_time(c: Column) -> Column:
    return F.coalesce(*[parse_time(c, fmt) for fmt in TIME_FORMATS])


def shape_counts(cells: DataFrame) -> DataFrame:
    """``position, shape, count`` of ``position, text`` cells."""
    found = cells.where(F.col("text").rlike(START)).select("position", shape(F.col("text")).alias("shape"))
    return found.where("shape IS NOT NULL").groupBy("position", "shape").agg(F.count(F.lit(1)).alias("count"))


def induced(cells: DataFrame) -> dict[int, list[tuple[str, int]]]:
    """Formats of each position with the number of values they read, most first.

    One pass counts shapes, a second one the values that the derived formats read. Both bring one row per shape or column.
    """
    shapes = shape_counts(cells).collect()
    wanted: dict[int, dict[str, None]] = {}
    for r in sorted(shapes, key=lambda r: (-r["count"], r["shape"])):
        wanted.setdefault(r["position"], {}).update(dict.fromkeys(formats_of(r["shape"])))
    # a fraction that only some values have is one format with the others
    for own in wanted.values():
        for fmt in [f for f in own if "[" in f]:
            own.pop(re.sub(r"\[.*\]", "", fmt), None)
    every = list(dict.fromkeys(f for own in wanted.values() for f in own))
    if not every:
        return {}
    text = F.col("text")
    counted = cells.where(text.rlike(START)).groupBy("position").agg(F.array(*[F.count(parse_time(text, f)) for f in every]).alias("hits"))
    out = {}
    for r in counted.collect():
        own = wanted.get(r["position"], {})
        hits = [(f, r["hits"][every.index(f)]) for f in own]
        out[r["position"]] = [(f, h) for f, h in sorted(hits, key=lambda x: -x[1]) if h]
    return out
