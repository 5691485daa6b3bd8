"""Text expressions: keys, matching, previews, similarity and labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TEXT_LIMIT = 8192
#: The Unicode White_Space code points, which duplicate keys leave out.
WHITE_SPACE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: What content fingerprints leave out, the above and two invisible ones.
FINGERPRINT_SPACE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}\x{FEFF}]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Compatibility-normalised text, on Arrow batches in Python; ASCII text comes back as it is."""
    return _nfkc(text)


def name_key(name: Column) -> Column:
    """Key under which names are one: trimmed, normalised, lower case."""
    return F.lower(nfkc(F.trim(name)))


def header_key(header: Column) -> Column:
    """Key of a column heading: as name_key, without spaces and _ - : marks."""
    return F.regexp_replace(F.lower(nfkc(header)), r"[\s_\-:：]", "")


def type_key(name: Column) -> Column:
    """Key of a question type's name: as name_key, without spaces."""
    return F.regexp_replace(name_key(name), r"\s", "")


def ascii_folded(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, _UPPER, _LOWER)


def matches_keyword(columns: list[Column], keyword: str, escape_wildcards: bool = False) -> Column:
    """Whether a column holds the trimmed keyword, ASCII case aside; % and _ in it are wildcards unless escaped."""
    word = keyword.strip().translate(str.maketrans(_UPPER, _LOWER))
    if escape_wildcards:
        found = [F.instr(ascii_folded(c), word) > 0 for c in columns]
    else:
        # The escape character must not occur in the pattern, so that nothing is escaped.
        found = [F.like(ascii_folded(c), F.lit(f"%{word}%"), F.lit("\u0001")) for c in columns]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return F.coalesce(out, F.lit(False))


def stem_preview(stem: Column, length: int = 160) -> Column:
    """Stem on one line, cut to `length` code points with an ellipsis."""
    line = F.regexp_replace(F.trim(stem), r"\s+", " ")
    return F.when(F.length(line) > length, F.concat(F.substring(line, 1, length), F.lit("…"))).otherwise(line)


def compared_text(text: Column, limit: int = TEXT_LIMIT, normalise: bool = True) -> Column:
    """What is compared of a field: its first code points, normalised, lower case, without white space."""
    cut = F.substring(F.coalesce(text, F.lit("")), 1, limit)
    cut = nfkc(cut) if normalise else cut
    return F.substring(F.regexp_replace(F.lower(cut), WHITE_SPACE, ""), 1, limit)


def similarity_text(*fields: Column, normalise: bool = True) -> Column:
    """Fields joined by the unit separator, each as compared_text()."""
    return F.concat_ws("\u001f", *(compared_text(x, normalise=normalise) for x in fields))


def compared_length(*fields: Column) -> Column:
    """Sum of the fields' lengths, each at most the limit."""
    out = F.lit(0)
    for x in fields:
        out = out + F.least(F.length(F.coalesce(x, F.lit(""))), F.lit(TEXT_LIMIT))
    return out


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring code points; a single one pairs with U+0000; none of an empty text."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.concat(text, F.lit("\u0000")))).otherwise(pairs)


def dice_percent(shared: Column, left: Column, right: Column) -> Column:
    """Dice similarity of two bags in whole percent, rounded half up; 0 if either is empty."""
    total = left + right
    return F.when((left == 0) | (right == 0), 0).otherwise(F.least(F.lit(100), F.floor((200 * shared + F.floor(total / 2)) / total))).cast("int")


def split_tags(text: Column) -> Column:
    """Tags of a cell: split, trimmed, at most 80 code points, the first spelling of each key."""
    parts = F.filter(F.transform(F.split(text, "[、,，;；\n]"), lambda x: F.substring(F.trim(x), 1, 80)), lambda x: x != "")
    keep = lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.concat(seen, F.array(x)))
    return F.aggregate(parts, F.array().cast("array<string>"), keep)


def option_lines(options: Column) -> Column:
    """Options one a line, labelled A. to Z. and then by number."""
    label = lambda i: F.when(i < 26, F.char(i + 65)).otherwise((i + 1).cast("string"))
    return F.array_join(F.transform(options, lambda x, i: F.concat(label(i), F.lit(". "), F.trim(x))), "\n")


def percent_text(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal; 0.0 of nothing."""
    return F.when(whole <= 0, F.lit("0.0")).otherwise(F.format_string("%.1f", (part.cast("double") * 100 / whole.cast("double"))))


def utc_text(milliseconds: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS UTC of epoch milliseconds, in a session whose time zone is UTC."""
    return F.concat(F.date_format(F.timestamp_millis(milliseconds), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def cell_text(text: Column, limit: int = 32767, suffix: str = "…[truncated]") -> Column:
    """Text that a worksheet cell can hold: without characters illegal in XML, cut to `limit` code points."""
    clean = F.regexp_replace(text, r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit - len(suffix)), F.lit(suffix))).otherwise(clean)


def content_fingerprint(kind: Column, fields: list[Column], normalise: bool = True) -> Column:
    """SHA-256 over the number of fields, the type and each field with its length: equal content, equal bytes.

    All fields are normalised by one call: joined by U+0000, which normalisation neither makes nor takes (in a field it counts as U+2400).
    """
    plain = F.concat_ws("\u0000", *(F.replace(F.coalesce(x, F.lit("")), F.lit("\u0000"), F.lit("\u2400")) for x in fields))
    squeezed = F.regexp_replace(F.lower(nfkc(plain) if normalise else plain), FINGERPRINT_SPACE, "")
    parts = F.split(squeezed, "\u0000", -1)
    framed = F.concat(F.array(kind), parts)
    return F.sha2(F.concat(F.lit(f"2;{len(fields)};"), F.array_join(F.transform(framed, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "")), 256)


def is_uuid(text: Column) -> Column:
    """Whether text is a UUID in canonical lower case."""
    return F.coalesce(F.rlike(text, F.lit("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")), F.lit(False))


def usage_cutoff_ms(window: str, now_ms: int) -> Column:
    """Start of the semester (180 days), month, week (Monday) or day of now_ms, in the session's time zone."""
    if window == "semester":
        return F.lit(now_ms - 180 * 86_400_000).cast("long")
    if window not in ("month", "week", "day"):
        raise ValueError(f"unknown window {window!r}")
    return F.unix_millis(F.date_trunc(window, F.timestamp_millis(F.lit(now_ms))))


def period_start(time: Column, window: str, zone: str) -> Column:
    """Start of the month, week (Monday) or day of each time in a zone, as a time; of a semester, 180 days before.

    In a session whose time zone is UTC. Where summer time begins or ends, the start has the offset of its own time.
    """
    if window == "semester":
        return time - F.expr("INTERVAL 180 DAYS")
    if window not in ("month", "week", "day"):
        raise ValueError(f"unknown window {window!r}")
    return F.to_utc_timestamp(F.date_trunc(window, F.from_utc_timestamp(time, zone)), zone)
