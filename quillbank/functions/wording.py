"""Small text rules of imports and papers: numerals, labels, answers, placeholders, formula tokens, signatures."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from quillbank.functions.text import nfkc

DIGITS = "一二三四五六七八九"
FORMULA_OPEN, FORMULA_CLOSE, OBJECT_MARK = "\ue000", "\ue001", "\ufffc"


def numeral_value(text: str) -> int | None:
    """Whole number above 0 written in digits or Chinese numerals up to hundreds."""
    if text.isascii() and text.isdigit():
        return int(text) or None
    if not text or any(c not in DIGITS + "十百" for c in text):
        return None
    total = last = 0
    for c in text:
        if c in DIGITS:
            last = DIGITS.index(c) + 1
        else:
            total, last = total + (last or 1) * (100 if c == "百" else 10), 0
    return total + last or None


def chinese_numeral(n: Column) -> Column:
    """Numeral of 1 to 99; digits beyond."""
    names = F.array(*(F.lit(c) for c in DIGITS))
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    name = lambda k: F.try_element_at(names, k)
    ten = F.concat(F.when(tens > 1, name(tens)).otherwise(F.lit("")), F.lit("十"))
    below = F.concat(F.when(tens > 0, ten).otherwise(F.lit("")), F.when(ones > 0, name(ones)).otherwise(F.lit("")))
    return F.when((n >= 1) & (n <= 99), below).otherwise(n.cast("string"))


@F.pandas_udf(LongType())
def _value(texts: pd.Series) -> pd.Series:
    return pd.Series([numeral_value(x) if x is not None else None for x in texts], dtype="Int64")


def from_numeral(text: Column) -> Column:
    """Number of a numeral, null if it is none."""
    return _value(F.trim(nfkc(text)))


def column_label(i: Column) -> Column:
    """Name of worksheet column i (from 0): A to Z, AA to ZZ."""
    letter = lambda k: F.char(k.cast("int") + 65)
    return F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26) - 1), letter(i % 26)))


def xml_escaped(text: Column) -> Column:
    """Text for XML content and attributes."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def without_placeholder(text: Column) -> Column:
    """Empty if the text is only the mark of an empty field."""
    return F.when(F.rlike(F.trim(nfkc(text)), F.lit(r"^\(\s*未填写\s*\)[。.．]?$")), "").otherwise(text)


def remapped_answer(before: Column, after: Column, answer: Column) -> Column:
    """Struct (answer, review) after options with ids `before` became those with ids `after`.

    Letters follow their options, sorted and each once; an option that is gone empties the answer; what is not a list
    of letters stays. The last two ask for review.
    """
    plain = F.upper(F.trim(nfkc(F.coalesce(answer, F.lit("")))))
    letters = F.regexp_extract_all(plain, F.lit("[A-Z]"), 0)
    places = F.transform(letters, lambda x: F.array_position(after, F.try_element_at(before, F.ascii(x) - 64)))
    lost = F.exists(places, lambda p: F.coalesce(p, F.lit(0)) == 0)
    moved = F.array_join(F.transform(F.array_sort(F.array_distinct(places)), lambda p: F.char(p.cast("int") + 64)), "、")
    listed = F.rlike(plain, F.lit(r"^[A-Z](?:[\s、,，;；]*[A-Z])*$"))
    out = F.when(~listed, F.struct(answer.alias("answer"), (plain != "").alias("review")))
    out = out.when(lost, F.struct(F.lit("").alias("answer"), F.lit(True).alias("review")))
    return out.otherwise(F.struct(moved.alias("answer"), F.lit(False).alias("review")))


def framed_hash(*fields: Column) -> Column:
    """SHA-256 over fields framed by their lengths in bytes; null differs from empty."""
    framed = [F.when(x.isNull(), F.lit("-;")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in fields]
    return F.sha2(F.concat(*framed), 256)


def fnv1a(text: str) -> str:
    """FNV-1a of 32 bits over UTF-16 units, 8 hex digits."""
    units, h = memoryview(text.encode("utf-16-le", "surrogatepass")).cast("H"), 0x811C9DC5
    for x in units:
        h = (h ^ x) * 0x01000193 & 0xFFFFFFFF
    return f"{h:08x}"


@F.pandas_udf(StringType())
def _fnv(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else fnv1a(x))


def layout_signature(title: Column, mode: Column, template: Column, items: Column) -> Column:
    """Signature of a paper's layout: items are structs (id, position, version, updated_at) in order."""
    lines = F.transform(items, lambda x: F.concat_ws(":", x["id"], x["position"].cast("string"), x["version"].cast("string"), x["updated_at"].cast("string")))
    source = F.concat_ws("|", F.concat(F.array(title, mode, F.coalesce(template, F.lit(""))), lines))
    return F.concat(F.lit("paper-v1:"), F.size(items).cast("string"), F.lit(":"), _fnv(source))


def canonical(value, dropped: frozenset = frozenset({"id"}), unordered: frozenset = frozenset({"tagIds"})):
    """value with sorted keys, without `dropped` keys, lists under `unordered` keys sorted."""
    if isinstance(value, dict):
        out = {k: canonical(value[k], dropped, unordered) for k in sorted(value) if k not in dropped}
        return {k: sorted(v, key=lambda x: json.dumps(x, sort_keys=True)) if k in unordered and isinstance(v, list) else v for k, v in out.items()}
    return [canonical(x, dropped, unordered) for x in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    def one(x):
        try:
            return None if x is None else json.dumps(canonical(json.loads(x)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return x

    return texts.map(one)


def semantic_signature(document: Column) -> Column:
    """SHA-256 of a JSON text in canonical form: equal meaning, equal signature. Damaged JSON counts as it stands."""
    return F.sha2(_canonical(document), 256)


def inject_formulas(text: str, formulas: list[tuple[int, str]]) -> str:
    """text with a token for each (offset, node id): in place of an object mark, else before that character."""
    chars = list(text)
    for at, key in sorted(formulas, key=lambda f: -f[0]):
        here = chars[at : at + 1] == [OBJECT_MARK]
        chars[at : at + here] = [f"{FORMULA_OPEN}{key}{FORMULA_CLOSE}"]
    return "".join(chars)


def formula_text(text: Column, latex: Column) -> Column:
    r"""Plain text: tokens become \( \) around the LaTeX that map `latex` has for them, [公式] if none, as do object marks."""
    token = f"{FORMULA_OPEN}[^{FORMULA_CLOSE}]*{FORMULA_CLOSE}"
    keys = F.transform(F.regexp_extract_all(text, F.lit(token), 0), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    shown = F.transform(keys, lambda k: F.coalesce(F.concat(F.lit("\\("), F.try_element_at(latex, k), F.lit("\\)")), F.lit("[公式]")))
    plain = F.split(text, token, -1)
    woven = F.zip_with(plain, shown, lambda a, b: F.concat(F.replace(a, F.lit(OBJECT_MARK), F.lit("[公式]")), F.coalesce(b, F.lit(""))))
    return F.array_join(woven, "")
