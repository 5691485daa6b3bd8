"""Rich content (HTML or an editor's document tree) as token streams: search text, identity, comparability, safety.

Parsing is recursive, which no Spark expression is, so it runs on Arrow batches; image hashes, comparison of the two
forms and the fingerprint are Spark expressions over the tokens.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

#: Elements whose borders are part of the identity.
STRUCTURE = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "ul", "ol", "li", "table", "tr", "td", "th", "sup", "sub")
#: Document node types and the elements that they stand for.
NODE_TAGS = {
    "paragraph": "p",
    "blockquote": "blockquote",
    "bulletList": "ul",
    "orderedList": "ol",
    "listItem": "li",
    "table": "table",
    "tableRow": "tr",
    "tableCell": "td",
    "tableHeader": "th",
}
#: What rich content must not hold.
UNSAFE = ("<script", "<iframe", "<object", "<embed", "<link", "<meta", "<base", "javascript:", "data:text/html", "srcdoc=")
FINGERPRINT_VERSION = 2
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HIDDEN, _OPAQUE = {"script", "style", "template"}, {"svg", "math", "object"}
#: What an opening tag ends if it is still open, up to the nearest of the containers.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"})}
_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "ul", "ol", "table", "div", "hr", "pre"}

_TOKEN = StructType([StructField("kind", StringType()), StructField("value", StringType())])
PARSED = StructType(
    [
        StructField("tokens", ArrayType(_TOKEN)),
        StructField("text", StringType()),
        StructField("meaningful", BooleanType()),
        StructField("unverified", BooleanType()),
        StructField("image_ids", ArrayType(StringType())),
    ]
)


_NO_SPACES = dict.fromkeys(map(ord, " \t\n\v\f\r"))


def squeezed(text: str) -> str:
    """Normalised, lower case, without white space and invisible marks."""
    if text.isascii():
        return text.lower().translate(_NO_SPACES)
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if not c.isspace() and c not in "\u200b\ufeff" or c in "\x1c\x1d\x1e\x1f")


class Tokens:
    """Collects tokens and search text in reading order; neighbouring words join in one token."""

    def __init__(self):
        self.tokens, self.said, self.images = [], [], []
        self.meaningful = self.unverified = False

    def words(self, text: str) -> None:
        self.said.append(text)
        plain = squeezed(text)
        if plain:
            self.meaningful = True
            if self.tokens and self.tokens[-1]["kind"] == "text":
                self.tokens[-1]["value"] += plain
            else:
                self.mark("text", plain)

    def mark(self, kind: str, value: str = "") -> None:
        self.tokens.append({"kind": kind, "value": value})

    def border(self, tag: str, opening: bool, detail: str = "") -> None:
        self.mark(f"{'open' if opening else 'close'}:{tag}", detail)
        if not opening and tag not in ("sup", "sub"):
            self.said.append("\n")

    def line_break(self) -> None:
        self.mark("break")
        self.said.append("\n")

    def formula(self, latex: str) -> None:
        """Case and inner spaces of LaTeX matter."""
        if squeezed(latex):
            self.meaningful = True
            self.said.append(latex.strip())
            self.mark("formula", unicodedata.normalize("NFKC", latex.strip()))

    def image(self, key: str, source: str, alt: str) -> None:
        if key.strip():
            self.meaningful = True
            self.images.append(key)
            self.mark("image", key)
        elif source:
            self.unverified = True
            self.mark("unmanaged-image", _sha(source))
        self.said.append(alt)

    def opaque(self, markup: str) -> None:
        self.unverified = True
        self.mark("opaque", _sha(markup))

    def row(self) -> dict:
        return {"tokens": self.tokens, "text": "".join(self.said).strip(), "meaningful": self.meaningful, "unverified": self.unverified, "image_ids": sorted(set(self.images))}


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class _Reader(HTMLParser):
    """Feeds Tokens from markup; omitted end tags are supplied, stray ones ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open = Tokens(), []
        self.skipped, self.depth, self.markup = None, 0, []

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            self.depth += tag == self.skipped
            self.markup.append(self.get_starttag_text())
            return
        a = {k: v or "" for k, v in attrs}
        self._imply(tag)
        if tag in _HIDDEN or tag in _OPAQUE or "data-latex" in a:
            if "data-latex" in a and tag not in _HIDDEN:
                self.out.formula(a["data-latex"])
            if tag not in _VOID:
                self.skipped, self.depth, self.markup = tag, 1, [self.get_starttag_text() if tag in _OPAQUE and "data-latex" not in a else None]
        elif tag == "img":
            self.out.image(a.get("data-resource-id", ""), a.get("src", ""), a.get("alt", ""))
        elif tag == "br":
            self.out.line_break()
        elif tag not in _VOID:
            if tag in STRUCTURE:
                self.out.border(tag, True, f"{a.get('colspan', '1')},{a.get('rowspan', '1')}" if tag in ("td", "th") else "")
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.skipped or tag in _OPAQUE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skipped:
            self.markup.append(f"</{tag}>")
            self.depth -= tag == self.skipped
            if not self.depth:
                if self.markup[0] is not None:
                    self.out.opaque("".join(x for x in self.markup if x))
                self.skipped = None
        elif tag in self.open:
            self._leave(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data):
        if self.skipped:
            self.markup.append(data)
        else:
            self.out.words(data)

    def _imply(self, tag):
        if tag in _BLOCKS and "p" in self.open:
            self._leave(len(self.open) - 1 - self.open[::-1].index("p"))
        ended, limits = _ENDS.get(tag, ((), ()))
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in limits and self.open[i] not in ended:
                return
            if self.open[i] in ended:
                self._leave(i)
                if tag != "tr":
                    return

    def _leave(self, i):
        for tag in reversed(self.open[i:]):
            if tag in STRUCTURE:
                self.out.border(tag, False)
        del self.open[i:]

    def finished(self) -> Tokens:
        self.close()
        if self.skipped and self.markup[0] is not None:
            self.out.opaque("".join(x for x in self.markup if x))
        self._leave(0)
        return self.out


def html_tokens(html: str) -> Tokens:
    """Tokens of markup."""
    reader = _Reader()
    reader.feed(html)
    return reader.finished()


def _number(x, otherwise: int) -> int:
    return x if isinstance(x, int) and not isinstance(x, bool) and x >= 0 else otherwise


def document_tokens(root: dict) -> Tokens:
    """Tokens of an editor's document tree; walked without recursion, so that no depth is too deep."""
    out, todo = Tokens(), [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.border(node, False)
            continue
        if not isinstance(node, dict):
            continue
        attrs = node["attrs"] if isinstance(node.get("attrs"), dict) else {}
        named = lambda key: v if isinstance(v := attrs.get(key), str) else ""  # noqa: B023, E731
        match node.get("type"):
            case "text":
                marks = node["marks"] if isinstance(node.get("marks"), list) else []
                raised = [{"superscript": "sup", "subscript": "sub"}.get(m.get("type")) for m in marks if isinstance(m, dict)]
                raised = [x for x in raised if x]
                for tag in raised:
                    out.border(tag, True)
                out.words(node["text"] if isinstance(node.get("text"), str) else "")
                for tag in reversed(raised):
                    out.border(tag, False)
            case "mathNode":
                out.formula(named("latex"))
            case "image":
                out.image(named("resourceId"), named("src"), named("alt"))
            case "hardBreak":
                out.line_break()
            case kind:
                tag = f"h{min(6, max(1, _number(attrs.get('level'), 1)))}" if kind == "heading" else NODE_TAGS.get(kind if isinstance(kind, str) else "")
                if tag:
                    out.border(tag, True, f"{_number(attrs.get('colspan'), 1)},{_number(attrs.get('rowspan'), 1)}" if tag in ("td", "th") else "")
                    todo.append(tag)
                if isinstance(node.get("content"), list):
                    todo.extend(reversed([x for x in node["content"] if isinstance(x, dict)]))
    return out


def _tree(document) -> dict | None:
    if not isinstance(document, str) or not document.strip():
        return None
    try:
        tree = json.loads(document)
    except ValueError:
        return None
    return tree if isinstance(tree, dict) else None


def parts(html: str | None, document: str | None, plain: str | None) -> tuple[dict, dict | None]:
    """What counts (HTML, else the document, else plain text as one paragraph) and, beside HTML, the document."""
    tree = _tree(document)
    if html and html.strip():
        return html_tokens(html).row(), document_tokens(tree).row() if tree is not None else None
    if tree is not None:
        return document_tokens(tree).row(), None
    return document_tokens({"type": "paragraph", "content": [{"type": "text", "text": plain or ""}]}).row(), None


_ARROW_PARSED = pa.struct(
    [
        ("tokens", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))),
        ("text", pa.string()),
        ("meaningful", pa.bool_()),
        ("unverified", pa.bool_()),
        ("image_ids", pa.list_(pa.string())),
    ]
)


def _parts_of(html: pa.Array, document: pa.Array, plain: pa.Array) -> pa.Array:
    """Equal content of a batch is parsed once."""
    place, at = {}, []
    for x in zip(html.to_pylist(), document.to_pylist(), plain.to_pylist(), strict=True):
        at.append(place.setdefault(x, len(place)))
    rows = [dict(zip(("main", "other"), parts(*x), strict=True)) for x in place]
    return pa.array(rows, pa.struct([("main", _ARROW_PARSED), ("other", _ARROW_PARSED)])).take(pa.array(at, pa.int32()))


@F.arrow_udf(StructType([StructField("main", PARSED), StructField("other", PARSED)]))
def _parts(html: pa.Array, document: pa.Array, plain: pa.Array) -> pa.Array:
    return _parts_of(html, document, plain)


def rich_parts(html: Column, document: Column, plain: Column) -> Column:
    """Parsed content: `main`, and `other` for a document that stands beside HTML. Damaged documents count as none."""
    return _parts(html, document, plain)


def search_text(parsed: Column) -> Column:
    """Text to search: blocks end lines, formulas are LaTeX, images their alternative text."""
    return parsed["main"]["text"]


def has_content(parsed: Column) -> Column:
    """Whether there is a visible character, a formula or a managed image."""
    return parsed["main"]["meaningful"]


def image_ids(parsed: Column) -> Column:
    """Resource ids of the images in either form."""
    return F.array_union(parsed["main"]["image_ids"], F.coalesce(parsed["other"]["image_ids"], F.array().cast("array<string>")))


def _known(tokens: Column, hashes: Column) -> Column:
    identity = lambda t: F.coalesce(F.concat(F.lit("sha256:"), F.try_element_at(hashes, t["value"])), F.concat(F.lit("unresolved-resource:"), t["value"]))
    return F.transform(tokens, lambda t: F.when(t["kind"] == "image", F.struct(t["kind"].alias("kind"), identity(t).alias("value"))).otherwise(t))


def content_identity(parsed: Column, hashes: Column, ooxml: Column) -> Column:
    """Struct (tokens, comparable) of one field: images by the hash that map `hashes` has for their id.

    Not comparable: an image without hash, opaque markup, or a document that differs from its HTML.
    """
    main, other = _known(parsed["main"]["tokens"], hashes), _known(parsed["other"]["tokens"], hashes)
    token = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    differs = other.isNotNull() & (main != other)
    tokens = F.when(differs, F.concat(main, token("document-differs-from-html", F.lit("")), other)).otherwise(main)
    source = F.when(F.trim(ooxml) != "", F.sha2(F.encode(ooxml, "UTF-8"), 256))
    tokens = F.when(source.isNotNull(), F.concat(tokens, token("source-ooxml", source))).otherwise(tokens)
    missing = F.exists(image_ids(parsed), lambda x: F.try_element_at(hashes, x).isNull())
    unverified = parsed["main"]["unverified"] | F.coalesce(parsed["other"]["unverified"], F.lit(False)) | differs | missing
    return F.struct(tokens.alias("tokens"), (~unverified).alias("comparable"))


def rich_fingerprint(kind: Column, options: Column, others: list[Column]) -> Column:
    """SHA-256 of version, question type, number of options and the tokens of every field (from content_identity).

    `others` are stem, answer and explanation; `options` is an array of such fields, which stand after the stem.
    """
    fields = F.concat(F.array(others[0]["tokens"]), F.transform(options, lambda x: x["tokens"]), F.array(*(x["tokens"] for x in others[1:])))
    return F.sha2(F.to_json(F.struct(F.lit(FINGERPRINT_VERSION).alias("v"), kind.alias("k"), F.size(options).alias("n"), fields.alias("f"))), 256)


def all_comparable(options: Column, others: list[Column]) -> Column:
    """Whether every field is comparable."""
    out = F.forall(options, lambda x: x["comparable"])
    for x in others:
        out = out & x["comparable"]
    return out


def with_hashes(rows: DataFrame, key: str, ids: Column, resources: DataFrame, name: str = "hashes") -> DataFrame:
    """rows with map `name` from each of its image ids to the hash that resources (id, sha256) has.

    Only pairs of key and id are shuffled; rows without images get an empty map.
    """
    wanted = rows.select(F.col(key).alias("__key"), F.explode(F.array_distinct(ids)).alias("__id")).dropDuplicates()
    found = wanted.join(resources.select(F.col("id").alias("__id"), "sha256"), "__id")
    maps = found.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("__id", "sha256"))).alias(name))
    out = rows.join(maps, rows[key] == maps["__key"], "left").drop("__key")
    return out.withColumn(name, F.coalesce(name, F.create_map().cast("map<string,string>")))


def is_unsafe(html: Column) -> Column:
    """Whether markup holds active content: an element or address of UNSAFE, or an event handler in a tag."""
    flat = F.lower(F.regexp_replace(html, r"[ \t\n\f\r]+", " "))
    handler = F.rlike(flat, F.lit(r"<[a-z][^<>]*[\s/\"']on[a-z]+\s*="))
    found = handler
    for x in UNSAFE:
        found = found | F.contains(flat, F.lit(x))
    return F.coalesce(found, F.lit(False))


def has_reserved_mark(text: Column) -> Column:
    """Whether text holds the record or unit separator."""
    return F.coalesce(F.rlike(text, F.lit("[\\x{1E}\\x{1F}]")), F.lit(False))


def compact_stem(html: Column) -> Column:
    """Markup of a stem for lists: tables and images become [表格] and [图片], active elements go."""
    out = F.regexp_replace(html, r"(?is)<(script|style|template|iframe|object)\b.*?</\1\s*>", "")
    # Tables from the inside out, as often as there are any, so that nested ones are one.
    tables = F.regexp_count(out, F.lit(r"(?i)<table\b"))
    inner = r"(?is)<table\b(?:(?!<table\b).)*?</table\s*>"
    inside = lambda found: F.transform(F.array(found), lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(tables, F.lit(1))), x, lambda text, _: F.regexp_replace(text, inner, "[表格]")))[0]
    out = inside(out)
    return F.regexp_replace(out, r"(?is)<img\b[^>]*>", "[图片]")
