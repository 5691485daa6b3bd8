"""Editor documents (JSON trees of nodes) as token streams, by expressions over their nodes.

A document's nodes come level by level out of variants, each with its path of places from the root, until none is left,
so no depth is too deep. Opening tokens of a node stand at its path, closing ones after all paths below it, and sorting
by path gives the order of reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbank.functions.rich import NODE_TAGS
from quillbank.functions.tables import materialised
from quillbank.functions.text import FINGERPRINT_SPACE, nfkc

_LAST = 2**31 - 1
_LEAVES = ("text", "mathNode", "image", "hardBreak")
_MARKS = {"superscript": "sup", "subscript": "sub"}
_EDGES = FINGERPRINT_SPACE.replace(r"\x{200B}\x{FEFF}", r"\x{1C}-\x{1F}")  # what stripping takes away


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_EDGES}+|{_EDGES}+$", "")


def _string(node: Column, path: str) -> Column:
    """The string at a path; empty if there is something else, or nothing."""
    v = F.try_variant_get(node, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(node, path, "string")).otherwise("")


def _number(node: Column, path: str) -> Column:
    """The whole number at a path, 1 if there is something else, or it is below 0."""
    n = F.when(F.schema_of_variant(F.try_variant_get(node, path, "variant")) == "BIGINT", F.try_variant_get(node, path, "bigint"))
    return F.when(n >= 0, n).otherwise(1)


def _is_object(v: Column) -> Column:
    return v.try_cast("map<string,variant>").isNotNull()  # schema_of_variant() would look at all that is below


def document_nodes(documents: DataFrame) -> DataFrame:
    """(id, path, node) of all nodes of documents (id, document), of which each id has one; damaged ones have none."""
    level = documents.select("id", F.try_parse_json("document").alias("node")).where(_is_object(F.col("node")))
    level = materialised(level.select("id", F.array().cast("array<int>").alias("path"), "node"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        inner = level.where(~_string(F.col("node"), "$.type").isin(*_LEAVES))
        inner = inner.select("id", "path", F.posexplode(F.try_variant_get("node", "$.content", "array<variant>")).alias("place", "child"))
        level = materialised(inner.where(_is_object(F.col("child"))).select("id", F.concat("path", F.array("place")).alias("path"), F.col("child").alias("node")))
    out = levels[0] if levels else level
    for x in levels[1:]:
        out = out.unionByName(x)
    return materialised(out) if len(levels) > 1 else out


def _event(kind: Column, value: Column = None, said: Column = None, meaning: Column = None, unverified: Column = None, image: Column = None) -> Column:
    empty, no = F.lit(""), F.lit(False)
    given = [kind, empty if value is None else value, empty if said is None else said, no if meaning is None else meaning, no if unverified is None else unverified, F.lit(None).cast("string") if image is None else image]
    return F.struct(*(x.alias(n) for x, n in zip(given, ("kind", "value", "said", "meaningful", "unverified", "image"), strict=True)))


def _events(node: Column, words: Column, latex: Column) -> tuple[Column, Column]:
    """What a node says before its children, and after them; `words` and `latex` are its normalised text and formula."""
    kind = _string(node, "$.type")
    none = F.array().cast("array<struct<kind:string,value:string,said:string,meaningful:boolean,unverified:boolean,image:string>>")
    marks = F.transform(F.coalesce(F.try_variant_get(node, "$.marks", "array<variant>"), F.array().cast("array<variant>")), lambda m: F.when(_is_object(m), _string(m, "$.type")))
    tags = F.create_map(*(F.lit(x) for pair in _MARKS.items() for x in pair))
    raised = F.filter(F.transform(marks, lambda m: F.try_element_at(tags, m)), lambda x: x.isNotNull())
    opened = F.transform(raised, lambda x: _event(F.concat(F.lit("open:"), x)))
    closed = F.transform(F.reverse(raised), lambda x: _event(F.concat(F.lit("close:"), x)))
    plain = _string(node, "$.text")
    text = F.concat(opened, F.array(_event(F.lit("text"), words, plain, words != "")), closed)
    formula = F.when(words != "", F.array(_event(F.lit("formula"), latex, _stripped(_string(node, "$.attrs.latex")), F.lit(True)))).otherwise(none)
    key, source, alt = (_string(node, f"$.attrs.{x}") for x in ("resourceId", "src", "alt"))
    managed = F.array(_event(F.lit("image"), key, alt, F.lit(True), image=key))
    other = F.when(source != "", F.array(_event(F.lit("unmanaged-image"), F.sha2(source, 256), alt, unverified=F.lit(True)))).otherwise(F.array(_event(F.lit(""), said=alt)))
    image = F.when(_stripped(key) != "", managed).otherwise(other)
    line = F.array(_event(F.lit("break"), said=F.lit("\n")))
    names = F.create_map(*(F.lit(x) for pair in NODE_TAGS.items() for x in pair))
    level = F.least(F.greatest(_number(node, "$.attrs.level"), F.lit(1)), F.lit(6)).cast("string")
    tag = F.when(kind == "heading", F.concat(F.lit("h"), level)).otherwise(F.try_element_at(names, kind))
    spans = F.when(tag.isin("td", "th"), F.concat_ws(",", _number(node, "$.attrs.colspan").cast("string"), _number(node, "$.attrs.rowspan").cast("string"))).otherwise("")
    border = F.when(tag.isNotNull(), F.array(_event(F.concat(F.lit("open:"), tag), spans))).otherwise(none)
    after = F.when(tag.isNotNull() & ~kind.isin(*_LEAVES), F.array(_event(F.concat(F.lit("close:"), tag), said=F.lit("\n")))).otherwise(none)
    return F.when(kind == "text", text).when(kind == "mathNode", formula).when(kind == "image", image).when(kind == "hardBreak", line).otherwise(border), after


def document_tokens(documents: DataFrame) -> DataFrame:
    """(id, tokens, text, meaningful, unverified, image_ids) of documents (id, document).

    As rich.document_tokens() has them: neighbouring words are one token without spaces, in lower case; text is what can
    be searched. Ids have to be distinct. Documents that are null, no JSON or no object, or that repeat a member name,
    give no row. A document is gathered in one row.
    """
    nodes = document_nodes(documents)
    kind = _string(F.col("node"), "$.type")
    own = F.when(kind == "text", _string(F.col("node"), "$.text")).when(kind == "mathNode", _stripped(_string(F.col("node"), "$.attrs.latex"))).otherwise("")
    nodes = nodes.withColumn("normal", nfkc(own)).withColumn("words", F.regexp_replace(F.lower("normal"), FINGERPRINT_SPACE, ""))
    before, after = _events(F.col("node"), F.col("words"), F.col("normal"))
    says = nodes.select("id", F.explode(F.array(F.struct(F.col("path"), before.alias("events")), F.struct(F.concat("path", F.array(F.lit(_LAST))).alias("path"), after.alias("events")))).alias("x"))
    says = says.select("id", F.col("x.path").alias("path"), F.posexplode_outer("x.events").alias("seq", "event"))
    order = Window.partitionBy("id").orderBy("path", "seq")
    silent = F.col("event").isNull() | (F.col("event.kind") == "") | ((F.col("event.kind") == "text") & (F.col("event.value") == ""))
    # A run is a token: neighbouring words together, with nothing but silent pieces between them.
    last = F.last(F.when(~F.col("silent"), F.col("event.kind")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    says = says.withColumn("silent", silent).withColumn("starts", ~F.col("silent") & ~((F.col("event.kind") == "text") & F.coalesce(last == "text", F.lit(False))))
    says = says.withColumns({"run": F.sum(F.col("starts").cast("int")).over(order), "place": F.row_number().over(order)})
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", c.alias("c")))), lambda x: x["c"]), "")
    runs = says.groupBy("id", "run").agg(
        F.min(F.when(~F.col("silent"), F.col("event.kind"))).alias("kind"), in_order(F.when(~F.col("silent"), F.col("event.value"))).alias("value"), in_order(F.coalesce("event.said", F.lit(""))).alias("said"),
        F.max(F.coalesce("event.meaningful", F.lit(False))).alias("meaningful"), F.max(F.coalesce("event.unverified", F.lit(False))).alias("unverified"), F.collect_set("event.image").alias("images"),
    )
    token = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("run", "kind", "value")))), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "said"))), lambda x: x["said"]), "")
    return runs.groupBy("id").agg(token.alias("tokens"), _stripped(said).alias("text"), F.max("meaningful").alias("meaningful"), F.max("unverified").alias("unverified"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("images")))).alias("image_ids"))
