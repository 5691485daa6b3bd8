"""Queries of changes that reach several tables (deletes, overwrites, restores, merges), of JSON edits and of names in order, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillbank.functions import json_edit, wording
from quillbank.functions import text as T
from quillbank.operators import bank, dedup, deletes, document_tree, history, offsets, overwrites, stats
from quillbank.operators.deletes import Link
from quillbank.plans.bank_queries import query
from quillbank.plans.content_queries import _versions

_KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber")}
#: Regions stand for subjects, nations for chapters, customers for templates, orders for papers, lines for their items.
_LINKS = [
    Link("nation", ("n_regionkey",), "region", ("r_regionkey",), "restrict"),
    Link("supplier", ("s_nationkey",), "nation", ("n_nationkey",), "set null"),
    Link("customer", ("c_nationkey",), "nation", ("n_nationkey",), "restrict"),
    Link("orders", ("o_custkey",), "customer", ("c_custkey",), "cascade"),
    Link("lineitem", ("l_orderkey",), "orders", ("o_orderkey",), "cascade"),
    Link("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",), "restrict"),
]


def _tables(t):
    return {name: t(name) for name in _KEYS}


@query("""SELECT 'orders' AS kind, o_orderkey AS id, 0 AS line FROM orders WHERE o_custkey % 10 <> 3 UNION ALL
    SELECT 'lineitem', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)""")
def delete_cascades(t):
    """Customers deleted with their orders and lines: what is left of both."""
    c = t("customer")
    changed, _ = deletes.deleted(_tables(t), _KEYS, _LINKS, "customer", c.where("c_custkey % 10 = 3").select("c_custkey"))
    left = changed["orders"].select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("id"), F.lit(0).alias("line"))
    return left.unionByName(changed["lineitem"].select(F.lit("lineitem").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("line")))


@query("""WITH asked AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT -1), lines AS (SELECT l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 47) GROUP BY 1)
    SELECT id, CASE WHEN id = -1 THEN 'missing' ELSE 'lineitem' END AS blocked_by, coalesce(n, 0) AS rows FROM asked LEFT JOIN lines ON l_suppkey = id WHERE id = -1 OR n > 0""")
def delete_refused(t):
    """Deletes of suppliers that lines of a large quantity still name, and of one that is not there."""
    s = t("supplier")
    tables = _tables(t) | {"lineitem": t("lineitem").where("l_quantity > 47")}
    asked = s.where("s_suppkey % 2 = 0").select("s_suppkey").union(s.select(F.lit(-1)).limit(1))
    return deletes.deleted(tables, _KEYS, _LINKS, "supplier", asked)[1].select(F.col("s_suppkey").cast("long").alias("id"), "blocked_by", "rows")


@query("""SELECT s_suppkey AS id, CASE WHEN s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 29 = 0) THEN NULL ELSE s_nationkey END AS nation FROM supplier""")
def delete_sets_null(t):
    """All nations deleted that no customer of a sample still names: their suppliers lose the reference."""
    tables = _tables(t) | {"customer": t("customer").where("c_custkey % 29 = 0")}
    changed, _ = deletes.deleted(tables, _KEYS, _LINKS, "nation", t("nation").select("n_nationkey"))
    return changed["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))


def _full_bank(t):
    part = t("part")
    none = F.lit(None).cast("long")
    words = part.select(F.col("p_partkey").alias("question_id"), F.posexplode(F.split("p_name", " ")).alias("position", "text"))
    return {
        "questions": part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("stem"), F.col("p_brand").alias("answer"), F.col("p_size").cast("long").alias("content_version"), F.lit(0).cast("long").alias("updated_at_ms"), F.when(F.col("p_partkey") % 7 == 0, 1).cast("long").alias("deleted_at_ms")),
        "options": words,
        "tags": part.select(F.col("p_partkey").alias("question_id"), F.explode(F.split("p_type", " ")).alias("tag_id")).distinct(),
        "refs": part.select(F.col("p_partkey").alias("question_id"), F.col("p_size").alias("resource_id")),
        "history": part.limit(0).select(F.col("p_partkey").alias("question_id"), none.alias("content_version"), none.alias("saved_at_ms"), F.lit("").alias("snapshot")),
        "receipts": part.limit(0).select(F.col("p_partkey").alias("operation_id"), *(F.lit("").alias(c) for c in ("request_hash", "result_json")), none.alias("created_at_ms"), none.alias("completed_at_ms")),
    }


def _operations(t):
    """Operations of up to 20 questions; every fourth was read at another version, and of every five one is on record and one with other content."""
    part = t("part").where("p_partkey % 3 = 0 and p_partkey % 7 <> 0")
    op = F.floor(F.col("p_partkey") / 60)
    items = part.select(
        op.alias("operation_id"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("client_id"), F.col("p_partkey").alias("question_id"), (F.col("p_size") + (op % 4 == 1).cast("int")).cast("long").alias("expected_version"),
        F.concat(F.lit("new "), F.col("p_name")).alias("stem"), F.array(F.lit("x"), F.lit("y")).alias("options"), F.array(F.lit("NEW")).alias("tags"), F.array("p_size").alias("refs"),
    )
    known = overwrites.request_hashes(items).where("operation_id % 5 in (2, 3)")
    stamp = F.lit(1).cast("long")
    receipts = known.select("operation_id", F.when(F.col("operation_id") % 5 == 2, F.col("request_hash")).otherwise(F.lit("x")).alias("request_hash"), F.lit("[]").alias("result_json"), stamp.alias("created_at_ms"), stamp.alias("completed_at_ms"))
    return items, _full_bank(t) | {"receipts": receipts}


_OUTCOME = "CASE WHEN op % 5 = 2 THEN 'replay' WHEN op % 5 = 3 THEN 'conflict' WHEN op % 4 = 1 THEN 'version' ELSE 'applied' END"


@query(f"SELECT DISTINCT op AS operation_id, {_OUTCOME} AS outcome FROM (SELECT p_partkey // 60 AS op FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 7 <> 0)")
def overwrite_outcomes(t):
    """What becomes of each operation of overwrites."""
    items, full = _operations(t)
    return overwrites.overwrite_outcomes(full, items).select("operation_id", "outcome")


@query(f"""WITH q AS (SELECT *, p_partkey // 60 AS op FROM part), d AS (SELECT *, p_partkey % 3 = 0 AND p_partkey % 7 <> 0 AND {_OUTCOME} = 'applied' AS hit FROM q)
    SELECT p_partkey AS id, CASE WHEN hit THEN 'new ' || p_name ELSE p_name END AS stem, CAST(p_size + hit::INT AS BIGINT) AS content_version, CASE WHEN hit THEN 'NEW' ELSE array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), '|') END AS tags,
    CASE WHEN hit THEN 2 ELSE len(string_split(p_name, ' ')) END AS options, CAST(hit AS BIGINT) AS versions FROM d""")
def overwrites_applied_twice(t):
    """Operations applied, and sent again, which changes nothing more."""
    items, full = _operations(t)
    once, _ = overwrites.overwritten(full, items, 9)
    twice, _ = overwrites.overwritten(once, items, 10)
    tags = twice["tags"].groupBy(F.col("question_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("tag_id")), "|").alias("tags"))
    options = twice["options"].groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("options"))
    versions = twice["history"].groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("versions"))
    out = twice["questions"].join(tags, "id", "left").join(options, "id", "left").join(versions, "id", "left")
    return out.select("id", "stem", "content_version", "tags", "options", F.coalesce("versions", F.lit(0)).alias("versions"))


@query("""WITH r AS (SELECT *, CASE WHEN p_partkey % 2 = 1 THEN NULL WHEN p_partkey % 3 = 0 THEN 'missing' WHEN p_partkey % 5 = 0 THEN 'version' WHEN list_contains(string_split(p_type, ' '), 'SMALL') THEN 'lost' ELSE 'restored' END AS outcome FROM part)
    SELECT p_partkey AS id, outcome, CASE WHEN outcome = 'lost' THEN 'SMALL' ELSE '' END AS lost, CASE WHEN outcome = 'restored' THEN 'old ' || p_name ELSE p_name END AS stem, CAST(p_size + CASE WHEN outcome = 'restored' THEN 1 ELSE 0 END AS BIGINT) AS content_version,
    CASE WHEN outcome = 'restored' THEN 'old' ELSE array_to_string(string_split(p_name, ' '), '|') END AS options FROM r""")
def versions_restored(t):
    """Questions brought back to a version of the history, where tags and versions allow it."""
    full = _full_bank(t)
    old = full["questions"].where("id % 3 <> 0").withColumns({"stem": F.concat(F.lit("old "), F.col("stem")), "content_version": F.lit(0).cast("long")})
    option = old.select(F.col("id").alias("question_id"), F.lit(0).alias("position"), F.lit("old").alias("text"))
    kept = history.snapshots(old, option, full["tags"].where("question_id % 3 <> 0"))
    full["history"] = kept.select(F.col("id").alias("question_id"), *(F.lit(0).cast("long").alias(c) for c in ("content_version", "saved_at_ms")), "snapshot")
    asked = full["questions"].where("id % 2 = 0").select(F.col("id").alias("question_id"), F.lit(0).cast("long").alias("content_version"), (F.col("content_version") + (F.col("id") % 5 == 0).cast("int")).alias("expected_version"))
    now, outcomes = overwrites.restored(full, asked, full["tags"].select("tag_id").distinct().where("tag_id <> 'SMALL'"), 9)
    options = now["options"].groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("x"))
    out = now["questions"].join(options, "id", "left").join(outcomes.withColumnRenamed("question_id", "id"), "id", "left")
    lost = F.when(F.col("outcome") == "lost", F.array_join("lost", "|")).otherwise("")
    return out.select("id", "outcome", lost.alias("lost"), "stem", "content_version", F.array_join(F.transform("x", lambda x: x["text"]), "|").alias("options"))


@query("""WITH members AS (SELECT *, max(p_partkey) OVER w AS keeper, count(*) OVER w AS n, min(p_type) OVER w = max(p_type) OVER w AS alike, CAST(right(p_brand, 1) AS INTEGER) AS d
    FROM (SELECT *, min(p_size) OVER (PARTITION BY p_brand, p_partkey % 40) AS s FROM part) WHERE p_size = s WINDOW w AS (PARTITION BY p_brand, p_partkey % 40)),
    fine AS (SELECT * FROM members WHERE n >= 2 AND d <> 5 AND (d % 3 <> 0 OR alike))
    SELECT p_partkey AS id, CAST(p_size + (p_partkey IN (SELECT p_partkey FROM fine))::INT AS BIGINT) AS content_version, p_partkey IN (SELECT p_partkey FROM fine WHERE p_partkey <> keeper) AS binned FROM part""")
def merge_kinds(t):
    """Groups merged into a keeper that is named: exact ones only if all content is equal, none whose keeper is no member."""
    v = _versions(t).withColumn("group_id", F.concat_ws("/", "group_id", F.col("id") % 40)).join(t("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("fingerprint")), "id")
    smallest = v.groupBy("group_id").agg(F.min("content_version").alias("content_version"))
    members = v.join(smallest, ["group_id", "content_version"])
    digit = F.substring(F.split("group_id", "/")[0], -1, 1).cast("int")
    keepers = members.groupBy("group_id").agg(F.max("id").alias("keeper_id")).withColumn("keeper_id", F.when(digit == 5, -1).otherwise(F.col("keeper_id")))
    asked = members.join(keepers, "group_id").select("group_id", "id", F.col("content_version").alias("expected_version"), "keeper_id", F.when(digit % 3 == 0, "exact").otherwise("suspected").alias("kind"))
    out = dedup.merge_checked(v.drop("group_id"), asked, 5, most_members=None)
    return out.select("id", "content_version", F.col("deleted_at_ms").isNotNull().alias("binned"))


@query("""SELECT event_id AS id, '{"k":' || (k + 1) || ',"by":{"type":"' || event_type || '","n":[1,"x"],"value":null}}' AS edited, '{"k":' || k || '}' AS undone FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def json_edits(t):
    """Members replaced, added and removed at several depths of the properties of events."""
    props = F.col("props")
    k = F.get_json_object(props, "$.k").cast("long")
    by = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "n": [1], "value": true}'))
    out = json_edit.json_edited(props, [(["k"], (k + 1).cast("string")), (["by"], by), (["by", "n", 1], F.lit('"x"')), (["by", "value"], F.lit("null"))])
    undone = json_edit.json_edited(F.col("edited"), [(["k"], F.col("k").cast("string")), (["by"], None)])
    # The edits are computed once, in a step of their own.
    return t("events").select(F.col("event_id").alias("id"), k.alias("k"), out.alias("edited")).select("id", "edited", undone.alias("undone"))


@query("""SELECT event_id AS id, event_id % 5 <> 1 AS valid, CASE event_id % 5 WHEN 0 THEN 'object' WHEN 2 THEN 'array' WHEN 3 THEN 'text' WHEN 4 THEN CASE WHEN value >= 20 THEN 'true' ELSE 'false' END END AS root,
    CASE event_id % 5 WHEN 0 THEN 'integer' END AS member, CASE event_id % 5 WHEN 2 THEN 'real' END AS element FROM events""")
def json_types(t):
    """Which texts are JSON, and what stands at their root, at a member and at an element."""
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat("props", F.lit("}"))).when(kind == 2, F.concat(F.lit("["), F.col("value") + 0.5, F.lit(",null]")))
    text = text.when(kind == 3, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise((F.col("value") >= 20).cast("string"))
    types = {"root": json_edit.json_type(text), "member": json_edit.json_type(text, ["k"]), "element": json_edit.json_type(text, [0])}
    return t("events").select(F.col("event_id").alias("id"), json_edit.json_valid(text).alias("valid"), *(x.alias(c) for c, x in types.items()))


#: Names whose order in the language (as they stand here) and in binary differ.
_NAMES = "地理 化学 历史 美术 生物 数学 物理 音乐 英语 语文 政治".split()
_NAMED = "names AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _NAMES) + "]) AS name, unnest(range(11)) AS place)"


def _name(number):
    """The name of each number; 7 steps apart, so that numbers and names are not in one order."""
    return F.element_at(F.array(*(F.lit(x) for x in _NAMES)), (number * 7 % 11 + 1).cast("int"))


@query(f"""WITH {_NAMED} SELECT name, n.sort_order, count(*) AS questions, CAST(row_number() OVER (ORDER BY count(*) DESC, n.sort_order, any_value(place)) AS INTEGER) AS place
    FROM (SELECT doc_id * 7 % 11 AS k, CASE WHEN doc_id * 7 % 11 < 4 THEN 1 ELSE 2 END AS sort_order FROM documents) n JOIN names ON place = k GROUP BY 1, 2""")
def stat_names_in_order(t):
    """Documents counted by names: falling counts, then the order set, then the order of the language."""
    number = F.col("doc_id")
    facts = t("documents").select(_name(number).alias("name"), F.when(number * 7 % 11 < 4, 1).otherwise(2).alias("sort_order"))
    return stats.ranking_by_name(facts, ["name"], "sort_order").select("name", "sort_order", "questions", "place")


@query(f"WITH {_NAMED} SELECT s_suppkey AS id, name, row_number() OVER (ORDER BY place, s_suppkey) AS place FROM supplier JOIN names ON place = s_suppkey * 7 % 11")
def tags_in_order(t):
    """Tags in the order of the language, without gathering them in one task."""
    rows = t("supplier").select(F.col("s_suppkey").alias("id"), _name(F.col("s_suppkey")).alias("name"))
    return stats.by_name(rows).select("id", "name", F.col("place").cast("long").alias("place"))


@query("SELECT 1000 + n_nationkey AS id, ' ' || lower(n_name) AS name, n_nationkey AS taken_by FROM nation WHERE n_nationkey % 2 = 0")
def template_names_taken(t):
    """Names of templates that others have already but for capitals."""
    n = t("nation")
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" "), F.lower("n_name"))).otherwise(F.concat("n_name", F.lit("x")))
    return bank.same_names(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), n.select((F.col("n_nationkey") + 1000).alias("id"), name.alias("name")))


@query("""SELECT doc_id AS id, 'open:ul=;open:li=;open:p=;text=' || lower(lang) || coalesce(source, 'none') || ';open:sup=;text=x' || doc_id % 7 || ';close:sup=;break=;text=y;close:p=;close:li=;close:ul=;open:table=;open:tr=;open:td=2,1;open:h3=;formula=\\Alpha ' || lang || ';close:h3=;image=r' || doc_id % 5 || ';close:td=;close:tr=;close:table=' AS tokens,
    upper(lang) || ' ' || coalesce(source, 'none') || ' X' || doc_id % 7 || chr(10) || 'Y' || chr(10) || chr(10) || chr(10) || '\\Alpha ' || lang || chr(10) || 'alt' AS text, true AS meaningful, false AS unverified, 'r' || doc_id % 5 AS images FROM documents""")
def document_tree_tokens(t):
    """Editor documents with lists, tables, formulas and images as tokens, by expressions over their nodes."""
    text = lambda value, more="": F.concat(F.lit('{"type":"text","text":"'), value, F.lit(f'"{more}}}'))
    node = lambda kind, *inner, attrs="": F.concat(F.lit(f'{{"type":"{kind}",{attrs}"content":['), F.concat_ws(",", *inner), F.lit("]}"))
    lang, number = F.col("lang"), F.col("doc_id").cast("string")
    line = node("paragraph", text(F.concat(F.upper(lang), F.lit(" "), F.coalesce("source", F.lit("none")))), text(F.concat(F.lit(" X"), (F.col("doc_id") % 7).cast("string")), ',"marks":[{"type":"bold"},{"type":"superscript"}]'), F.lit('{"type":"hardBreak"}'), text(F.lit("Y")))
    formula = F.concat(F.lit('{"type":"mathNode","attrs":{"latex":" \\\\Alpha '), lang, F.lit('"}}'))
    image = F.concat(F.lit('{"type":"image","attrs":{"resourceId":"r'), (F.col("doc_id") % 5).cast("string"), F.lit('","alt":"alt"}}'))
    cell = node("tableCell", node("heading", formula, attrs='"attrs":{"level":3},'), image, attrs='"attrs":{"colspan":2},')
    whole = node("doc", node("bulletList", node("listItem", line)), node("table", node("tableRow", cell)))
    got = document_tree.document_tokens(t("documents").select(F.col("doc_id").alias("id"), whole.alias("document")))
    tokens = F.array_join(F.transform("tokens", lambda x: F.concat(x["kind"], F.lit("="), x["value"])), ";")
    return got.select("id", tokens.alias("tokens"), "text", "meaningful", "unverified", F.array_join("image_ids", ",").alias("images"))


_LINES_OF = "lines AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))"


@query(f"""WITH {_LINES_OF}, made AS (SELECT *, strpos(line, ' ') AS k, CASE WHEN strpos(line, ' ') > 0 THEN line[:strpos(line, ' ') - 1] || '[formula]' || line[strpos(line, ' ') + 1:] ELSE line END AS text FROM lines),
    placed AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 - length(text) AS start FROM made)
    SELECT doc_id AS id, CAST(i AS INTEGER) AS paragraph, CAST(start + CASE WHEN k > 0 THEN k - 1 + 9 ELSE length(text) END AS BIGINT) AS after, CAST(start + length(text) AS BIGINT) AS place, md5(text) AS digest FROM placed""")
def anchors_rebased(t):
    """Lines of documents of which the first space becomes a formula: where that ends, and where an image at the end goes."""
    docs = t("documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph_index", "text")).withColumn("paragraph_index", F.col("paragraph_index") + 1)
    at = F.instr("text", " ")
    formulas = lines.where(at > 0).select("doc_id", "paragraph_index", (at - 1).alias("start"), at.alias("end"), F.lit("[formula]").alias("text"))
    merged = offsets.replaced_paragraphs(lines, formulas)
    anchors = lines.select("doc_id", "paragraph_index", F.when(at > 0, at).otherwise(F.length("text")).alias("first"), F.length("text").alias("offset"))
    out = offsets.rebased(offsets.rebased(anchors, merged, "first").withColumnRenamed("place", "after"), merged)
    digests = merged.select("doc_id", "paragraph_index", F.md5("text").alias("digest"))
    return out.join(digests, ["doc_id", "paragraph_index"]).select(F.col("doc_id").alias("id"), F.col("paragraph_index").cast("int").alias("paragraph"), F.col("after").cast("long").alias("after"), F.col("place").cast("long").alias("place"), "digest")


_SUMMER = "({x} >= CAST(make_date(year({x}), 3, 31) - CAST(dayofweek(make_date(year({x}), 3, 31)) AS INTEGER) AS TIMESTAMP) + INTERVAL 1 HOUR AND {x} < CAST(make_date(year({x}), 10, 31) - CAST(dayofweek(make_date(year({x}), 10, 31)) AS INTEGER) AS TIMESTAMP) + INTERVAL 1 HOUR)"
_AT_HOME = "{x} + CASE WHEN " + _SUMMER + " THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END"
_BACK = "{x} - CASE WHEN " + _SUMMER.replace("{x}", "({x} - INTERVAL 1 HOUR)") + " THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS ts FROM lineitem WHERE year(l_shipdate) >= 1997), h AS (SELECT *, {_AT_HOME.format(x="ts")} AS home FROM l),
    s AS (SELECT *, date_trunc('day', home) AS d, date_trunc('week', home) AS w, date_trunc('month', home) AS m FROM h)
    SELECT l_orderkey AS id, l_linenumber AS line, CAST(epoch_ms({_BACK.format(x="CAST(d AS TIMESTAMP)")}) AS BIGINT) AS day, CAST(epoch_ms({_BACK.format(x="CAST(w AS TIMESTAMP)")}) AS BIGINT) AS week, CAST(epoch_ms({_BACK.format(x="CAST(m AS TIMESTAMP)")}) AS BIGINT) AS month, CAST(epoch_ms(ts) - CAST(180 AS BIGINT) * 86400000 AS BIGINT) AS semester FROM s""")
def period_starts(t):
    """Starts of the day, week, month and semester of each time, in a zone with summer time."""
    lines = t("lineitem").where(F.year("l_shipdate") >= 1997)
    time = F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") % 24 * 3600)
    starts = [F.unix_millis(T.period_start(F.col("time"), w, "Europe/Berlin")).alias(w) for w in ("day", "week", "month", "semester")]
    return lines.select("l_orderkey", "l_linenumber", time.alias("time")).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), *starts)


@query("""SELECT doc_id AS id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;')) AS escaped,
    printf('%08x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(lang || '/' || doc_id, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296)) AS signature FROM documents WHERE text IS NOT NULL""")
def escaped_and_signed(t):
    """Texts as XML content, and short signatures of 32 bits."""
    docs = t("documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("id"), F.md5(wording.xml_escaped(F.col("text"))).alias("escaped"), wording._fnv(F.concat_ws("/", "lang", F.col("doc_id").cast("string"))).alias("signature"))


@query("""SELECT n_regionkey AS parent, n_nationkey AS id, CASE WHEN n_nationkey % 7 = 3 THEN 'left out' ELSE 'twice' END AS problem FROM nation WHERE n_nationkey % 7 IN (3, 5) UNION ALL SELECT NULL, 1000 + r_regionkey, 'unknown' FROM region""")
def order_problems(t):
    """Orders that do not name exactly the rows of a parent: rows left out, named twice and unknown."""
    n = t("nation")
    rows = n.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent"))
    asked = rows.where("id % 7 <> 3").select("id").union(rows.where("id % 7 = 5").select("id")).union(t("region").select(F.col("r_regionkey") + 1000))
    return bank.order_mismatches(rows, asked, "parent").select("parent", "id", "problem")


@query("""SELECT unnest(['total changed', 'repeated id', 'missing rows']) AS fault FROM (SELECT count(*) AS n FROM part) WHERE n > 0""")
def pages_read_with_faults(t):
    """Pages of a listing, read one by one while it changed: totals that differ, a row that came twice, rows that are missing."""
    part = t("part")
    page = F.floor(F.col("p_partkey") / 100)
    total = part.agg(F.count("*").alias("n"))
    rows = part.where("p_partkey % 10 <> 3").select(page.alias("page"), F.col("p_partkey").alias("id")).crossJoin(F.broadcast(total))
    rows = rows.unionByName(rows.where("id % 10 = 4").withColumn("page", F.col("page") + 1)).select("page", (F.col("n") + F.col("page") % 2).alias("total"), "id")
    return bank.page_faults(rows)


@query("""WITH s AS (SELECT user_id AS k, max(event_id) AS e FROM events GROUP BY 1), d AS (SELECT k, e, CASE WHEN k % 4 = 1 THEN 'other kind' WHEN k % 3 = 0 AND k % 5 = 0 THEN 'no target' ELSE 'saved' END AS outcome FROM s)
    SELECT k AS id, outcome, CASE WHEN outcome = 'saved' THEN 'p' || e WHEN k % 2 = 1 THEN 'old' END AS payload, CAST(CASE WHEN k % 2 = 1 THEN 1 WHEN outcome = 'saved' THEN 9 END AS BIGINT) AS created, CAST(CASE WHEN outcome = 'saved' THEN 9 WHEN k % 2 = 1 THEN 1 END AS BIGINT) AS updated FROM d""")
def drafts_autosaved(t):
    """The last autosave of each key over the drafts there are: replaced, new, or refused."""
    e = t("events")
    key = F.col("user_id").cast("string")
    edits = F.col("user_id") % 3 == 0
    saves = e.select(
        key.alias("draft_key"), F.when(edits, "question_edit").otherwise("question_create").alias("kind"), F.when(edits, F.when(F.col("user_id") % 5 != 0, F.col("user_id")).otherwise(-1)).alias("target_id"),
        F.lit(1).cast("long").alias("base_version"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("payload"), F.col("event_id").alias("ordinal"),
    )
    users = e.select("user_id").distinct()
    kind = F.when(F.col("user_id") % 4 == 1, "word_import_preview").when(edits, "question_edit").otherwise("question_create")
    stamp = F.lit(1).cast("long")
    there = users.where("user_id % 2 = 1").select(key.alias("draft_key"), kind.alias("kind"), F.lit(None).cast("long").alias("target_id"), stamp.alias("base_version"), F.lit("old").alias("payload"), stamp.alias("created_at_ms"), stamp.alias("updated_at_ms"))
    after, outcomes = history.drafts_saved(there, saves, users.select(F.col("user_id").alias("id")), 9)
    out = outcomes.join(after, "draft_key", "left")
    return out.select(F.col("draft_key").cast("long").alias("id"), "outcome", "payload", F.col("created_at_ms").alias("created"), F.col("updated_at_ms").alias("updated"))


@query("""SELECT left(sha256('copy/' || (l_orderkey || '-' || l_linenumber || '-' || l_partkey)), 32) AS id, 'copy' AS paper_id, l_partkey AS question_id, 'draft' AS status, CAST(7 AS BIGINT) AS created
    FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))""")
def paper_copied(t):
    """A paper with its items under a new id, as a draft."""
    lines, orders = t("lineitem"), t("orders")
    first = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").agg(F.min("l_orderkey")).first()[0]
    paper = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("saved").alias("paper_status"), F.lit(3).alias("row_version"), *(F.lit(1).cast("long").alias(c) for c in ("created_at_ms", "updated_at_ms", "saved_at_ms")))
    items = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_orderkey").cast("string").alias("paper_id"), F.col("l_partkey").alias("question_id"))
    papers, copies = bank.copied_paper(paper, items, str(first), "copy", 7)
    return copies.join(papers.select(F.col("id").alias("paper_id"), F.col("paper_status").alias("status"), F.col("created_at_ms").alias("created")), "paper_id").select("id", "paper_id", "question_id", "status", "created")
