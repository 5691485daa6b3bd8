"""Queries of changes, rules, stored files and text rules over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbank.functions import rich, wording
from quillbank.operators import bank, resources
from quillbank.plans.bank_queries import query

_PARTS = "SELECT p_partkey AS id, string_split(p_type, ' ') AS tags, p_brand AS chapter_id, p_size AS v, CASE WHEN p_partkey % 7 = 0 THEN 1 END AS deleted FROM part"


def _parts(t):
    part = t("part")
    none = F.lit(None).cast("long")
    return part.select(
        F.col("p_partkey").alias("id"), F.split("p_type", " ").alias("tags"), F.col("p_brand").alias("chapter_id"), none.alias("last_used_at_ms"),
        F.col("p_size").cast("long").alias("content_version"), F.lit(0).cast("long").alias("updated_at_ms"), F.when(F.col("p_partkey") % 7 == 0, 1).cast("long").alias("deleted_at_ms"),
    )


def _part_edits(t):
    e = t("part").where("p_partkey % 3 = 0")
    return e.select(F.col("p_partkey").alias("id"), (F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int")).alias("expected_version"), F.array(F.lit("TIN"), F.lit("NEW")).alias("tags"), F.when(F.col("p_partkey") % 2 == 0, "C").alias("chapter_id"))


_HIT = "id % 3 = 0 AND id % 5 <> 0 AND id % 7 <> 0"
_EDITED = (
    "SELECT id, array_to_string(list_sort(CASE WHEN {hit} THEN {tags} ELSE tags END), '/') AS tags, "
    "CASE WHEN {hit} AND id % 2 = 0 THEN 'C' ELSE chapter_id END AS chapter_id, CAST(v + CASE WHEN {hit} THEN 1 ELSE 0 END AS BIGINT) AS content_version FROM ({parts})"
)


def _shown(df):
    return df.select("id", F.array_join(F.array_sort("tags"), "/").alias("tags"), "chapter_id", "content_version")


@query(_EDITED.format(hit=_HIT, tags="list_distinct(list_concat(tags, ['TIN', 'NEW']))", parts=_PARTS))
def batch_edit_append(t):
    """Tags appended and chapters moved where version and bin allow it."""
    return _shown(bank.batch_edited(_parts(t), _part_edits(t), "append", 5))


@query(_EDITED.format(hit=_HIT, tags="list_filter(tags, lambda x: x NOT IN ('TIN', 'NEW'))", parts=_PARTS))
def batch_edit_remove(t):
    """Tags removed likewise."""
    return _shown(bank.batch_edited(_parts(t), _part_edits(t), "remove", 5))


@query(f"SELECT id, array_to_string(list_sort(tags), '/') AS tags, chapter_id, CAST(v + CASE WHEN {_HIT} THEN 2 ELSE 0 END AS BIGINT) AS content_version FROM ({_PARTS})")
def batch_edit_undone(t):
    """An edit and its undo: the old content, two versions on."""
    before, edits = _parts(t), _part_edits(t)
    after = bank.batch_edited(before, edits, "replace", 5)
    applied = edits.join(bank.edit_conflicts(before, edits).select("id"), "id", "left_anti")
    return _shown(bank.undone(after, bank.undo_rows(before, applied, "b"), 6))


@query(f"SELECT id, CASE WHEN deleted IS NOT NULL THEN 'in the bin' ELSE 'another version' END AS reason FROM ({_PARTS}) WHERE id % 3 = 0 AND (deleted IS NOT NULL OR id % 5 = 0)")
def batch_edit_conflicts(t):
    """Edits that cannot be applied."""
    return bank.edit_conflicts(_parts(t), _part_edits(t)).select("id", "reason")


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN coalesce(deleted, 9) ELSE deleted END AS deleted_at_ms FROM ({_PARTS})")
def recycle(t):
    """Every second question into the bin; what is there keeps its time."""
    q = _parts(t)
    return bank.binned(q, q.where("id % 2 = 0"), 9).select("id", F.col("deleted_at_ms").cast("int").alias("deleted_at_ms"))


@query(f"SELECT id FROM ({_PARTS}) WHERE NOT (id % 2 = 0 AND deleted IS NOT NULL)")
def purge(t):
    """Only questions in the bin are removed."""
    q = _parts(t)
    return bank.purged(q, q.where("id % 2 = 0")).select("id")


@query("""SELECT p_partkey AS id, array_to_string(list_filter([
    CASE WHEN k AND n < 2 THEN 'too few options' END, CASE WHEN NOT k AND n > 0 THEN 'options of no choice' END,
    CASE WHEN len(list_distinct(tags)) < len(tags) THEN 'repeated tag' END], lambda x: x IS NOT NULL), ';') AS broken
    FROM (SELECT *, p_size % 3 <> 0 AS k, p_size % 4 AS n, list_concat(string_split(p_type, ' '), [CASE WHEN p_size % 5 = 0 THEN string_split(p_type, ' ')[1] ELSE 'x' END]) AS tags FROM part)""")
def question_rules(t):
    """Rules that invented questions break."""
    part = t("part").withColumn("behavior", F.when(F.col("p_size") % 3 != 0, "single_choice").otherwise("open_response"))
    part = part.withColumn("options", F.slice(F.split(F.lit("a b c d"), " "), 1, F.col("p_size") % 4))
    tags = F.split("p_type", " ")
    part = part.withColumn("tags", F.concat(tags, F.array(F.when(F.col("p_size") % 5 == 0, tags[0]).otherwise(F.lit("x")))))
    return part.select(F.col("p_partkey").alias("id"), F.array_join(bank.rule_violations(F.col("behavior"), F.col("options"), F.col("tags"), F.lit(0)), ";").alias("broken"))


@query("SELECT n_nationkey AS id, CAST(CASE WHEN n_regionkey = 2 THEN n_nationkey ELSE 1024 * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) END AS BIGINT) AS sort_order FROM nation")
def taxonomy_reorder(t):
    """Nations in reverse order of names, but for a region of which one is left out."""
    n = t("nation")
    rows = n.select(F.col("n_nationkey").alias("id"), "n_regionkey", F.col("n_nationkey").cast("long").alias("sort_order"))
    last = n.where("n_regionkey = 2").agg(F.max("n_nationkey").alias("id"))
    asked = n.select(F.col("n_nationkey").alias("id"), F.col("n_name")).join(last, "id", "left_anti")
    ranked = asked.join(n.select(F.col("n_nationkey").alias("id"), "n_regionkey"), "id")
    ranked = ranked.withColumn("ordinal", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("n_name"))))
    return bank.reordered(rows, ranked.select("id", "ordinal"), "n_regionkey").select("id", "sort_order")


@query("SELECT r_regionkey AS region, CAST(coalesce(max(n_nationkey), 0) + 1024 AS BIGINT) AS position FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_regionkey <> 3 GROUP BY 1")
def next_sort_positions(t):
    """Where the next child goes, also of a parent without any."""
    children = t("nation").where("n_regionkey <> 3").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("sort_order"))
    return bank.next_positions(t("region").select(F.col("r_regionkey").alias("region")), children, "region")


@query("""SELECT nation, customers, suppliers, customers = 0 AND suppliers = 0 AS deletable FROM (
    SELECT n_nationkey AS nation, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM nation
    LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey)""")
def taxonomy_delete_guards(t):
    """What still uses each nation."""
    uses = {"customers": t("customer").select(F.col("c_nationkey").alias("nation")), "suppliers": t("supplier").select(F.col("s_nationkey").alias("nation"))}
    return bank.delete_guards(t("nation").select(F.col("n_nationkey").alias("nation")), "nation", uses)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS code, r_name AS name, min(CAST(n_nationkey AS VARCHAR)) AS taken_by FROM region JOIN nation ON CAST(n_nationkey AS VARCHAR) <> CAST(r_regionkey AS VARCHAR) AND upper(r_name) = upper(r_name) AND n_regionkey = r_regionkey GROUP BY 1, 2")
def type_names_taken(t):
    """Names that another type has: every nation stands for an alias with its region's name."""
    n, r = t("nation"), t("region")
    aliases = n.join(r, n.n_regionkey == r.r_regionkey).select(n.n_nationkey.cast("string").alias("code"), F.lower("r_name").alias("name"))
    return bank.taken_names(aliases.limit(0), aliases, r.select(F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("name")))


@query("""SELECT l_orderkey AS paper_id, l_linenumber || l_returnflag AS item_id, nth_value(l_linenumber, k) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS new_position
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem))""")
def reorder_within_type(t):
    """Items of each type in reverse, in the places that the type has."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    items = lines.select(F.col("l_orderkey").alias("paper_id"), F.concat_ws(":", "l_orderkey", F.concat(F.col("l_linenumber"), F.col("l_returnflag"))).alias("item_id"), F.col("l_returnflag").alias("question_type"), F.col("l_linenumber").alias("position"))
    wanted = items.select("item_id", (-F.col("position")).alias("ordinal"))
    out = bank.reordered_within_type(items, wanted)
    return out.select("paper_id", F.split("item_id", ":")[1].alias("item_id"), "new_position")


@query("SELECT p_partkey AS template_id, p_partkey = (SELECT max(p_partkey) FROM part) AS is_default FROM part")
def template_default(t):
    """Which template the one settings row names."""
    part = t("part")
    settings = part.agg(F.max("p_partkey").alias("default_template_id"))
    return bank.template_catalogue(part.select(F.col("p_partkey").alias("template_id")), settings)


@query("SELECT name, updated_at_ms FROM (SELECT event_type AS name, max(event_id) AS updated_at_ms FROM events GROUP BY 1) ORDER BY updated_at_ms DESC, name LIMIT 100")
def saved_filter_upserts(t):
    """Newest definition of each name."""
    e = t("events").select(F.col("event_type").alias("name"), F.col("props").alias("definition"), F.col("event_id").alias("updated_at_ms"))
    return bank.saved_filters(e.where("updated_at_ms % 2 = 1"), e.groupBy("name").agg(F.max_by("definition", "updated_at_ms").alias("definition"), F.max("updated_at_ms").alias("updated_at_ms"))).select("name", "updated_at_ms")


@query("SELECT sha256(text) AS sha256, 'images/' || sha256(text)[1:2] || '/' || sha256(text) AS path, CAST(strlen(text) AS BIGINT) AS byte_size FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0 AND text IS NOT NULL) GROUP BY text")
def stored_files(t):
    """Contents that are not stored yet, each once."""
    docs = t("documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.lit("text/plain").alias("mime_type"))
    known = docs.where("doc_id % 4 = 0 and content is not null").select(F.sha2("content", 256).alias("sha256"))
    return resources.stored(docs, known).select("sha256", "path", "byte_size")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'unreferenced' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'not ready' FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def resource_problems(t):
    """Customers stand for stored files, orders for references."""
    res = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, "ready").otherwise("lost").alias("availability_status"))
    out = resources.inconsistencies(t("orders").select(F.col("o_custkey").alias("resource_id")), res)
    return out.select(F.col("resource_id").cast("string").alias("id"), "problem")


@query("SELECT o_custkey AS k, 'add' AS change FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1 UNION ALL SELECT c_custkey, 'remove' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def reference_reconcile(t):
    """References to add and to remove."""
    recorded = t("customer").where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("k"))
    return resources.reference_changes(recorded, t("orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT user_id, CAST(max(event_id) FILTER (event_type <> 'view') + 86400000 * greatest(user_id % 3, 1) AS BIGINT) AS next_due_ms FROM events GROUP BY 1 HAVING count(*) FILTER (event_type <> 'view') > 0")
def backup_due(t):
    """When each user's next backup is due."""
    e = t("events")
    records = e.select(F.col("user_id").alias("scope"), F.lit("automatic").alias("backup_kind"), F.when(F.col("event_type") != "view", "completed").otherwise("failed").alias("status"), F.col("event_id").alias("completed_at_ms"))
    settings = e.where("event_type <> 'view'").select(F.col("user_id").alias("scope"), (F.col("user_id") % 3).alias("interval_days")).distinct()
    return resources.backups_due(settings, records, 0).select(F.col("scope").alias("user_id"), "next_due_ms")


@query(r"""SELECT page_id, regexp_matches(h, '<script|<iframe|<object|<embed|<link|<meta|<base|javascript:|data:text/html|srcdoc=')
    OR regexp_matches(h, '<[a-z][^<>]*[\s/"'']on[a-z]+\s*=') AS unsafe FROM (SELECT page_id, lower(regexp_replace(coalesce(html, ''), '[ \t\n\f\r]+', ' ', 'g')) AS h FROM pages)""")
def unsafe_markup(t):
    """Pages with active content."""
    return t("pages").select("page_id", rich.is_unsafe(F.col("html")).alias("unsafe"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size >= 20 THEN string_split('一二三四五', '')[p_size // 10] ELSE '' END || CASE WHEN p_size >= 10 THEN '十' ELSE '' END ||
    CASE WHEN p_size % 10 > 0 THEN string_split('一二三四五六七八九', '')[p_size % 10] ELSE '' END AS numeral, replace(replace(p_name, '&', '&amp;'), '<', '&lt;') AS name,
    CASE WHEN p_size > 26 THEN 'A' || chr(CAST(38 + p_size AS INTEGER)) ELSE chr(CAST(64 + p_size AS INTEGER)) END AS label FROM part""")
def part_labels(t):
    """Section numerals, worksheet columns and escaped names."""
    return t("part").select(F.col("p_partkey").alias("id"), wording.chinese_numeral(F.col("p_size")).alias("numeral"), wording.xml_escaped(F.col("p_name")).alias("name"), wording.column_label(F.col("p_size") - 1).alias("label"))


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'A、C' WHEN 1 THEN '' WHEN 2 THEN 'see text 1' ELSE 'B' END AS answer, p_size % 4 IN (1, 2) AS review FROM part""")
def answers_follow_options(t):
    """Letters after options c, a, b became b, c, a without d."""
    k = F.col("p_size") % 4
    answer = F.when(k == 0, "b，C").when(k == 1, "A,D").when(k == 2, "see text 1").otherwise("a")
    before, after = F.array(*map(F.lit, ["c", "a", "b", "d"])), F.array(*map(F.lit, ["b", "c", "a"]))
    before = F.when(k == 0, F.array(*map(F.lit, ["c", "a", "b"]))).otherwise(before)
    return t("part").select(F.col("p_partkey").alias("id"), wording.remapped_answer(before, after, answer).alias("x")).select("id", "x.*")


@query("SELECT event_type AS kind, CAST(sum(CASE WHEN event_id % 3 < 2 THEN 1 ELSE 0 END) AS BIGINT) AS old, CAST(sum(CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS rest FROM events GROUP BY 1")
def retired_counters(t):
    """Counts of retired keys added to one."""
    names = F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string"))
    counts = t("events").groupBy(F.col("event_type").alias("kind"), names.alias("k")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    out = maps.withColumn("m", bank.merged_counters(F.col("m"), "k0", ["k1"]))
    return out.select("kind", F.col("m")["k0"].alias("old"), F.coalesce(F.try_element_at("m", F.lit("k2")), F.lit(0)).alias("rest"))


@query("""SELECT * FROM (SELECT count(*) FILTER (p_partkey % 7 <> 0) AS live_questions FROM part), (SELECT count(*) FILTER (o_orderstatus = 'F') AS saved_papers FROM orders),
    (SELECT count(*) FILTER (c_acctbal >= 0) AS ready_resources FROM customer)""")
def backup_summary(t):
    """What a backup holds: live questions, saved papers, ready files."""
    papers = t("orders").select(F.when(F.col("o_orderstatus") == "F", "saved").otherwise("draft").alias("paper_status"))
    files = t("customer").select(F.when(F.col("c_acctbal") >= 0, "ready").otherwise("lost").alias("availability_status"))
    return resources.summary(_parts(t), papers, files)


@query("""SELECT sha256('question.save' || chr(31) || 'question' || chr(31) || p_partkey || chr(31) || '9') AS id, CAST(p_partkey AS VARCHAR) AS entity_id, p_name AS summary,
    'succeeded' AS outcome FROM part""")
def audit_log(t):
    """A log row for each question that was saved, the same in every rerun."""
    changes = t("part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("summary"))
    return resources.audit_rows(changes, "question.save", "question", 9).select("id", "entity_id", "summary", "outcome")
