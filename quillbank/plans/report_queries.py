"""Queries of the duplicate report, of content rules and of what a bank is listed and exported with, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbank.functions import content_rules
from quillbank.functions import text as T
from quillbank.operators import exports, listing, resources, stats
from quillbank.operators.duplicate_report import scan_report
from quillbank.plans.bank_queries import _bridge, query

_SCOPE = ("Brand#2", "Brand#17", "Brand#33")


@query("""WITH stems AS (SELECT p_partkey AS id, p_partkey AS updated, p_size AS created, p_size AS version, p_name, p_brand IN ('Brand#2', 'Brand#17', 'Brand#33') AS s,
    lower(replace(p_name || p_brand || p_type || CAST(p_size AS VARCHAR), ' ', '')) AS text, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 4 <> 0 THEN p_type || '/' || p_size ELSE 'id:' || p_partkey END AS print FROM part),
    placed AS (SELECT *, len(text) AS length, row_number() OVER (ORDER BY len(text), updated DESC, id) AS p FROM stems),
    near AS (SELECT a.id, b.id AS c, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.length - b.length), b.updated DESC, b.id) AS k FROM placed a JOIN placed b ON a.id <> b.id AND b.p BETWEEN a.p - 256 AND a.p + 256 WHERE a.s),
    pairs AS (SELECT DISTINCT least(id, c) AS l, greatest(id, c) AS r FROM near WHERE k <= 256),
    grams AS (SELECT id, substr(text, i, 2) AS gram, count(*) AS n FROM (SELECT id, text, unnest(range(1, len(text))) AS i FROM stems) GROUP BY 1, 2),
    shared AS (SELECT l, r, sum(least(a.n, b.n)) AS s FROM pairs JOIN grams a ON a.id = l JOIN grams b ON b.id = r AND b.gram = a.gram GROUP BY 1, 2),
    scored AS (SELECT l, r, least(100, (200 * shared.s + (len(x.text) + len(y.text) - 2) // 2) // (len(x.text) + len(y.text) - 2)) AS v FROM shared JOIN stems x ON x.id = l JOIN stems y ON y.id = r WHERE x.print <> y.print),
    ignored AS (SELECT p_partkey AS l, lead(p_partkey) OVER w AS r FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)),
    suspected AS (SELECT l, r, least(v, 99) AS v FROM scored WHERE v >= 82 AND (l, r) NOT IN (SELECT (l, r) FROM ignored WHERE r % 2 = 0)),
    exact AS (SELECT id, first_value(id) OVER (PARTITION BY print ORDER BY created, id) AS f, count(*) OVER (PARTITION BY print) AS n, bool_or(s) OVER (PARTITION BY print) AS touched FROM stems),
    found AS (SELECT 'exact' AS kind, 'exact:' || f AS group_id, 100 AS similarity, id FROM exact WHERE n > 1 AND touched UNION ALL
    SELECT 'suspected', 'suspected:' || l || ':' || r, v, unnest([l, r]) FROM suspected)
    SELECT dense_rank() OVER (ORDER BY kind, similarity DESC, group_id) - 1 AS place, group_id, kind, CAST(similarity AS INTEGER) AS similarity, row_number() OVER (PARTITION BY group_id ORDER BY created, id) - 1 AS member_place,
    id AS member, p_name AS stem_preview, version AS content_version FROM found JOIN stems USING (id)""")
def duplicate_report(t):
    """The whole report of a scan of three subjects: exact groups, then suspected pairs that are not ignored, with members in order."""
    p, key = t("part"), F.col("p_partkey")
    text = T.compared_text(F.concat("p_name", "p_brand", "p_type", F.col("p_size").cast("string")))
    rows = p.select(
        key.alias("id"), key.alias("updated"), F.col("p_size").alias("created"), F.col("p_size").alias("content_version"), F.col("p_name").alias("stem"), F.col("p_brand").alias("subject"), text.alias("text"),
        F.sha2(F.concat_ws("/", "p_type", F.col("p_size").cast("string")), 256).alias("fingerprint"), F.when(key % 11 == 0, 1).otherwise(2).alias("fingerprint_version"), (key % 4 != 0).alias("comparable"),
    )
    after = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    ignores = p.select(key.alias("left_id"), F.lead("p_partkey").over(after).alias("right_id"), F.col("p_size").alias("left_version"), F.lead("p_size").over(after).alias("right_version"))
    ignores = ignores.withColumn("right_version", F.when(F.col("right_id") % 2 == 0, F.col("right_version")).otherwise(F.col("right_version") + 1))  # odd ones are out of date
    return scan_report(rows.withColumn("length", F.length("text")), F.col("subject").isin(*_SCOPE), ignores, most=None)


@query(r"""WITH f AS (SELECT page_id, html, regexp_replace(html, '<[^>]*>', '', 'g') AS plain, lower(regexp_replace(coalesce(html, ''), '[ \t\n\f\r]+', ' ', 'g')) AS h FROM pages)
    SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'unknown version' WHEN page_id % 7 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'unknown editor' ELSE 'bad document' END
    WHEN strlen(coalesce(html, '')) > 3000 THEN 'html too large' WHEN strlen(coalesce(plain, '')) > 1500 THEN 'text too long'
    WHEN regexp_matches(h, '<script|<iframe|<object|<embed|<link|<meta|<base|javascript:|data:text/html|srcdoc=') OR regexp_matches(h, '<[a-z][^<>]*[\s/"'']on[a-z]+\s*=') THEN 'unsafe'
    WHEN trim(coalesce(plain, ''), ' ') = '' THEN 'empty' END AS fault,
    CAST(strlen(coalesce(html, '')) + strlen(coalesce(plain, '')) + CASE WHEN page_id % 7 = 0 AND page_id % 13 <> 0 THEN 14 ELSE 0 END AS BIGINT) AS bytes FROM f""")
def content_faults(t):
    """The first fault of each page as a question's content, with small limits, and the bytes of all its parts."""
    seventh, none = (F.col("page_id") % 7 == 0) & (F.col("page_id") % 13 != 0), F.lit(None).cast("string")
    content = F.struct(
        F.when(F.col("page_id") % 13 == 0, 3).when(seventh, 2).otherwise(1).alias("schema_version"), F.when(seventh & (F.col("page_id") % 2 == 1), "tiptap").alias("editor"), F.when(seventh, "1").alias("editor_version"),
        F.when(seventh, '{"type":"p1"} ').alias("document"), F.col("html").alias("html"), F.regexp_replace("html", "<[^>]*>", "").alias("plain_text"), none.alias("source_ooxml"),
    )
    rows = t("pages").select("page_id", content.alias("c"))
    fault = content_rules.content_fault(F.col("c"), "question", limits=content_rules.Limits(html=3000, plain=1500))
    return rows.select("page_id", fault.alias("fault"), content_rules.content_bytes(F.col("c")).alias("bytes"))


@query("""SELECT c_custkey AS id, row_number() OVER (ORDER BY r_regionkey % 2, r_regionkey, n_nationkey % 3, n_nationkey, len(c_mktsegment), c_mktsegment, c_custkey % 100, c_custkey) AS row_number, c_name AS stem
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment IS NOT NULL""")
def bank_export_in_order(t):
    """Export rows in the order of a whole bank: subjects, chapters and types by their sort orders, then by creation."""
    none, key = F.lit(None).cast("string"), F.col("c_custkey")
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("question_id"), F.col("n_regionkey").alias("subject_id"), F.col("n_nationkey").alias("chapter_id"), F.col("c_mktsegment").alias("question_type"), (key % 100).alias("created_at_ms"), F.col("c_name").alias("stem"),
        F.lit(None).cast("string").alias("type_name"), F.col("n_name").alias("chapter_name"), none.alias("subject_name"), none.alias("unit_name"), F.array().cast("array<string>").alias("options"), none.alias("answer"),
        none.alias("explanation"), F.array().cast("array<string>").alias("tag_names"), F.lit(None).cast("long").alias("last_used_at_ms"), F.lit(0).cast("long").alias("updated_at_ms"),
    )
    subjects = t("region").select(F.col("r_regionkey").alias("subject_id"), (F.col("r_regionkey") % 2).alias("sort_order"))
    chapters = t("nation").select(F.col("n_nationkey").alias("chapter_id"), (F.col("n_nationkey") % 3).alias("sort_order"))
    types = t("customer").select(F.col("c_mktsegment").alias("code"), F.length("c_mktsegment").alias("sort_order")).where("code is not null").distinct()
    keyed = exports.with_sort_keys(rows, subjects, chapters, types)
    return exports.export_rows(keyed, [F.asc(c) for c in exports.EXPORT_ORDER]).select(F.col("question_id").cast("long").alias("id"), "row_number", "stem")


@query("""WITH b AS (SELECT DISTINCT l_partkey AS q, l_returnflag || '-' || l_linestatus AS tag FROM lineitem)
    SELECT p_partkey AS id, coalesce(string_agg('tag ' || lower(tag), ' ' ORDER BY 'tag ' || lower(tag)), '') AS tags_plain FROM part LEFT JOIN b ON q = p_partkey GROUP BY 1""")
def tags_plain_made(t):
    """The searched text of every question's tags, made anew from the bridge."""
    tags = _bridge(t).select("tag_id").distinct().select("tag_id", F.concat(F.lit("tag "), F.lower("tag_id")).alias("name"))
    return listing.with_tags_plain(t("part").select(F.col("p_partkey").alias("id"), F.lit("old").alias("tags_plain")), _bridge(t), tags)


@query("SELECT l_partkey AS question_id, l_suppkey AS resource_id, count(*) AS uses FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY 1, 2")
def resources_of_questions(t):
    """Each question's resources once."""
    return resources.resource_ids(t("lineitem").select(F.col("l_partkey").alias("question_id"), F.col("l_suppkey").alias("resource_id")))


@query("""WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
    SELECT p_brand AS subject, string_agg(p_type || '=' || n, ',' ORDER BY p_type) AS types FROM n GROUP BY 1""")
def subject_type_counts(t):
    """Counts of types for each subject as a map, flattened to text."""
    found = stats.type_counts(t("part").select(F.col("p_brand").alias("subject"), F.col("p_type").alias("question_type")), "subject")
    return found.select("subject", F.array_join(F.transform(F.map_entries("types"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("types"))
