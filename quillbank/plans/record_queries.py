"""Queries of records around the bank (export runs, saved banks, batches, whole papers), each with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillbank.functions.tables import shared_folder
from quillbank.operators import exports, history, listing, papers, resources, sampling, stats
from quillbank.plans.bank_queries import _BRIDGE, _PARTS, _USE, HARD_TAGS, NOW, _bridge, _parts, _used_parts, query
from quillbank.plans.content_queries import _BANK, _bank
from quillbank.sources import docx, xlsx
from quillbank.sources.committed_files import file_faults


@query("""WITH f AS (SELECT l_orderkey, date_diff('day', DATE '1992-01-01', l_shipdate) AS day, CASE WHEN l_returnflag = 'A' THEN 'E-' || l_linestatus END AS code, l_partkey FROM lineitem),
    e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY day, code NULLS FIRST, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM f)
    SELECT o_orderkey AS run_id, o_custkey AS paper_id, CASE WHEN k IS NULL THEN 'running' WHEN code IS NOT NULL THEN 'failed' ELSE 'succeeded' END AS status, day AS finished_day, code AS error_code,
    CASE WHEN code IS NOT NULL THEN 2000 END AS message_chars, CASE WHEN code IS NULL THEN l_partkey END AS output_byte_size, coalesce(n - 1, 0) AS refused FROM orders LEFT JOIN e ON l_orderkey = o_orderkey AND k = 1""")
def export_run_records(t):
    """Every export with its state: running, succeeded or failed, and the ends that came too late."""
    code = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("E-"), "l_linestatus"))
    ends = t("lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).alias("finished_at_ms"), code.alias("error_code"),
        F.when(code.isNotNull(), F.repeat(F.lit("failed "), F.lit(300))).alias("error_message"), F.col("l_partkey").alias("output_byte_size"),
    )
    runs = exports.export_runs(t("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("paper_id")), ends)
    return runs.select("run_id", "paper_id", "status", F.col("finished_at_ms").alias("finished_day"), "error_code", F.length("error_message").alias("message_chars"), "output_byte_size", "refused")


_SAVED = f"""WITH {_BANK} SELECT n AS row_number, CAST(k AS VARCHAR) AS question_id, p_type AS type_name, p_name AS stem, CASE WHEN p_size % 2 = 1 THEN 'A. x ' || p_name || chr(10) || 'B. ' || p_brand ELSE '' END AS options,
    CASE WHEN p_size % 3 = 0 THEN '' ELSE 'U' || p_size END AS unit_name, '' AS explanation FROM bank"""


def _saved(t, kind):
    rows = exports.export_rows(_bank(t), [F.asc("k")])
    folder = f"{shared_folder(rows.sparkSession)}/export-{uuid.uuid4().hex}"
    exports.save_bank(rows, kind, folder)
    return exports.saved_bank(rows.sparkSession, kind, folder).select("row_number", "question_id", "type_name", "stem", "options", "unit_name", "explanation")


@query(_SAVED)
def bank_saved_csv(t):
    """The bank saved as csv and read again; blank cells stay blank, lines within cells stay lines."""
    return _saved(t, "csv")


@query(_SAVED)
def bank_saved_json(t):
    """The bank saved as json lines and read again."""
    return _saved(t, "json")


@query(f"""WITH {_BANK} SELECT 'bank-' || lpad(CAST((n - 1) // 500 AS VARCHAR), 5, '0') || '.xlsx' AS book, CAST((n - 1) % 500 + 2 AS INTEGER) AS row_number, p_name AS stem, p_brand AS answer, 0 AS faults, true AS refused FROM bank""")
def bank_saved_xlsx(t):
    """The bank saved as workbooks by one commit, tried again on the same folder, and read again."""
    rows = exports.export_rows(_bank(t), [F.asc("k")])
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    exports.save_bank(rows, "xlsx", folder, 500)
    refused = False
    try:
        exports.save_bank(rows, "xlsx", folder, 500)
    except FileExistsError:
        refused = True
    faults = file_faults(spark, folder).agg(F.count("*").cast("int").alias("faults"))
    got = xlsx.read_workbooks(spark, folder).crossJoin(F.broadcast(faults))
    return got.select(F.element_at(F.split("path", "/"), -1).alias("book"), F.col("row_number").cast("int").alias("row_number"), "stem", "answer", "faults", F.lit(refused).alias("refused"))


@query(f"""WITH {_BANK}, s AS (SELECT *, lag(p_brand || ' / C' || p_size) OVER (PARTITION BY (n - 1) // 300 ORDER BY n) AS before FROM bank),
    listed AS (SELECT n, list_concat(CASE WHEN before IS DISTINCT FROM p_brand || ' / C' || p_size THEN [p_brand || ' / C' || p_size] ELSE [] END, [n || '. ' || p_name],
    CASE WHEN p_size % 2 = 1 THEN ['A. x ' || p_name, 'B. ' || p_brand] ELSE [] END, ['标签：' || replace(p_type, ' ', '、'), '【答案】' || p_brand]) AS lines FROM s)
    SELECT 'bank-' || lpad(CAST((n - 1) // 300 AS VARCHAR), 5, '0') || '.docx' AS name, CAST(sum(len(lines)) AS BIGINT) AS n_lines, sha256(string_agg(array_to_string(lines, chr(10)), chr(10) ORDER BY n)) AS digest FROM listed GROUP BY 1""")
def bank_saved_docx(t):
    """The bank saved as documents by one commit, and their lines read again."""
    rows = exports.export_rows(_bank(t), [F.asc("k")])
    folder = f"{shared_folder(rows.sparkSession)}/export-{uuid.uuid4().hex}"
    exports.save_bank(rows, "docx", folder, 300)
    lines = docx.document_parts(docx.read_documents(rows.sparkSession, folder), "paragraphs")
    whole = lines.groupBy(F.element_at(F.split("doc_id", "/"), -1).alias("name")).agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("paragraph_index", "text"))).alias("x"))
    return whole.select("name", "n_lines", F.sha2(F.array_join(F.transform("x", lambda x: x["text"]), "\n"), 256).alias("digest"))


@query("""SELECT p_partkey AS id, coalesce(string_agg(l_orderkey || '/' || l_suppkey || '/' || l_returnflag, ',' ORDER BY l_orderkey, l_suppkey, l_returnflag), '') AS resources
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def hydrate_resources(t):
    """Questions with the references to files in them, flattened to text."""
    refs = t("lineitem").select(F.col("l_partkey").alias("question_id"), F.col("l_orderkey").alias("node_id"), F.col("l_suppkey").alias("resource_id"), F.col("l_returnflag").alias("slot"), F.lit(None).cast("long").alias("option_id"))
    found = listing.with_resources(_parts(t).select("id"), refs)
    return found.select("id", F.array_join(F.transform("resources", lambda x: F.concat_ws("/", x["node_id"], x["resource_id"], x["slot"])), ",").alias("resources"))


@query("""SELECT o_orderkey AS paper_id, o_orderstatus AS status, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS items
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def papers_with_items(t):
    """Whole papers with their items in order, flattened to text."""
    items = t("lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("question_id"))
    found = papers.with_items(t("orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderstatus").alias("status")), items)
    return found.withColumn("items", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["position"], x["question_id"])), ","))


@query("""SELECT o_orderkey AS id, o_orderpriority AS title, count(*) OVER () AS total FROM orders WHERE lower(o_orderpriority) LIKE '%1-urgent%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def paper_title_normalised(t):
    """A page of papers whose title has a keyword that was typed in full-width letters."""
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("draft").alias("paper_status"), F.col("o_orderdate").alias("saved_at"), F.col("o_orderdate").alias("updated_at"))
    items = t("lineitem").select(F.col("l_orderkey").alias("paper_id"))
    return listing.list_papers(rows, items, title=" \uff11\uff0d\uff35\uff32\uff27\uff25\uff2e\uff34 ", page_size=50).select("id", "title", "total")


@query(f"""WITH {_USE}, {_PARTS}, {_BRIDGE} SELECT question_type, count(*) AS n FROM parts WHERE (last_used_at IS NULL OR last_used_at < TIMESTAMP '2001-08-02') AND id IN (SELECT question_id FROM bridge WHERE tag_id IN ('A-F', 'N-O', 'R-F'))
    AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_partkey IS NOT NULL) GROUP BY ROLLUP (question_type)""")
def draw_scope_used(t):
    """Candidates of a draw by use and tags, without the questions of a table."""
    gone = t("lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    return sampling.analyse(sampling.draw_scope(_used_parts(t), _bridge(t), tags=HARD_TAGS, excluded=gone, usage="before", usage_cutoff=NOW))


@query("""SELECT * FROM (SELECT count(*) FILTER (p_partkey % 7 <> 0) AS live_questions FROM part), (SELECT count(*) FILTER (o_orderstatus = 'F') AS saved_papers FROM orders),
    (SELECT count(*) FILTER (c_acctbal >= 0) AS ready_resources FROM customer), (SELECT count(*) AS templates FROM supplier)""")
def restore_summary(t):
    """What a restore brings back, templates included."""
    questions = t("part").select(F.when(F.col("p_partkey") % 7 == 0, 1).alias("deleted_at_ms"))
    saved = t("orders").select(F.when(F.col("o_orderstatus") == "F", "saved").otherwise("draft").alias("paper_status"))
    files = t("customer").select(F.when(F.col("c_acctbal") >= 0, "ready").otherwise("lost").alias("availability_status"))
    return resources.summary(questions, saved, files, t("supplier"))


@query("""WITH b AS (SELECT o_orderkey AS batch_id, date_diff('day', DATE '1992-01-01', o_orderdate) AS day FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 20)
    SELECT batch_id, day, count(l_orderkey) AS items FROM b LEFT JOIN lineitem ON l_orderkey = batch_id GROUP BY 1, 2""")
def recent_batches(t):
    """The twenty latest batches with their numbers of items."""
    batches = t("orders").select(F.col("o_orderkey").alias("batch_id"), F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("created_at_ms"))
    found = history.recent(batches, t("lineitem").select(F.col("l_orderkey").alias("batch_id")))
    return found.withColumnRenamed("created_at_ms", "day")


@query("SELECT s_suppkey AS id, s_nationkey AS sort_order, row_number() OVER (ORDER BY s_nationkey NULLS FIRST, s_suppkey) AS place FROM supplier")
def taxonomy_in_order(t):
    """A taxonomy list by sort order, then id."""
    return stats.in_order(t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("sort_order")))
