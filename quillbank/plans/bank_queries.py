"""Queries of the question-bank operators over the test tables, each with SQL that gives the same rows.

Tables stand for the bank: part and documents for questions, lineitem for their use and tags, orders for papers, events
for versions and logs, benchmark for an import batch.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.functions import text as T
from quillbank.operators import dedup, history, listing, papers, sampling, stats

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime.datetime(2001, 8, 2)
HARD_TAGS = ("A-F", "N-O", "R-F")


def query(sql: str | None = None):
    """Register a function (tables) -> DataFrame under its name."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = run
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _documents(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("stem_plain"), F.col("lang").alias("subject"), F.col("source").alias("chapter"), F.col("doc_id").alias("updated_at"))


def _parts(t) -> DataFrame:
    return t("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("stem_plain"), F.col("p_brand").alias("subject"), F.col("p_type").alias("question_type"), F.col("p_size").alias("unit"), F.col("p_partkey").alias("updated_at")
    )


def _use(t) -> DataFrame:
    lines = t("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("o_orderkey"))
    return lines.join(t("orders").select("o_orderkey", "o_orderdate"), "o_orderkey").groupBy("id").agg(F.max("o_orderdate").alias("last_used_at"))


def _used_parts(t) -> DataFrame:
    return _parts(t).join(_use(t), "id", "left")


def _bridge(t) -> DataFrame:
    return t("lineitem").select(F.col("l_partkey").alias("question_id"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("tag_id"))


_USE = "use AS (SELECT l_partkey AS id, max(o_orderdate) AS last_used_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"
_PARTS = "parts AS (SELECT p_partkey AS id, p_name, p_brand AS subject, p_type AS question_type, p_size AS unit, last_used_at FROM part LEFT JOIN use ON p_partkey = id)"
_BRIDGE = "bridge AS (SELECT DISTINCT l_partkey AS question_id, l_returnflag || '-' || l_linestatus AS tag_id FROM lineitem)"


@query("""SELECT doc_id AS id, lang AS subject, source AS chapter, count(*) OVER () AS total FROM documents
          WHERE lang = 'en' AND lower(text) LIKE '%the and%' ORDER BY doc_id DESC, id LIMIT 20""")
def list_page_keyword_scope(t):
    """First page of English documents with a keyword, the latest first."""
    found = listing.list_questions(_documents(t), listing.QuestionFilters(keyword=" The AND", subject="en"))
    return found.select("id", "subject", "chapter", "total")


@query("""SELECT p_partkey AS id, p_name AS stem, count(*) OVER () AS total FROM part
          WHERE lower(p_name) LIKE '%r_d%w%' ORDER BY p_partkey DESC LIMIT 30 OFFSET 30""")
def list_page_wildcards(t):
    """Second page; % and _ in the keyword are wildcards."""
    found = listing.list_questions(_parts(t), listing.QuestionFilters(keyword="R_d%w", page=2, page_size=30))
    return found.select("id", F.col("stem_plain").alias("stem"), "total")


@query(f"""WITH {_BRIDGE} SELECT p_partkey AS id, p_brand AS subject FROM part
           WHERE p_partkey IN (SELECT question_id FROM bridge WHERE tag_id IN ('A-F', 'N-O', 'R-F'))""")
def list_tags_any(t):
    """Questions with any of three tags."""
    return listing.filtered(_parts(t), listing.QuestionFilters(tags=HARD_TAGS), _bridge(t)).select("id", "subject")


@query(f"""WITH {_BRIDGE} SELECT p_partkey AS id, p_brand AS subject FROM part WHERE p_partkey IN (
           SELECT question_id FROM bridge WHERE tag_id IN ('A-F', 'N-O', 'R-F') GROUP BY 1 HAVING count(DISTINCT tag_id) = 3)""")
def list_tags_all(t):
    """Questions with all of three tags."""
    return listing.filtered(_parts(t), listing.QuestionFilters(tags=HARD_TAGS, tag_mode="all"), _bridge(t)).select("id", "subject")


@query(f"WITH {_USE}, {_PARTS} SELECT id, last_used_at FROM parts WHERE last_used_at IS NULL OR last_used_at < TIMESTAMP '2001-01-01'")
def list_usage_before(t):
    """Questions that were not used since a date."""
    return listing.filtered(_used_parts(t), listing.QuestionFilters(usage="before", usage_cutoff=datetime.datetime(2001, 1, 1))).select("id", "last_used_at")


@query(f"WITH {_USE}, {_PARTS} SELECT id, subject FROM parts WHERE last_used_at IS NULL")
def list_usage_never(t):
    """Questions that were never used."""
    return listing.filtered(_used_parts(t), listing.QuestionFilters(usage="never")).select("id", "subject")


@query("""SELECT o_orderkey AS id, o_orderstatus AS paper_status, coalesce(n, 0) AS item_count, count(*) OVER () AS total
          FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
          WHERE lower(o_orderpriority) LIKE '%urgent%'
          ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE o_orderdate - INTERVAL 1 DAY END DESC NULLS LAST, o_orderkey LIMIT 500""")
def paper_list_page(t):
    """A page of papers, saved and unsaved ones each by their own time, with item counts."""
    rows = t("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderstatus") == "F", "saved").otherwise(F.col("o_orderstatus")).alias("paper_status"),
        F.col("o_orderdate").alias("saved_at"),
        (F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("updated_at"),
    )
    found = listing.list_papers(rows, t("lineitem").select(F.col("l_orderkey").alias("paper_id")), title="Urgent", page_size=500)
    return found.select("id", F.when(F.col("paper_status") == "saved", "F").otherwise(F.col("paper_status")).alias("paper_status"), "item_count", "total")


@query("SELECT * FROM (VALUES (0, 42), (1, 7), (2, 150), (3, 0)) v(position, id) JOIN (SELECT p_partkey AS id, p_name AS stem FROM part) USING (id)")
def fetch_by_ids_ordered(t):
    """Four questions in the order asked for."""
    return listing.fetch_by_ids(_parts(t), [42, 7, 150, 0]).select("id", "position", F.col("stem_plain").alias("stem"))


@query(f"""WITH {_BRIDGE}, counts AS (SELECT tag_id, count(*) AS n FROM bridge GROUP BY 1),
          o AS (SELECT l_partkey AS id, string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY l_orderkey * 10 + l_linenumber, l_orderkey || ':' || l_linenumber) AS options FROM lineitem GROUP BY 1),
          g AS (SELECT question_id AS id, string_agg(tag_id || '=' || n, ',' ORDER BY tag_id) AS tags FROM bridge JOIN counts USING (tag_id) GROUP BY 1)
          SELECT p_partkey AS id, coalesce(options, '') AS options, coalesce(tags, '') AS tags FROM part LEFT JOIN o ON o.id = p_partkey LEFT JOIN g ON g.id = p_partkey""")
def hydrate_nested(t):
    """Questions with their ordered options and tags, flattened to text."""
    label = F.concat_ws(":", "l_orderkey", "l_linenumber")
    options = t("lineitem").select(F.col("l_partkey").alias("question_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), label.alias("text"))
    tags = _bridge(t).select("tag_id", F.col("tag_id").alias("name")).distinct()
    found = listing.hydrated(_parts(t).select("id"), options, _bridge(t), tags)
    flat = {"options": F.array_join(F.transform("options", lambda x: x["text"]), ","), "tags": F.array_join(F.transform("tags", lambda x: F.concat_ws("=", x["name"], x["questions"])), ",")}
    return found.withColumns(flat).select("id", "options", "tags")


@query("""SELECT n_nationkey AS nation, n_name AS name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def taxonomy_counts(t):
    """Every nation with its number of suppliers, 0 included."""
    dimension = t("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    return stats.counted(dimension, t("supplier").withColumnRenamed("s_nationkey", "nation"), "nation", "suppliers")


@query("""SELECT r_name AS subject, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS chapters FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def taxonomy_tree(t):
    """Regions with their nations."""
    subjects = t("region").select(F.col("r_regionkey").alias("subject_id"), F.col("r_name").alias("subject"))
    found = stats.taxonomy_tree(subjects, t("nation").select(F.col("n_regionkey").alias("subject_id"), F.col("n_name").alias("chapter")))
    return found.select("subject", F.array_join("chapters", ",").alias("chapters"))


@query(f"WITH {_BRIDGE} SELECT tag_id, count(*) AS questions FROM bridge GROUP BY 1 UNION ALL SELECT 'unused', 0")
def tag_counts(t):
    """Distinct questions of each tag, and a tag that no question has."""
    tags = _bridge(t).select("tag_id").distinct().union(t("region").limit(1).select(F.lit("unused")))
    return stats.tag_distribution(tags, _bridge(t))


@query("""SELECT question_type, questions, paper_items FROM (SELECT p_type AS question_type, count(*) AS questions FROM part GROUP BY 1)
          JOIN (SELECT p_type AS question_type, count(*) AS paper_items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) USING (question_type)""")
def type_catalog(t):
    """Types with their numbers of questions and of items in papers."""
    parts = _parts(t)
    items = t("lineitem").select(F.col("l_partkey").alias("id")).join(parts.select("id", "question_type"), "id")
    return stats.counted(stats.counted(parts.select("question_type").distinct(), parts, "question_type"), items, "question_type", "paper_items")


@query(f"""WITH {_BRIDGE}, c AS (SELECT p_type FROM part WHERE p_brand IN ('Brand#2', 'Brand#17') AND p_partkey NOT IN (1, 2, 3)
          AND p_partkey IN (SELECT question_id FROM bridge WHERE tag_id IN ('A-F', 'N-O', 'R-F')))
          SELECT p_type AS question_type, count(*) AS n FROM c GROUP BY ROLLUP (p_type)""")
def draw_analyze(t):
    """Candidates of a draw by type, and in all."""
    return sampling.analyse(sampling.draw_scope(_parts(t), _bridge(t), subjects=("Brand#2", "Brand#17"), tags=HARD_TAGS, excluded=(1, 2, 3)))


@query("SELECT p_partkey AS id, md5('11:' || p_partkey) AS draw_key FROM part ORDER BY 2, 1 LIMIT 40")
def draw_total_seeded(t):
    """Forty questions in seeded random order."""
    return sampling.draw_total(_parts(t), 40, seed=11).select("id", "draw_key")


@query("""SELECT id, question_type, CAST(draw_rank AS INTEGER) AS draw_rank FROM (SELECT p_partkey AS id, p_type AS question_type,
          row_number() OVER (PARTITION BY p_type ORDER BY md5('12:' || p_partkey), p_partkey) AS draw_rank FROM part)
          WHERE draw_rank <= CASE question_type WHEN 'ECONOMY' THEN 5 WHEN 'PROMO' THEN 9 WHEN 'SMALL' THEN 2 ELSE 0 END""")
def draw_by_type_seeded(t):
    """A stratified draw in seeded random order."""
    return sampling.draw_by_type(_parts(t), {"ECONOMY": 5, "PROMO": 9, "SMALL": 2}, seed=12).select("id", "question_type", "draw_rank")


@query()
def draw_random(t):
    """Forty questions at random."""
    return sampling.draw_total(_parts(t), 40).select("id")


@query("""WITH n AS (SELECT coalesce(source, '__uncategorized__') AS source, count(*) AS questions FROM documents GROUP BY 1)
          SELECT source, questions, questions / max(questions) OVER () AS share_of_most,
          sum(questions) OVER (ORDER BY source = '__uncategorized__', source ROWS UNBOUNDED PRECEDING) / sum(questions) OVER () AS running_share FROM n""")
def stat_subjects(t):
    """Documents by source, as shares of the most and running."""
    return stats.distribution(t("documents"), "source")


@query("""SELECT lang, source, questions, CAST(row_number() OVER (ORDER BY questions DESC, lang, source) AS INTEGER) AS place
          FROM (SELECT lang, source, count(*) AS questions FROM documents GROUP BY 1, 2)""")
def stat_chapters(t):
    """Chapters by falling number of documents."""
    return stats.ranking(t("documents"), ["lang", "source"])


@query(f"""WITH {_USE}, {_PARTS}, f AS (SELECT *, TIMESTAMP '2001-08-02' - to_days(CAST(unit AS INTEGER)) AS created_at FROM parts)
          SELECT count(*) AS total, count(*) FILTER (WHERE created_at >= TIMESTAMP '2001-08-02' - INTERVAL 30 DAY) AS added,
          count(*) FILTER (WHERE last_used_at >= TIMESTAMP '2001-08-02' - INTERVAL 30 DAY) AS used,
          count(*) FILTER (WHERE last_used_at IS NULL) AS never_used,
          format('{{:.1f}}', count(*) FILTER (WHERE last_used_at IS NULL) * 100.0::DOUBLE / count(*)) AS never_used_percent FROM f""")
def stat_headline(t):
    """Totals, recent additions and use, and the share that was never used."""
    rows = _used_parts(t).withColumn("created_at", F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.col("unit")))
    return stats.headline(rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), NOW, 30)


_PRINT = "sha256('2;2;' || len(p_type) || ':' || p_type || len(s) || ':' || s || len(a) || ':' || a)"
_PRINTS = f"prints AS (SELECT *, {_PRINT} AS fingerprint FROM (SELECT p_partkey AS id, p_type, lower(regexp_replace(p_name, '\\s', '', 'g')) AS s, lower(regexp_replace(p_brand, '\\s', '', 'g')) AS a FROM part))"


def _prints(t) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("created"), T.content_fingerprint(F.col("p_type"), [F.col("p_name"), F.col("p_brand")]).alias("fingerprint"))


@query(f"WITH {_PRINTS} SELECT fingerprint, string_agg(id, ',' ORDER BY id) AS members, count(*) AS size FROM prints GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(t):
    """Questions with the same type, stem and answer."""
    return dedup.exact_groups(_prints(t)).withColumn("members", F.array_join("members", ","))


@query(f"WITH {_PRINTS}, m AS (SELECT fingerprint, min(id) AS m FROM prints GROUP BY 1) SELECT id AS ordinal, CASE WHEN m < id THEN m END AS first FROM prints JOIN m USING (fingerprint)")
def first_occurrence_in_batch(t):
    """For each row the earlier one with the same content."""
    return dedup.first_occurrence(_prints(t).withColumnRenamed("id", "ordinal")).select("ordinal", "first")


_STEMS = "stems AS (SELECT p_partkey AS id, p_partkey AS updated, lower(replace(p_name || p_brand || p_type || CAST(p_size AS VARCHAR), ' ', '')) AS text FROM part), "
_STEMS += "sized AS (SELECT *, len(text) AS length FROM stems), "
_GRAMS = "grams AS (SELECT id, substr(text, i, 2) AS gram, count(*) AS n FROM (SELECT id, text, unnest(range(1, len(text))) AS i FROM stems) GROUP BY 1, 2), "


def _stems(t) -> DataFrame:
    text = T.compared_text(F.concat("p_name", "p_brand", "p_type", F.col("p_size").cast("string")))
    rows = t("part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("updated"), text.alias("text"))
    return rows.withColumns({"length": F.length("text"), "fingerprint": F.sha2("text", 256)})


@query(f"""WITH {_STEMS} placed AS (SELECT *, row_number() OVER (ORDER BY length, updated DESC, id) AS p FROM sized),
          near AS (SELECT a.id, b.id AS c, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.length - b.length), b.updated DESC, b.id) AS k
                   FROM placed a JOIN placed b ON a.id <> b.id AND b.p BETWEEN a.p - 256 AND a.p + 256),
          pairs AS (SELECT DISTINCT least(id, c) AS l, greatest(id, c) AS r FROM near WHERE k <= 256), {_GRAMS}
          shared AS (SELECT l, r, sum(least(a.n, b.n)) AS s FROM pairs JOIN grams a ON a.id = l JOIN grams b ON b.id = r AND b.gram = a.gram GROUP BY 1, 2),
          scored AS (SELECT l, r, x.text AS t1, y.text AS t2, least(100, (200 * s + (len(x.text) + len(y.text) - 2) // 2) // (len(x.text) + len(y.text) - 2)) AS v
                     FROM shared JOIN stems x ON x.id = l JOIN stems y ON y.id = r)
          SELECT l AS left_id, r AS right_id, CAST(least(v, 99) AS INTEGER) AS similarity FROM scored WHERE v >= 82 AND t1 <> t2""")
def near_duplicate_scan(t):
    """Suspected duplicates over the whole bank."""
    return dedup.near_pairs(_stems(t))


_PROBE = "probes AS (SELECT s_suppkey AS id, lower(replace('blue ' || s_name, ' ', '')) AS text FROM supplier), "


@query(f"""WITH {_STEMS} {_PROBE} near AS (SELECT p.id AS pid, p.text AS t1, b.id AS c, b.text AS t2, row_number() OVER (PARTITION BY p.id ORDER BY abs(len(p.text) - b.length), b.updated DESC, b.id) AS k
          FROM probes p, sized b), top AS (SELECT * FROM near WHERE k <= 256), {_GRAMS}
          pg AS (SELECT id, substr(text, i, 2) AS gram, count(*) AS n FROM (SELECT id, text, unnest(range(1, len(text))) AS i FROM probes) GROUP BY 1, 2),
          shared AS (SELECT pid, c, sum(least(pg.n, g.n)) AS s FROM top JOIN pg ON pg.id = pid JOIN grams g ON g.id = c AND g.gram = pg.gram GROUP BY 1, 2),
          scored AS (SELECT pid, c, k, (200 * coalesce(s, 0) + (len(t1) + len(t2) - 2) // 2) // (len(t1) + len(t2) - 2) AS v FROM top LEFT JOIN shared USING (pid, c))
          SELECT pid AS probe_id, c AS candidate, CAST(least(v, 99) AS INTEGER) AS similarity, CASE WHEN v >= 82 THEN 'suspected' ELSE 'none' END AS status
          FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY v DESC, k) AS n FROM scored) WHERE n = 1""")
def import_batch_check(t):
    """The best match in the bank for each row, in the order of the check of one draft; dedup.check_batch() checks a batch."""
    text = T.compared_text(F.concat(F.lit("blue "), F.col("s_name")))
    probes = t("supplier").select(F.col("s_suppkey").alias("id"), text.alias("text")).withColumn("length", F.length("text"))
    return dedup.best_match(probes, _stems(t))


@query("""WITH v AS (SELECT p_partkey AS id, p_size AS content_version FROM part), pairs AS (SELECT p_partkey AS left_id, p_partkey + 1 AS right_id FROM part)
          SELECT left_id, right_id, a.content_version AS left_version, b.content_version AS right_version FROM pairs JOIN v a ON a.id = left_id JOIN v b ON b.id = right_id
          WHERE NOT (left_id % 3 = 0 AND a.content_version = 11) AND NOT (left_id % 3 = 0 AND b.content_version = 11)""")
def ignore_pairs_versioned(t):
    """Pairs that are not ignored at their present versions."""
    versions = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("content_version"))
    pairs = versions.select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"))
    side = versions.withColumnsRenamed({"id": "left_id", "content_version": "left_version"}).join(versions.select((F.col("id") - 1).alias("left_id"), F.col("content_version").alias("right_version")), "left_id")
    ignores = side.where((F.col("left_id") % 3 == 0) & ((F.col("left_version") == 11) | (F.col("right_version") == 11))).withColumn("right_id", F.col("left_id") + 1)
    return dedup.without_ignored(pairs, versions, ignores)


@query(f"""WITH {_BRIDGE}, m AS (SELECT p_name AS group_id, p_partkey AS id FROM part)
          SELECT m.group_id, min(m.id) AS keeper, coalesce(string_agg(DISTINCT tag_id, ',' ORDER BY tag_id), '') AS tags FROM m LEFT JOIN bridge ON question_id = id GROUP BY 1""")
def merge_tags_union(t):
    """Tags of merged groups and who keeps them."""
    found = dedup.merged_tags(t("part").select(F.col("p_name").alias("group_id"), F.col("p_partkey").alias("id")), _bridge(t))
    return found.select("group_id", "keeper", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"))


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events QUALIFY place <= 50")
def history_top50(t):
    """The newest 50 versions of each entity."""
    return history.newest(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "user_id", "place")


@query("SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events QUALIFY place > 7")
def backup_retention(t):
    """What goes when seven of each kind are kept."""
    return history.beyond_retention(t("events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 7).select("event_id", "event_type", "place")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE event_type <> 'error' GROUP BY 1")
def latest_receipt(t):
    """The latest operation of each entity that was not undone."""
    return history.latest(t("events").where("event_type <> 'error'"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


def _items(t) -> DataFrame:
    items = t("lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("question_id"), "l_suppkey", "l_quantity", "l_extendedprice")
    items = items.withColumn("item_id", F.concat_ws("-", "question_id", "l_suppkey", F.col("l_quantity").cast("int"), F.floor("l_extendedprice")))
    return items.join(t("part").select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("question_type")), "question_id")


_ITEMS = """items AS (SELECT l_orderkey AS paper_id, l_linenumber AS position, l_partkey AS question_id, p_type AS question_type,
            l_partkey || '-' || l_suppkey || '-' || CAST(trunc(l_quantity) AS INTEGER) || '-' || CAST(floor(l_extendedprice) AS BIGINT) AS item_id FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(f"""WITH {_ITEMS}, m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR question_type <> lag(question_type) OVER w THEN 1 ELSE 0 END AS s FROM items WINDOW w AS (PARTITION BY paper_id ORDER BY position, item_id)),
          n AS (SELECT *, sum(s) OVER (PARTITION BY paper_id ORDER BY position, item_id ROWS UNBOUNDED PRECEDING) AS section FROM m)
          SELECT paper_id, CAST(section AS BIGINT) AS section, min(question_type) AS question_type, min(position) AS first_position, count(*) AS items FROM n GROUP BY 1, 2""")
def section_islands(t):
    """Runs of one type in each paper."""
    return papers.sections(_items(t))


@query(f"""WITH {_ITEMS} SELECT paper_id, item_id, position, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY CASE question_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'LARGE' THEN 3 ELSE 4 END, position, item_id) - 1 AS INTEGER) AS new_position FROM items""")
def renumber_items(t):
    """Items by type order, numbered anew."""
    return papers.renumbered(_items(t), ["PROMO", "SMALL", "LARGE"]).select("paper_id", "item_id", "position", "new_position")


@query("""SELECT paper_id, question_id, min(ordinal) AS ordinal FROM (SELECT l_orderkey % 97 AS paper_id, l_partkey AS question_id, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem)
          WHERE (paper_id, question_id) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem) GROUP BY 1, 2""")
def add_to_paper(t):
    """Questions that a paper has not yet, the first of each."""
    items = t("lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("question_id"))
    more = t("lineitem").select((F.col("l_orderkey") % 97).alias("paper_id"), F.col("l_partkey").alias("question_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return papers.added(items, more)


@query("""SELECT ref, owner, count(*) AS n FROM (SELECT l_partkey AS ref, 'line' AS owner FROM lineitem UNION ALL SELECT s_nationkey, 'supplier' FROM supplier
          UNION ALL SELECT c_nationkey, 'customer' FROM customer) GROUP BY 1, 2""")
def resource_refs_union_counts(t):
    """References of several kinds of owners, counted."""
    kinds = [t("lineitem").select(F.col("l_partkey").alias("ref"), F.lit("line").alias("owner")), t("supplier").select(F.col("s_nationkey").cast("long").alias("ref"), F.lit("supplier").alias("owner")), t("customer").select(F.col("c_nationkey").cast("long").alias("ref"), F.lit("customer").alias("owner"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("ref", "owner").agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id AS draft_id, d.doc_id % 3 <> 0 AND (quality IS NULL OR quality <> 1) AS stale FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)""")
def stale_drafts(t):
    """Drafts whose target changed or went."""
    kind = F.when(F.col("doc_id") % 3 == 0, "question_create").otherwise("question_edit")
    drafts = t("documents").select(F.col("doc_id").alias("draft_id"), kind.alias("kind"), F.col("doc_id").alias("target_id"), F.lit(1).alias("base_version"))
    current = t("labels").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("content_version"))
    return history.stale_drafts(drafts, current).select("draft_id", "stale")


@query("""WITH l AS (SELECT o_orderkey AS paper_id, 'P' || o_orderkey AS title, count(l_linenumber) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
          p AS (SELECT o_orderkey AS paper_id, o_orderpriority AS title FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'P')
          SELECT coalesce(l.paper_id, p.paper_id) AS paper_id, coalesce(p.title, l.title, '') AS title, coalesce(items, 0) AS items,
          CASE WHEN p.paper_id IS NULL THEN 'local' WHEN l.paper_id IS NULL THEN 'cloud' ELSE 'both' END AS origin FROM l FULL JOIN p ON l.paper_id = p.paper_id""")
def publication_merge(t):
    """Local papers and publications in one list."""
    orders = t("orders")
    counts = t("lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.count("*").alias("items"))
    local = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("paper_id"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("title")).join(counts, "paper_id", "left").fillna(0, ["items"])
    cloud = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") != "P").alias("published"))
    return papers.publications(local, cloud)


@query("""SELECT user_id AS target_id, count(DISTINCT event_type) AS signatures, min(event_id) AS representative, count(*) - 1 AS duplicates, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY 1""")
def overwrite_plan(t):
    """Which imported rows overwrite a target, and which conflict."""
    return history.overwrite_plan(t("events").select(F.col("user_id").alias("target_id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("signature")))


@query("SELECT event_type, CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_counts(t):
    """Counts by a field of a JSON column."""
    return t("events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT 'line_has_order' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
          UNION ALL SELECT 'line_has_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
          UNION ALL SELECT 'label_has_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
          UNION ALL SELECT 'position_once', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)""")
def constraint_violations(t):
    """How many rows break each rule."""
    line = t("lineitem")
    rules = [history.orphans(line, t("orders"), ["l_orderkey"], ["o_orderkey"], "line_has_order"), history.orphans(line, t("part"), ["l_partkey"], ["p_partkey"], "line_has_part")]
    rules += [history.orphans(t("labels"), t("documents"), ["doc_id"], ["doc_id"], "label_has_document"), history.repeated(line, ["l_orderkey", "l_linenumber"], "position_once")]
    return rules[0].union(rules[1]).union(rules[2]).union(rules[3])


@query("""SELECT p_partkey AS id, CAST(row_number() OVER (ORDER BY p_brand, p_type, p_partkey) AS BIGINT) - 1 AS row_number,
          'A. ' || p_name || chr(10) || 'B. ' || p_brand AS options, strftime(make_timestamp(p_partkey * 1000000007), '%Y-%m-%d %H:%M:%S') || ' UTC' AS changed FROM part""")
def export_rows(t):
    """Export columns: row number, labelled options and time as text."""
    from quillbank.functions.tables import numbered

    placed = numbered(t("part"), [F.asc("p_brand"), F.asc("p_type"), F.asc("p_partkey")], "row_number")
    changed = T.utc_text(F.floor(F.col("p_partkey") * 1000000.007).cast("long"))
    return placed.select(F.col("p_partkey").alias("id"), "row_number", T.option_lines(F.array("p_name", "p_brand")).alias("options"), changed.alias("changed"))


@query("""WITH d AS (SELECT doc_id AS id, trim(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS s FROM documents)
          SELECT id, CASE WHEN len(s) > 160 THEN s[:160] || '…' ELSE s END AS preview FROM d""")
def stem_previews(t):
    """The first line's worth of every document."""
    return t("documents").select(F.col("doc_id").alias("id"), T.stem_preview(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("preview"))
