"""Export runs, saved banks, whole papers and recent batches on a few rows, nulls and empty tables included."""

import pytest
from pyspark.sql import functions as F

from quillbank.operators import exports, history, listing, papers, resources, sampling, stats
from tests.test_exports import bank

ENDS = "run_id long, finished_at_ms long, error_code string, error_message string, output_byte_size long"


def test_a_run_keeps_its_first_end(spark):
    started = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "run_id long")
    ends = [(1, 20, None, None, 9), (1, 10, "E", "x" * 3000, 5), (2, 5, None, None, 7), (2, 5, "E", "late", None), (9, 1, None, None, 1), (4, 8, None, None, None), (None, 1, None, None, 1)]
    got = {r["run_id"]: r for r in exports.export_runs(started, spark.createDataFrame(ends, ENDS)).collect()}
    assert {k: (r["status"], r["output_byte_size"], r["refused"], r["finished_at_ms"]) for k, r in got.items()} == {
        1: ("failed", None, 1, 10), 2: ("succeeded", 7, 1, 5), 3: ("running", None, 0, None), 4: ("succeeded", None, 0, 8), None: ("running", None, 0, None)
    }
    assert len(got[1]["error_message"]) == 2000
    assert {r["status"] for r in exports.export_runs(started, spark.createDataFrame([], ENDS)).collect()} == {"running"}


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_a_saved_bank_is_read_as_it_was(spark, tmp_path, kind):
    rows = exports.export_rows(bank(spark).withColumn("answer", F.lit('a "b", c\n\\d')), [F.col("created_at_ms"), F.col("question_id")])
    exports.save_bank(rows, kind, f"{tmp_path}/{kind}")
    order = list(exports.HEADINGS)
    got = exports.saved_bank(spark, kind, f"{tmp_path}/{kind}").select(order).orderBy("row_number").collect()
    assert got == rows.select(order).orderBy("row_number").collect()
    with pytest.raises(Exception, match="(?i)exists"):
        exports.save_bank(rows, kind, f"{tmp_path}/{kind}")
    with pytest.raises(ValueError):
        exports.save_bank(rows, "doc", f"{tmp_path}/doc")


def test_papers_batches_references_and_lists(spark):
    items = spark.createDataFrame([(1, 2, 7), (1, 1, 9), (1, 1, 8), (None, 1, 1)], "paper_id long, position int, question_id long")
    got = papers.with_items(spark.createDataFrame([(1,), (2,)], "paper_id long"), items).orderBy("paper_id").collect()
    assert [[x["question_id"] for x in r["items"]] for r in got] == [[8, 9, 7], []]

    batches = spark.createDataFrame([(i, i // 2) for i in range(30)] + [(99, None)], "batch_id long, created_at_ms long")
    got = history.recent(batches, spark.createDataFrame([(29,), (29,), (3,)], "batch_id long")).collect()
    assert {r["batch_id"]: r["items"] for r in got} == {i: 2 * (i == 29) for i in range(10, 30)}

    refs = spark.createDataFrame([(1, "n2", "r", "stem", None), (1, "n1", "r", "option", 5)], "question_id long, node_id string, resource_id string, slot string, option_id long")
    got = listing.with_resources(spark.createDataFrame([(1,), (2,)], "id long"), refs).orderBy("id").collect()
    assert [[x["node_id"] for x in r["resources"]] for r in got] == [["n1", "n2"], []]

    dimension = spark.createDataFrame([(3, 1), (1, 2), (2, 1), (4, None)], "id long, sort_order int")
    assert {r["id"]: r["place"] for r in stats.in_order(dimension).collect()} == {4: 1, 2: 2, 3: 3, 1: 4}
    assert stats.in_order(dimension.limit(0)).columns == ["id", "sort_order", "place"] and stats.in_order(dimension.limit(0)).count() == 0

    one = resources.summary(spark.createDataFrame([], "deleted_at_ms long"), spark.createDataFrame([], "paper_status string"), spark.createDataFrame([], "availability_status string"), dimension).first()
    assert tuple(one) == (0, 0, 0, 4)


def test_draw_scope_by_use_and_a_table_of_ids(spark):
    questions = spark.createDataFrame([(1, None), (2, 5), (3, 50), (4, None)], "id long, last_used_at long")
    gone = spark.createDataFrame([(4,), (None,), (4,)], "id long")
    ids = lambda **how: sorted(r["id"] for r in sampling.draw_scope(questions, **how).collect())
    assert ids(excluded=gone) == [1, 2, 3] and ids(usage="never") == [1, 4] and ids(usage="before", usage_cutoff=10, excluded=gone) == [1, 2]
