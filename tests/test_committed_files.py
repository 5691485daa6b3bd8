"""Files that are written by tasks and put in place by one commit."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillbank.operators import exports
from quillbank.sources.committed_files import FilesWriter, file_faults, file_list, save_files
from tests.test_exports import bank


def _files(spark, n=20):
    return spark.range(0, n, 1, 4).select(F.format_string("f-%03d.txt", "id").alias("name"), F.col("id").cast("string").alias("content"))


def test_all_files_or_none(spark, tmp_path):
    folder = f"{tmp_path}/out"
    save_files(_files(spark), f"file://{folder}")
    assert sorted(os.listdir(folder)) == [*(f"f-{i:03d}.txt" for i in range(20)), "manifest.json"] and os.listdir(tmp_path) == ["out"]
    assert file_list(spark, folder).agg(F.sum("bytes")).first()[0] == 30 and file_faults(spark, folder).count() == 0
    bad = F.when(F.col("name") > "f-015", F.raise_error(F.lit("boom"))).otherwise(F.col("name"))
    for rows, to, why in (
        (_files(spark), "out", "exists"), (_files(spark).union(_files(spark)), "b", "twice"), (_files(spark, 0), "b", "nothing"),
        (_files(spark).withColumn("name", bad), "b", "boom"), (_files(spark).withColumn("name", F.lit("a/b")), "b", "no name"), (_files(spark).withColumn("name", F.lit(None).cast("string")), "b", "no name"),
    ):
        with pytest.raises(Exception, match=why):
            save_files(rows, f"{tmp_path}/{to}")
        assert os.listdir(tmp_path) == ["out"]  # nothing is left of a job that failed
    save_files(_files(spark, 0), f"{tmp_path}/none", allow_none=True)
    assert os.listdir(f"{tmp_path}/none") == ["manifest.json"] and file_list(spark, f"{tmp_path}/none").count() == 0


def test_a_target_that_appears_meanwhile_is_kept(spark, tmp_path):
    folder = f"{tmp_path}/late"

    def made(batches):
        os.makedirs(folder, exist_ok=True)
        yield from batches

    with pytest.raises(Exception, match="exists"):
        save_files(_files(spark).mapInArrow(made, "name string, content string"), folder)
    assert os.listdir(tmp_path) == ["late"] and os.listdir(folder) == []


def test_a_task_that_outlives_its_job_leaves_nothing(tmp_path):
    batch = pa.RecordBatch.from_pylist([{"name": "a.txt", "content": b"x"}])
    aborted = FilesWriter(f"{tmp_path}/out", False)
    aborted.write(iter([batch]))
    aborted.abort([])
    done = FilesWriter(f"{tmp_path}/out", False)
    done.commit([done.write(iter([batch]))])
    for writer in (aborted, done):
        with pytest.raises(OSError):
            writer.write(iter([batch]))
    assert os.listdir(tmp_path) == ["out"] and sorted(os.listdir(f"{tmp_path}/out")) == ["a.txt", "manifest.json"]


def test_damage_is_found(spark, tmp_path):
    folder = f"{tmp_path}/out"
    save_files(_files(spark, 4), folder)
    os.remove(f"{folder}/f-000.txt")
    for name, text in (("f-001.txt", "x"), ("more.txt", "y")):
        with open(f"{folder}/{name}", "w") as out:
            out.write(text)
    assert {tuple(r) for r in file_faults(spark, folder).collect()} == {("f-000.txt", "missing"), ("f-001.txt", "changed"), ("more.txt", "not listed")}


@pytest.mark.parametrize("kind", ["csv", "json", "xlsx", "docx"])
def test_a_bank_in_several_files(spark, tmp_path, kind):
    rows = exports.export_rows(bank(spark), [F.col("created_at_ms"), F.col("question_id")])
    n = rows.count()
    exports.save_bank(rows, kind, f"{tmp_path}/{kind}", rows_each=2)
    names = sorted(f for f in os.listdir(f"{tmp_path}/{kind}") if f.startswith("bank-"))
    assert names == [f"bank-{i:05d}.{kind}" for i in range(-(-n // 2))]
    if kind in ("csv", "json"):
        assert exports.saved_bank(spark, kind, f"{tmp_path}/{kind}").select("row_number").orderBy("row_number").collect() == rows.select("row_number").orderBy("row_number").collect()
    with pytest.raises(Exception, match="nothing"):
        exports.save_bank(rows.where("false"), kind, f"{tmp_path}/empty")
    assert not os.path.exists(f"{tmp_path}/empty")
