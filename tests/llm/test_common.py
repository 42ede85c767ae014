import subprocess
import sys

from cartlens.llm.common import row_ids

CODE = """
import sys
from cartlens.session import build_session
from cartlens.llm.common import row_ids
spark = build_session(master="local[3]", shuffle_partitions=4)
spark.conf.unset("spark.sql.files.minPartitionNum")
docs = spark.read.parquet(sys.argv[1] + "/documents.parquet")
one = sorted(row_ids(docs.select("doc_id"), "r").collect())
spark.conf.set("spark.sql.leafNodeDefaultParallelism", "40")  # as if executors had joined
assert sorted(row_ids(docs, "r").select("doc_id", "r").collect()) == one
print("SAME", len(one))
"""


def test_numbers_outlive_a_change_of_cores():
    done = subprocess.run([sys.executable, "-c", CODE, "/root/testdata/sf0.1"], capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["SAME", "10000"], done.stderr[-2000:]


def test_row_ids_of_shuffled_rows_are_fixed(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "cast(id % 7 AS string) AS text")
    for df in (docs.repartition(7), docs.join(docs.select("doc_id"), "doc_id"), docs.orderBy("text").limit(100)):
        numbered = row_ids(df, "row_")
        first = {r.doc_id: r.row_ for r in numbered.collect()}
        assert {r.doc_id: r.row_ for r in numbered.repartition(3).where("doc_id >= 0").collect()} == first
        assert len(set(first.values())) == len(first)
        assert all("stored-" in f for f in numbered.inputFiles())


def test_row_ids_of_stored_rows_are_not_stored_again(spark, tmp_dir):
    spark.range(20).write.parquet(f"{tmp_dir}/t")
    numbered = row_ids(spark.read.parquet(f"{tmp_dir}/t").where("id > 3").selectExpr("id + 1 AS x"), "row_")
    assert not any("stored-" in f for f in numbered.inputFiles())
