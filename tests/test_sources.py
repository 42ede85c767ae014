import glob
import os

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors

from cartlens.sources import (
    load_kmeans_model,
    read_baskets,
    read_cluster_assignments,
    read_purchases_frame,
    read_ratings,
    save_kmeans_model,
    write_delimited,
)
from cartlens.sources.jdbc import jdbc_options
from cartlens.operators.vectors import numeric_columns_to_vector


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_read_ratings_hash_and_code(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "r.txt"), "1;ABC-12345678;2.0\n2;Aa;1.5\n2;BB;3\n")
    rows = [tuple(r) for r in read_ratings(spark, p).collect()]
    assert rows == [(1, "ABC-12345678", -413191761, 2.0), (2, "Aa", 2112, 1.5), (2, "BB", 2112, 3.0)]
    assert read_ratings(spark, p, item_ids="code").columns == ["user_id", "item_code", "qty"]


def test_read_ratings_failfast(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "bad.txt"), "1;A;2.0\n2;B\n")
    with pytest.raises(Exception):
        read_ratings(spark, p).collect()
    p2 = _write(os.path.join(tmp_dir, "bad2.txt"), "x;A;2.0\n")
    with pytest.raises(Exception):
        read_ratings(spark, p2).collect()
    permissive = read_ratings(spark, p, mode="PERMISSIVE").collect()
    assert len(permissive) == 2


def test_read_purchases_int_items(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "p.txt"), "1;10;2.0\n1;11;1.0\n")
    df = read_purchases_frame(spark, p, item_type="int")
    assert dict(df.dtypes) == {"user_id": "bigint", "item_id": "int", "qty": "double"}
    assert df.count() == 2


def test_read_cluster_assignments_multi_file(spark, tmp_dir):
    d = os.path.join(tmp_dir, "clusters")
    os.makedirs(d)
    from cartlens.sources.text import CLUSTER_FILE_HEADER

    header = ";".join(CLUSTER_FILE_HEADER)
    _write(os.path.join(d, "part-0.csv"), f"{header}\n0;5\n1;7\n")
    _write(os.path.join(d, "part-1.csv"), f"{header}\n1;9\n")
    rows = sorted(tuple(r) for r in read_cluster_assignments(spark, d).collect())
    assert rows == [(0, 5), (1, 7), (1, 9)]


def test_read_baskets(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "b.txt"), " a|b|a|| \nc|d\n")
    got = sorted(r["items"] for r in read_baskets(spark, p).collect())
    assert got == [["a", "b"], ["c", "d"]]


def test_write_delimited_single_file(spark, tmp_dir):
    df = spark.createDataFrame([(1, None, "x"), (2, 1.5, "")], "id int, v double, s string")
    out = os.path.join(tmp_dir, "out")
    write_delimited(df, out, single_file=True, order_by=["id"])
    files = glob.glob(os.path.join(out, "part-*"))
    assert len(files) == 1
    with open(files[0]) as fh:
        lines = fh.read().splitlines()
    assert lines == ["id;v;s", "1;;x", "2;1.5;"]
    write_delimited(df, out)  # overwrite works
    assert spark.read.option("sep", ";").option("header", True).csv(out).count() == 2


def test_kmeans_model_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(Vectors.dense([0.0, 1.0]),), (Vectors.dense([5.0, 5.0]),)], ["features"])
    model = KMeans(k=2, seed=1).fit(df)
    path = os.path.join(tmp_dir, "km")
    save_kmeans_model(model, path)
    save_kmeans_model(model, path)  # overwrite
    loaded = load_kmeans_model(path)
    assert [list(c) for c in loaded.clusterCenters()] == [list(c) for c in model.clusterCenters()]


def test_jdbc_options():
    o = jdbc_options("jdbc:x://h/db", "select a, b from t", user="u", password="p")
    assert o["dbtable"] == "(select a, b from t) features_query" and o["user"] == "u"
    o = jdbc_options("jdbc:x", "select 1", partition_column="a", lower_bound=0, upper_bound=100, num_partitions=4)
    assert o["numPartitions"] == "4" and o["partitionColumn"] == "a"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "select 1", partition_column="a")


def test_numeric_columns_to_vector_nulls(spark):
    df = spark.createDataFrame([(1, 2, None, "z")], "id long, a long, b long, s string")
    row = numeric_columns_to_vector(df, keep=["id"], columns=["a", "b"]).first()
    assert row["id"] == 1 and list(row["features"]) == [2.0, 0.0]
    with pytest.raises(ValueError, match="not numeric"):
        numeric_columns_to_vector(df, keep=["id"])


def test_lines_are_split_plainly(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "q.txt"), '1;"ab;2.0\n4;;5.0\n6;"x";1.0\n')
    rows = [tuple(r) for r in read_ratings(spark, p, item_ids="code").collect()]
    assert rows == [(1, '"ab', 2.0), (4, "", 5.0), (6, '"x"', 1.0)]
    assert [r["item_id"] for r in read_ratings(spark, p).where("user_id = 4").collect()] == [0]


def test_malformed_lines_stop_any_use(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "m.txt"), "1;a;2.0\n2;b;bad\n")
    for use in (lambda df: df.count(), lambda df: df.select("user_id").collect(), lambda df: df.select("item_code").collect()):
        with pytest.raises(Exception, match="malformed line: 2;b;bad"):
            use(read_ratings(spark, p, item_ids="code"))
    kept = read_ratings(spark, p, item_ids="code", mode="PERMISSIVE").collect()
    assert [tuple(r) for r in kept] == [(1, "a", 2.0), (None, None, None)]
    for bad in ("1;a\n", "1;a;2.0;x\n", "1.5;a;2\n", ";;\n", "\n", "99999999999;a;1\n"):
        with pytest.raises(Exception, match="malformed line"):
            read_ratings(spark, _write(os.path.join(tmp_dir, "bad.txt"), bad)).count()
