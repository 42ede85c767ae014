import os

import pytest

from cartlens.operators.relations import load_ratings
from cartlens.plans.wide_table import csv_field, wide_lines, write_wide_lines, write_wide_table
from cartlens.sources import write_delimited
from cartlens.sources.sinks import join_files
from tests.conftest import SF001


def _only(folder):
    names = sorted(n for n in os.listdir(folder) if not n.startswith((".", "_")))
    assert len(names) == 1 and os.path.exists(f"{folder}/_SUCCESS"), names
    with open(f"{folder}/{names[0]}", "rb") as f:
        return f.read()


def _one_task(df, folder, header=True):
    (df.coalesce(1).write.mode("overwrite").option("sep", ";").option("header", str(header).lower())
     .option("emptyValue", "").option("nullValue", "").csv(folder))
    return _only(folder)


@pytest.mark.parametrize("header", [True, False])
def test_one_file_as_one_task_would_write_it(spark, tmp_dir, header):
    df = spark.range(0, 5000, 1, 9).selectExpr("id", "concat('a;', id) AS `odd;name`", "if(id % 3 = 0, null, 'x\"y') AS t", "'' AS e")
    write_delimited(df, f"{tmp_dir}/ours", single_file=True, header=header)
    assert _only(f"{tmp_dir}/ours") == _one_task(df, f"{tmp_dir}/plain", header)
    write_delimited(df.limit(0), f"{tmp_dir}/ours", single_file=True, header=header)  # overwrites
    assert _only(f"{tmp_dir}/ours") == _one_task(df.limit(0), f"{tmp_dir}/plain", header)
    assert sorted(os.listdir(tmp_dir)) == ["ours", "plain"]  # nothing is left beside them


def test_rows_are_written_by_many_tasks(spark, tmp_dir):
    """The joined file holds the parts of all tasks; no part has all rows."""
    df = spark.range(0, 9000, 1, 6).selectExpr("id % 100 AS a", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_delimited(df, f"{tmp_dir}/parts", order_by=["a", "id"], header=False)
        write_delimited(df, f"{tmp_dir}/one", order_by=["a", "id"], single_file=True, header=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [os.path.getsize(f"{tmp_dir}/parts/{n}") for n in os.listdir(f"{tmp_dir}/parts") if n.startswith("part-")]
    assert len(sizes) > 4 and max(sizes) < sum(sizes) / 2
    lines = _only(f"{tmp_dir}/one").decode().split()
    assert lines == [f"{i % 100};{i}" for i in sorted(range(9000), key=lambda i: (i % 100, i))]


def test_join_of_folders_and_texts(spark, tmp_dir):
    spark.range(0, 100, 1, 4).selectExpr("cast(id AS string)").write.text(f"{tmp_dir}/a")
    spark.range(0).selectExpr("cast(id AS string)").write.text(f"{tmp_dir}/b")
    join_files(spark, [b"head\n", f"{tmp_dir}/a", b"", f"{tmp_dir}/b", "é".encode()], f"{tmp_dir}/out")
    with open(f"{tmp_dir}/out") as f:
        assert f.read() == "head\n" + "".join(f"{i}\n" for i in range(100)) + "é"
    join_files(spark, [], f"{tmp_dir}/none")
    assert os.path.getsize(f"{tmp_dir}/none") == 0


def test_wide_lines_are_the_pivots_lines(spark, tmp_dir):
    ratings = load_ratings(spark, SF001)
    items = write_wide_lines(ratings, f"{tmp_dir}/ours")
    write_wide_table(ratings.orderBy("user_id"), f"{tmp_dir}/pivot", single_file=True)
    ours, pivot = _only(f"{tmp_dir}/ours").splitlines(), _only(f"{tmp_dir}/pivot").splitlines()
    assert items == 200 and ours[0] == pivot[0] and sorted(ours) == sorted(pivot)
    users = [int(x.split(b";")[0]) for x in ours[1:]]
    assert users == sorted(users)


def test_wide_lines_of_odd_cells(spark, tmp_dir):
    rows = [(1, "b;c", 2.0), (1, "a", 1.0), (2, 'q"', 3.0), (2, "a", None), (3, "a", None)]
    df = spark.createDataFrame(rows, "user_id long, item_id string, qty double")
    write_wide_lines(df, f"{tmp_dir}/ours", header_user="id_cliente")
    assert _only(f"{tmp_dir}/ours").decode() == 'id_cliente;a;"b;c";"q\\""\n1;1.0;2.0;\n2;;;3.0\n3;;;\n'
    write_wide_table(df.withColumnRenamed("user_id", "id_cliente").withColumnRenamed("id_cliente", "user_id"), f"{tmp_dir}/pivot", single_file=True)
    assert sorted(_only(f"{tmp_dir}/pivot").decode().splitlines()[1:]) == sorted(_only(f"{tmp_dir}/ours").decode().splitlines()[1:])
    write_wide_lines(df.limit(0), f"{tmp_dir}/none")
    assert _only(f"{tmp_dir}/none") == b"user_id\n"
    one = write_wide_lines(df.where("item_id = 'a'"), f"{tmp_dir}/one")
    assert one == 1 and _only(f"{tmp_dir}/one").decode() == "user_id;a\n1;1.0\n2;\n3;\n"


def test_a_line_knows_no_limit_of_columns(spark):
    cells = spark.createDataFrame([(1, 0, 1.0), (1, 2_000_000, 2.0), (2, 7, 3.0)], "user_id long, item_idx int, qty double")
    lines = {r.user_id: r.line for r in wide_lines(cells, 2_000_001).collect()}
    assert lines[1] == "1;1.0" + ";" * 2_000_000 + "2.0" and lines[2].count(";") == 2_000_001


def test_fields_are_written_as_spark_writes_them(spark, tmp_dir):
    texts = ["a", "", "a;b", 'a"b', "a\\b", 'a\\"b;', "é", "a,b", "#x", "x y", '";', "\\;"]
    df = spark.createDataFrame([(1, t) for t in texts], "i int, t string").coalesce(1)
    written = _one_task(df, f"{tmp_dir}/t", False).decode().split("\n")[:-1]
    assert [f"1;{r[0]}" for r in df.select(csv_field(df.t)).collect()] == written


def test_a_part_is_gone_when_it_is_copied(spark, tmp_dir, monkeypatch):
    """A joined file and all of its parts are never on disk together."""
    from cartlens.sources import sinks

    spark.range(0, 4000, 1, 8).selectExpr("cast(id AS string)").write.text(f"{tmp_dir}/a")
    whole = sum(os.path.getsize(f"{tmp_dir}/a/{n}") for n in os.listdir(f"{tmp_dir}/a") if n.startswith("part-"))
    found, most = sinks._file_system(spark, f"{tmp_dir}/out"), []

    class Watched:
        def __getattr__(self, name):
            return getattr(found[0], name)

        def open(self, path):
            most.append(sum(os.path.getsize(f"{tmp_dir}/a/{n}") for n in os.listdir(f"{tmp_dir}/a") if n.startswith("part-")))
            return found[0].open(path)

    files = sinks._file_system
    monkeypatch.setattr(sinks, "_file_system", lambda session, path: (Watched(), found[1]) if path.endswith("out") else files(session, path))
    join_files(spark, [f"{tmp_dir}/a"], f"{tmp_dir}/out")
    assert os.path.getsize(f"{tmp_dir}/out") == whole
    assert len(most) == 8 and most[-1] < whole / 4


def test_wide_lines_are_sorted_while_they_are_cells(spark):
    cells = spark.createDataFrame([(2, 0, 1.0), (1, 5, 2.0)], "user_id long, item_idx int, qty double")
    plan = wide_lines(cells, 9, ordered=True)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sort = next(n for n, x in enumerate(plan) if "Sort" in x)
    assert any("repeat" in x for x in plan[:sort]) and not any("repeat" in x for x in plan[sort:])
