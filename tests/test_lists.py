import pytest

from cartlens.operators.folds import assign_folds
from cartlens.operators.lists import unlist_ratings, user_ratings_list
from cartlens.sources import ARRIVAL, numbered_lines, read_ratings


def test_a_hot_user_is_many_rows(spark):
    rows = [(0, i, float(i % 5)) for i in range(2000)] + [(u, i, 1.0) for u in range(1, 400) for i in range(10)] + [(None, 3, 2.0), (0, 5, 0.0)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, qty double")
    lists = user_ratings_list(df, 100).collect()
    hot = sorted((r for r in lists if r.user_id == 0), key=lambda r: r.chunk)
    assert [len(r.ratings) for r in hot] == [100] * 20 + [1] and {r.n_ratings for r in hot} == {2001}
    items = [e.item_id for r in hot for e in r.ratings]
    assert items == sorted(items)
    assert max(len(r.ratings) for r in lists) == 100 and len(lists) == 21 + 399 + 1
    back = unlist_ratings(user_ratings_list(df, 7))
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    assert user_ratings_list(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        user_ratings_list(df, 0)


def _write(folder, files):
    import os

    os.makedirs(folder, exist_ok=True)
    for name, lines in files.items():
        with open(f"{folder}/{name}", "w", newline="") as f:
            f.write("".join(x + "\n" for x in lines))


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_line_numbers_hold_under_any_split(spark, tmp_dir, split):
    files = {
        "b.txt": [f"line {i} " + "x" * (i % 37) for i in range(700)],
        "a.txt": ["", "é" * 50, "", "same", "same"],
        "c.txt": [],
        "d.txt": ["y" * 5000, "z"],
    }
    _write(f"{tmp_dir}/in", files)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = numbered_lines(spark, f"{tmp_dir}/in").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.line_no)):
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line_no, r.value))
    assert got == {name: list(enumerate(lines)) for name, lines in files.items() if lines}


def test_folds_follow_arrival(spark, tmp_dir):
    """23 lines of one user in falling item order: cut as they stand, not by item."""
    _write(f"{tmp_dir}/in", {"r.txt": [f"7;{100 - i};1.0" for i in range(23)]})
    ratings = read_ratings(spark, f"{tmp_dir}/in", item_ids="code", arrival=True)
    folded = assign_folds(ratings, order_cols=ARRIVAL).orderBy("line_no").collect()
    assert [r.fold for r in folded] == [f for f in range(7) for _ in range(2)] + [f for f in (7, 8, 9) for _ in range(3)]
    assert [r.item_code for r in folded] == [str(100 - i) for i in range(23)]
    hashed = read_ratings(spark, f"{tmp_dir}/in", arrival=True)
    assert hashed.columns == ["user_id", "item_code", "item_id", "qty", "file", "line_no"]


def test_malformed_lines_keep_their_place(spark, tmp_dir):
    _write(f"{tmp_dir}/in", {"r.txt": ["1;a;2.0", "broken", "2;b;3.0"]})
    rows = read_ratings(spark, f"{tmp_dir}/in", item_ids="code", mode="PERMISSIVE", arrival=True).orderBy("line_no").collect()
    assert [(r.user_id, r.item_code, r.line_no) for r in rows] == [(1, "a", 0), (None, None, 1), (2, "b", 2)]
    with pytest.raises(Exception, match="malformed line"):
        read_ratings(spark, f"{tmp_dir}/in", item_ids="code", arrival=True).count()
