import hashlib
import random

import pytest

from cartlens.llm import exact
from tests.conftest import SF001
from tools.oracle_check import compare


@pytest.mark.parametrize("block", [1, 8, 4096])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    texts = ["", "a", "ab", "abab", "ababa", "é" * 9, "ab" * 20, "ba" * 20, "x" * 33, "x" * 34, None]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    rows = [(rng.choice([None, *range(30)]), t, i) for i, t in enumerate(texts + ["hot" * 5] * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, name int")
    got = exact.exact_duplicates(df, block).collect()
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(t or "", []).append(d)
    want, kept = [], {}
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(str(d), str(keep), len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
        kept[hashlib.sha256(t.encode()).hexdigest()] = [keep]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted(want)
    found = {}
    for r in got:
        if r.kept:
            found.setdefault(r.text_sha256, []).append(r.doc_id)
    assert found == kept


def test_rows_that_stay(spark):
    df = spark.createDataFrame([(1, "t", 0), (1, "t", 1), (None, "t", 2), (None, None, 3), (None, "", 4)], "doc_id long, text string, row_ int")
    out = exact.drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == [("1", "t"), ("None", "")]
    assert exact.exact_duplicates(df.limit(0)).count() == 0


def test_oracle(spark):
    assert compare(spark, SF001, ["op2_exact_dedup"], verbose=False) == {"op2_exact_dedup": True}
