import hashlib

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from cartlens.llm import bpe, toxicity
from cartlens.llm.common import stored

from .test_decontaminate import slow as slow_leak
from .test_decontaminate import toks
from .test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def leaks(text, items):
    have = set(zip(*[toks(text)[k:] for k in range(5)], strict=False))
    return any(have & set(zip(*[toks(i)[k:] for k in range(5)], strict=False)) and slow_leak(text, i) for i in items)


@pytest.fixture(scope="module")
def steps(spark):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF))
        found.append((docs, after))
        docs = after
    return found


def test_columns_and_rows(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0


def test_toxicity(spark, steps):
    before, after = steps[0]
    scores = toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in scores if not r.predicted) == sorted(r.doc_id for r in after.collect())


def test_exact(steps):
    before, after = steps[1]
    last = {}
    for r in before.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    assert sorted(last.values()) == sorted(r.doc_id for r in after.collect())


def test_near(steps):
    before, after = steps[2]
    fp = {r.doc_id: slow_fingerprint(r.text) for r in before.collect()}
    groups = slow_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    assert sorted(set(groups.values())) == sorted(r.doc_id for r in after.collect())


def test_benchmark(spark, steps):
    before, after = steps[3]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in before.collect() if not leaks(r.text, items)) == sorted(r.doc_id for r in after.collect())


def test_encoding(steps):
    before, after = steps[4]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    want = {}
    for r in before.collect():
        ids = library.encode_ordinary(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()} == want


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.collect()) == sorted(steps[-1][1].collect())


ODD = "doc_id long, text string, lang string, source string, n_chars long, row_ int, score_ string, TEXT_ string"


def _odd(spark, rows):
    return stored(spark.createDataFrame([(d, t, "en", "s", None, 1, None, "x") for d, t in rows], ODD))


def test_odd_rows_in_every_stage(spark):
    """Null ids and texts, empty and very long texts, repeated rows and clashing column
    names: no stage fails, and only copies go."""
    long = " ".join(f"plain{i % 997} word{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (None, "some plain words of no harm"), (3, "some plain words of no harm"), (4, long), (4, long), (None, None), (5, " \n\t")]
    docs = _odd(spark, rows)
    (_, toxic), (_, exact), (_, near), (_, leaks), (_, encode) = corpus_pipeline.STAGES
    kept = toxic(spark, docs, SF)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    kept = stored(exact(spark, docs, SF))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "")[:4]) for r in kept.collect()) == [("2", ""), ("3", "some"), ("4", "plai"), ("5", " \n\t")]
    kept = stored(near(spark, kept, SF))  # texts without words are near one another
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4"]
    assert sorted(str(r.doc_id) for r in leaks(spark, docs, SF).collect()) == sorted(str(d) for d, _ in rows)
    coded = encode(spark, docs, SF)
    assert sorted((str(r.doc_id), r.n_tokens == 0) for r in coded.collect()) == sorted((str(d), not t) for d, t in rows)


def test_empty_tables_in_every_stage(spark):
    docs = _odd(spark, [(1, "x")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        assert name == "byte-level bpe" or out.columns == docs.columns
