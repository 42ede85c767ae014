import hashlib
import random
import re

import pytest

from cartlens.llm import pii

FIXED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def slow(text):
    out = []
    for kind, pattern in FIXED.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def cases():
    rng = random.Random(4)
    bits = ["a@b.c", "@", ".", "x_y%z@q-1.com", "1.2.3.4", "255.255.255.256", "0255.01.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (487) 555-7209", "+", " ", "-", "(", ")", "12", "9" * 14, "é", "𝒳", "\n", "_d@e.f", "call 555-123-4567", "ann (at) mail (dot) com", "00000000000000", "+12345678", "1.2.3", "10.0.0.1.5", "%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(500)]
    texts += ["", None, "x" * 5_000, "1" * 5_000, "+1" + "." * 50_000, "a.b" * 2_000 + "@c.d", "a@" + "b." * 20_000 + "c", "1-" * 40_000, "1.1" * 20_000, "plain words only"]
    return texts


def test_equals_brute_force(spark):
    texts = cases()
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, "a@b.c", 1), (0, texts[0], 1)], "doc_id long, text string, kind int")
    got = pii.span_summary(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = slow(texts[r.doc_id] if r.doc_id is not None else "a@b.c")
        assert r.base_spans.split(",") == (want or [""]), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in FIXED]
        assert set(want) <= set(r.spans.split(","))
    assert pii.span_summary(df.limit(0)).count() == 0
    assert {r.spans for r in pii.span_summary(df.where("text = 'plain words only'")).collect()} == {""}


def test_adds_spans_that_the_labelers_agree_on(spark):
    rng = random.Random(9)
    number = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    docs = []
    for i in range(300):
        docs.append(rng.choice([f"contact ann{i}@mail.com now", f"call +49 {number(3)} {number(7)} today", f"token 99{number(14)}x", f"host 10.{i % 200}.3.4 up"]))
    docs += ["please call 555-123-4567 today", "write to bob (at) mail (dot) com soon"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.span_summary(df).collect()}
    assert (got[300].base_spans, got[300].spans) == ("", "phone:12:24")
    assert (got[301].base_spans, got[301].spans) == ("", "email:9:32")
    assert all(r.spans == r.base_spans for r in got.values() if docs[r.doc_id].startswith("token"))


def test_reliabilities(spark):
    rows, rng = [], random.Random(2)
    for _ in range(600):
        true = rng.random() < 0.5
        right = lambda p: (1 if true else -1) if rng.random() < p else (-1 if true else 1)  # noqa: E731,B023
        rows.append(("card", right(0.95), right(0.9), right(0.5), 0, 0, right(0.85)))
    df = spark.createDataFrame(rows, "kind string, " + ", ".join(f"v_{n} int" for n in pii.LABELERS))
    counts = df.groupBy(*df.columns).count().withColumnRenamed("count", "n")
    model = pii.estimate_reliabilities(counts)
    strength = {n: model[n, 1] - model[n, -1] for n in ("rule", "gazetteer", "checksum", "boundary")}
    assert strength["rule"] > strength["boundary"] > abs(strength["checksum"])
    assert strength["gazetteer"] > 2


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    from cartlens.llm.queries import QUERIES

    df = QUERIES["op6_pii"](spark, sf)
    assert "Python" not in df._jdf.queryExecution().toString()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = df.collect()
    assert len(got) == len(texts)
    for r in got:
        want = slow(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in FIXED]
        assert set(want) <= set(r.spans.split(",")) | {""}
