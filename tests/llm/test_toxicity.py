import random
import zlib

import numpy as np
import pytest

from cartlens.llm import toxicity as X


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 56, 57, 400])
def test_windows_cover_everything(n):
    spans = X.window_spans(n)
    assert {i for s, k in spans for i in range(s, s + k)} == set(range(n))
    assert all(s + k <= n for s, k in spans)
    assert all(a[0] + a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_gradient():
    rng = np.random.default_rng(0)
    net = X.Network.fresh({"a": 1}, 1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    gates, length = rng.normal(size=(6, 6 * X.HIDDEN, 3)), np.array([6, 4, 1])
    target = np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.forward(gates, length)
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum()

    keep, grads = {}, {k: np.zeros_like(v) for k, v in net.params.items()}
    d_gates = net.backward(keep, net.forward(gates, length, keep) - target, grads)
    for array, grad in [(gates, d_gates)] + [(net.params[k], grads[k]) for k in ("rec_f", "rec_b", "att", "att_v", "out", "out_bias")]:
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in array.shape)
            old, eps = array[at], 1e-2
            array[at] = old + eps
            up = loss()
            array[at] = old - eps
            slope = (up - loss()) / (2 * eps)
            array[at] = old
            assert abs(slope - grad[at]) < 2e-3 * max(1, abs(slope)), at


@pytest.fixture(scope="module")
def toy():
    rng = random.Random(1)
    words = ["".join(rng.choice("entrhsiou") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for i in range(1500):
        t = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        if i % 3 == 0:
            t[rng.randrange(len(t))] = rng.choice(["gruesome", "Vile!", "xxk" + rng.choice(words)])
        texts.append(" ".join(t))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_learns_and_scores_windows(toy):
    texts, labels = toy
    net = X.train(texts[:1200], labels[:1200])
    scorer = X.Scorer(net)
    found = scorer.score(texts[1200:]) >= X.THRESHOLD
    assert (found == (np.array(labels[1200:]) == 1)).mean() > 0.9
    # whole texts: one toxic word at any place of a long text counts, and chunks change nothing
    clean = " ".join(t for t, y in zip(texts, labels, strict=True) if not y)
    assert scorer.score([clean + " gruesome " + clean])[0] > 0.5
    long = (clean + " ") * (1 + (1 << 20) // len(clean))
    one = max(scorer.score([" ".join(long.split()[s : s + k])])[0] for s, k in X.window_spans(len(long.split()))[:40])
    assert scorer.score([long])[0] >= one - 1e-5
    assert 0 <= scorer.score([""])[0] <= 1


def test_table(spark, toy):
    texts, labels = toy
    docs = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (None, texts[0], "x"), (1, texts[1], "x"), (9999, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score_ string")
    lab = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = X.toxicity(df, lab).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    kept = X.drop_toxic(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(1 - r.predicted for r in got)
    assert X.toxicity(df.limit(0), lab).count() == 0
    assert {r.score for r in X.toxicity(df, lab.limit(0)).collect()} == {0.0}


def test_sample_is_cut_after_the_join(spark, monkeypatch):
    monkeypatch.setattr(X, "TRAIN_DOCS", (30, 10))
    # labels of 4000 ids, every tenth of them at hand, and half of those too long or empty
    docs = [(i, ("", "w " * X.TRAIN_CHARS, f"clean {i}", f"clean {i}")[i // 10 % 4]) for i in range(0, 4000, 10)]
    df = spark.createDataFrame([*docs, (None, "none"), docs[2]], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, i // 40 % 2) for i in range(4000)], "doc_id long, quality int, toxic int")
    texts, classes = X.training_sample(df, lab)
    assert classes == [0] * 30 + [1] * 10 and all(t.startswith("clean") for t in texts)


def test_one_class_drops_nothing(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    for toxic in (0, 1):
        lab = spark.createDataFrame([(i, 1, toxic) for i in range(20)], "doc_id long, quality int, toxic int")
        assert X.fit(df, lab) == float(toxic)
        assert sorted(X.drop_toxic(df, lab).collect()) == sorted(df.collect())


def test_held_out_accuracy(spark):
    from cartlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    scores = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(scores) == spark.read.parquet(f"{sf}/documents.parquet").count()
    test = [(scores[d].predicted, y) for d, y in labels.items() if scores[d].held_out]
    caught = sum(p for p, y in test if y) / sum(y for _, y in test)
    wrong = sum(p for p, y in test if not y) / sum(1 - y for _, y in test)
    assert caught >= 0.85 and wrong <= 0.1


def _plain_score(net, words):
    """One window, word by word, in plain loops and double precision."""
    p = {k: v.astype(np.float64) for k, v in net.params.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    inputs = []
    for w in words:
        parts = [p["words"][net.vocabulary.get(w, 0)]]
        for n in X.ORDERS:
            buckets, weight = X.char_grams([w], n)
            parts.append(sum(weight[0, k] * p[f"chars_{n}"][buckets[0, k]] for k in range(buckets.shape[1])))
        inputs.append(np.concatenate(parts))
    states = []
    for d, order in (("f", inputs), ("b", inputs[::-1])):
        h, own = np.zeros(X.HIDDEN), []
        for x in order:
            gate = x @ p["in_" + d] + p["bias_" + d]
            z, r, n = (gate[k * X.HIDDEN : (k + 1) * X.HIDDEN] for k in range(3))
            uz, ur, un = (p["rec_" + d][k * X.HIDDEN : (k + 1) * X.HIDDEN] @ h for k in range(3))
            z, r = sigmoid(z + uz), sigmoid(r + ur)
            h = (1 - z) * np.tanh(n + r * un) + z * h
            own.append(h)
        states.append(own if d == "f" else own[::-1])
    both = [np.concatenate(s) for s in zip(*states, strict=True)]
    power = [np.exp(p["att_v"] @ np.tanh(p["att"] @ s)) for s in both]
    pooled = sum(a * s for a, s in zip(power, both, strict=True)) / sum(power)
    return sigmoid(p["out"] @ pooled + p["out_bias"][0])


def test_scores_equal_plain_loops(toy):
    texts, labels = toy
    net, rng = X.train(texts[:300], labels[:300], epochs=1), random.Random(2)
    known = " ".join(texts).split()
    samples = ["one", "Vile! word", *(" ".join(rng.choice(known) for _ in range(n)) for n in (5, 31, 32, 33, 57, 100))]
    got = X.Scorer(net).score(samples)
    for text, score in zip(samples, got, strict=True):
        words = [w for part in X.words_of(text) for w in part]
        best = max(_plain_score(net, words[s : s + n]) for s, n in X.window_spans(len(words)))
        assert abs(best - score) < 1e-4, text
