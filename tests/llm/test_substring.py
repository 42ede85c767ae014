import random
import re

import numpy as np

from cartlens.llm import substring as X


def plain_sentences(text):
    """Each sentence as (start, words, parts); parts are (start, words)."""
    out = []
    for m in re.finditer(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", text):
        words = [(m.start() + w.start(), w[0]) for w in re.finditer(r"[^ \t\n\x0b\x0c\r]+", m[0])]
        if not words:
            continue
        raw = [w.encode() for _, w in words]
        rank = [int(X.ranks(w, np.array([0]), np.array([len(w)]))[0]) >> 8 for w in raw]
        cuts = {0}
        for i in range(len(words) - X.WINDOW):
            window = rank[i : i + X.WINDOW]
            cuts.add(i + window.index(min(window)) + 1)
        cuts = [*sorted(cuts), len(words)]
        out.append((words[0][0], [(words[a][0], [w for _, w in words[a:b]]) for a, b in zip(cuts, cuts[1:])]))
    return out


def slow(rows):
    """(doc_id, text) rows in table order to (id, clean text, sentences, sentences touched)."""
    seen, marks, cut = {}, [set() for _ in rows], [plain_sentences(t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for r in order:
        parts = [p for _, ps in cut[r] for p in ps]
        opens = [0]
        for _, ps in cut[r]:
            opens.append(opens[-1] + len(ps))
        found = {(opens[k], opens[k + X.RUN]) for k in range(len(cut[r]) - X.RUN + 1)}
        for i in range(len(parts)):
            for j in range(i + X.RUN, len(parts) + 1):
                if sum(len(w) for _, w in parts[i:j]) >= X.MIN_WORDS:
                    found.add((i, j))
                    break
        for i, j in sorted(found):
            key = tuple(tuple(w) for _, w in parts[i:j])
            if seen.setdefault(key, (r, i)) != (r, i):
                marks[r] |= set(range(i, j))
    out = []
    for (d, t), sentences, gone in zip(rows, cut, marks, strict=True):
        t = t or ""
        parts = [p for _, ps in sentences for p in ps]
        ends = [*(a for a, _ in parts[1:]), len(t)][: len(parts)]
        kept = t[: parts[0][0]] if parts else t
        kept += "".join(t[a:b] for k, ((a, _), b) in enumerate(zip(parts, ends, strict=True)) if k not in gone)
        touched, k = 0, 0
        for _, ps in sentences:
            touched += any(i in gone for i in range(k, k + len(ps)))
            k += len(ps)
        out.append((d, kept, len(sentences), touched))
    return out


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("entrhsiou") for _ in range(rng.randint(1, 6)))
    sentence = lambda: " ".join(word() for _ in range(rng.choice([1, 2, 5, 9, 20, 40]))) + rng.choice([".", "!", "\n", "...\n\n", ". "])
    passages = ["".join(sentence() for _ in range(rng.randint(3, 8))) for _ in range(6)]
    rows = []
    for i in range(60):
        t = "".join(sentence() if rng.random() < 0.7 else rng.choice(passages) for _ in range(rng.randint(0, 9)))
        rows.append((rng.choice([i, i, None]), t))
    rows += [(900, passages[0] * 2), (901, ""), (902, None), (903, " \n "), (904, "The. Of."), (905, "The. Of."), rows[3], rows[3]]
    return rows


def test_parts_of_a_sentence():
    for _, t in make(5):
        words = X.words_of([(t or "").encode()])
        begins = X.part_starts(words)
        assert (begins | ~words.opens).all()
        sizes = np.diff([*np.flatnonzero(begins), len(begins)])
        assert not sizes.size or sizes.max() <= X.WINDOW


def test_equals_brute_force(spark):
    rows = make(1)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, marks string").coalesce(1)
    got = [(r.doc_id, r.clean_text, r.n_sentences, r.n_removed) for r in X.remove_repeats(df).collect()]
    want = slow(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[3] for w in want) > 50
    assert X.remove_repeats(df.limit(0)).count() == 0


def test_long_passages_are_caught(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("entrhsiou") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + ". "
    passage = " ".join(word() for _ in range(55)) + "."  # one sentence
    docs = [(i, prose(20) + (passage + " " if i in (3, 7) else "") + prose(30)) for i in range(10)]
    got = {r.doc_id: r for r in X.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert passage not in got[7].clean_text and got[7].n_removed >= 1
    assert all(got[i].clean_text == t for i, t in docs if i != 7)
    # in the middle of a sentence the cuts fall into step again
    words = " ".join(word() for _ in range(70))
    docs = [(i, " ".join([prose(9 + 4 * i)[:-2], words, prose(12)])) for i in range(4)]
    got = {r.doc_id: r for r in X.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0].clean_text == docs[0][1]
    assert all(len(docs[i][1]) - len(got[i].clean_text) > 0.5 * len(words) for i in (1, 2, 3))


def test_passages_that_begin_inside_a_sentence():
    for seed in range(400):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice("entrhsiou") for _ in range(rng.randint(3, 8)))

        def prose(n, least, most):  # without any stop at either end
            out, left = [], rng.randint(least, most) if least else n + 1
            for k in range(n):
                left -= 1
                out.append(word() + ("." if left == 0 and k < n - 1 else ""))
                left = left or rng.randint(least, most)
            return " ".join(out)

        for least, most in ((0, 0), (8, 18), (1, 6), (21, 40)):
            passage = prose(51, least, most)
            a, b = (" ".join([prose(rng.randint(1, 40), least, most), passage, prose(rng.randint(1, 40), least, most)]) for _ in range(2))
            if rng.random() < 0.3:
                b = passage if rng.random() < 0.5 else prose(9, least, most) + ". " + passage + ". " + prose(9, least, most)
            known, start = set(X.spans([a.encode()]).h1.tolist()), b.index(passage)
            found = X.spans([b.encode()])
            gone = {c for h, i, j in zip(found.h1.tolist(), found.first.tolist(), found.until.tolist(), strict=True) if h in known for c in range(i, j)}
            common = sum(start <= m.start() < start + len(passage) and m.start() in gone for m in re.finditer(r"\S+", b))
            assert common >= 28, (seed, least, common)


def test_query(spark):
    from cartlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = [(r.doc_id, r.clean_text, r.n_sentences, r.n_removed) for r in QUERIES["op10_substring_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted(slow(rows))


def test_short_sentences_count_as_dealt(spark):
    """Three repeated sentences go whatever their length; two don't."""
    rows = [(1, "Yes it is. No. So be it. Ends here"), (2, "Well. Yes it is. No.\tSo  be it. Other."), (3, "Yes it is. No. But.")]
    got = {r.doc_id: (r.clean_text, r.n_sentences, r.n_removed, [tuple(x) for x in r.removed]) for r in X.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 4, 0, []), 2: ("Well. Other.", 5, 3, [(6, 32)]), 3: (rows[2][1], 3, 0, [])}


def test_very_long_and_odd_texts(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["ab", "c", "çé", "日本", "e."]) + str(rng.randrange(50)) for _ in range(60_000))
    rows = [(1, long), (2, "é\u00a0x. " * 40), (3, "…\x1c\x85 ...!?\n\n a"), (4, long[: len(long) // 2]), (None, "..."), (5, "." * 50)]
    got = [(r.doc_id, r.clean_text, r.n_sentences, r.n_removed) for r in X.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    assert sorted(got, key=str) == sorted(slow(rows), key=str)


def test_rows_that_a_shuffle_deals_out(spark):
    """Rows are numbered once, so a shuffled input gives every text its own marks."""
    rows = make(9)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    want = sorted(tuple(r) for r in X.remove_repeats(df.coalesce(1)).collect())
    assert sorted(tuple(r) for r in X.remove_repeats(df.repartition(7)).collect()) == want
