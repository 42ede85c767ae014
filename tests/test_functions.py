from pyspark.sql import functions as F

from cartlens.functions import f1_from_means, jvm_split, jvm_string_hash, jvm_trim, parse_basket_line, safe_ratio


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first()["r"]


def test_jvm_hash_golden(spark):
    assert _one(spark, jvm_string_hash, "Aa") == 2112
    assert _one(spark, jvm_string_hash, "BB") == 2112
    assert _one(spark, jvm_string_hash, "ABC-12345678") == -413191761
    assert _one(spark, jvm_string_hash, "") == 0


def test_jvm_hash_matches_python_model(spark):
    def model(s: str) -> int:
        h = 0
        data = s.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = (31 * h + int.from_bytes(data[i : i + 2], "big")) & 0xFFFFFFFF
        return h - (1 << 32) if h >= (1 << 31) else h

    samples = ["hello", "Brand#17", "peça", "ação 123", "x" * 40, "emoji \U0001F600 here", "\t tab"]
    df = spark.createDataFrame([(s,) for s in samples], "s string").select("s", jvm_string_hash("s").alias("h"))
    for row in df.collect():
        assert row["h"] == model(row["s"]), row["s"]


def test_basket_parse_golden(spark):
    assert _one(spark, parse_basket_line, " a|b|a|| ") == ["a", "b"]
    assert _one(spark, parse_basket_line, "a||b") == ["a", "", "b"]
    assert _one(spark, parse_basket_line, "single") == ["single"]
    assert _one(spark, parse_basket_line, "") == [""]
    assert _one(spark, parse_basket_line, "||") == []
    assert _one(spark, parse_basket_line, "|a") == ["", "a"]


def test_jvm_trim_and_split(spark):
    assert _one(spark, jvm_trim, "\t\n a b \x01") == "a b"
    assert _one(spark, lambda c: jvm_split(c, ";"), "1;x;;") == ["1", "x"]
    assert _one(spark, lambda c: jvm_split(c, "|"), "a|b") == ["a", "b"]


def test_ratios(spark):
    row = spark.createDataFrame([(2, 4, 0)], "a int, b int, z int").select(
        safe_ratio(F.col("a"), F.col("b")).alias("r"),
        safe_ratio(F.col("a"), F.col("z")).alias("nz"),
    ).first()
    assert row["r"] == 0.5 and row["nz"] is None
    f1 = spark.createDataFrame([(0.25, 0.125), (0.0, 0.0)], "p double, r double").select(
        f1_from_means(F.col("p"), F.col("r")).alias("f1")
    ).collect()
    assert abs(f1[0]["f1"] - 1 / 6) < 1e-12
    assert f1[1]["f1"] is None


# ---- property tests against a plain-Python model of the JVM behaviour

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


def _java_trim(s: str) -> str:
    i, j = 0, len(s)
    while i < j and ord(s[i]) <= 0x20:
        i += 1
    while j > i and ord(s[j - 1]) <= 0x20:
        j -= 1
    return s[i:j]


def _java_split(s: str, d: str) -> list[str]:
    if d not in s:
        return [s]
    parts = s.split(d)
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def _java_hash(s: str) -> int:
    h = 0
    data = s.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(data), 2):
        h = (31 * h + int.from_bytes(data[i : i + 2], "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >= (1 << 31) else h


def _distinct(xs):
    seen, out = set(), []
    for x in xs:
        if x not in seen:
            seen.add(x)
            out.append(x)
    return out


_line = st.lists(st.sampled_from(["a", "b", "ab", "", " ", "\t", "|", "x y", "ç"]), max_size=12).map("".join)
_text = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=24)


@settings(max_examples=10, deadline=None)
@given(st.lists(_line, min_size=1, max_size=30))
def test_parse_basket_line_matches_jvm_model(spark, lines):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string")
    got = {r["i"]: r["p"] for r in df.select("i", parse_basket_line(F.col("s")).alias("p")).collect()}
    for i, s in enumerate(lines):
        assert got[i] == _distinct(_java_split(_java_trim(s), "|")), repr(s)


@settings(max_examples=10, deadline=None)
@given(st.lists(_text, min_size=1, max_size=30))
def test_jvm_hash_matches_model_on_unicode(spark, texts):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = {r["i"]: r["h"] for r in df.select("i", jvm_string_hash("s").alias("h")).collect()}
    for i, s in enumerate(texts):
        assert got[i] == _java_hash(s), repr(s)
