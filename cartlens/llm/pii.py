"""Personal data by weak supervision (operator 6), DataFrame operations only.

*Candidates*: matches of a rule for each kind (email, ip, card, phone), valid or
not, and of looser patterns in what the rules leave over.  *Labelers*: six of them
(rule, gazetteer, checksum, two of context, boundary) vote 1, -1 or 0 on each
candidate.  *EM*: candidates are counted by their votes, which gives at most
4 x 3^6 rows whatever the size of the corpus; expectation-maximisation estimates
from these counts how often each labeler gives each vote on true and on false
spans, each pass one aggregate whose sums are all that reaches the driver.
*Classifier*: a logistic regression (Spark ML) learns the posterior from votes and
shape, again on counts, and its weights are applied as one expression.  Valid rule
matches always stay; other candidates are added where the classifier accepts them.

Rule patterns are written so that Java's engine reads a text in linear time: a
match begins where a run of its characters begins (or where the last match ended)
and runs are taken possessively, which changes no match.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.common import row_ids, stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the rules: (kind, regular expression).
RULES = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"),
    ("card", r"[0-9](?:[\x20-]?+[0-9]){12,}+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: Looser patterns, tried on what the rules leave over.
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])"),
)
#: Gazetteers: top-level domains, first digits of card issuers, country calling codes.
DOMAINS = "com org net edu gov info biz io dev app de fr es it nl pl pt se no fi dk at ch be uk us ca eu example".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
#: Words that speak for a kind when they stand before a candidate, and against any.
CONTEXT = {
    "email": r"mail|contact|write|kontakt|schreib|correo|courriel|adress",
    "ip": r"\bip\b|host|server|ping|address|login|serveur|servidor",
    "card": r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|\bpay",
    "phone": r"call|phone|\btel|fax|mobil|ruf|appel|llam",
}
AGAINST = r"token|\bkey\b|hash|isbn|\bsku\b|version|\brev\b|order|serial|[=#\"]\s*$"
LABELERS = ("rule", "gazetteer", "checksum", "context", "against", "boundary")
BEFORE, AFTER = 24, 8
EM_ROUNDS = 15
_SHAPES = ("short", "long", "parted", "loose")


def _matches(text: str, kind: str, pattern: str, loose: bool) -> Column:
    """Array of the pattern's matches in a column, with the distance from the match
    before and what stands around."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found, between = f"regexp_extract_all({text}, '{p}', 0)", f"split({text}, '{p}', -1)"
    each = (
        f"transform({found}, (m, i) -> named_struct('kind', '{kind}', 'loose', {str(loose).lower()}, 'i', i, 'body', m,"
        f" 'gap', char_length(pieces[i]), 'before', right(pieces[i], {BEFORE}), 'after', left(pieces[i + 1], {AFTER})))"
    )
    # the pieces between the matches are computed once, as the argument of the outer transform
    return F.expr(f"flatten(transform(array({between}), pieces -> {each}))")


def _masked(text: Column, pattern: str) -> Column:
    """The text with each match overwritten, at the same length."""
    gaps = F.split(text, pattern, -1)
    fill = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit("\x01"), F.char_length(m)))
    return F.array_join(F.zip_with(gaps, fill, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda a, b: a + b) % 10 == 0


def _places(rows: DataFrame) -> DataFrame:
    """All matches of all patterns in ``rows(row_, text)``, with start and end in
    code points."""
    holding = rows.where(F.col("text").rlike("[0-9@]|at[)\\]]"))
    texts = holding.select("row_", "text", F.col("text").alias("masked"))
    for _, pattern in RULES:
        texts = texts.withColumn("masked", _masked(F.col("masked"), pattern))
    arrays = [_matches("text", k, p, False) for k, p in RULES] + [_matches("masked", k, p, True) for k, p in LOOSE]
    found = texts.select("row_", F.explode(F.concat(*arrays)).alias("m")).select("row_", "m.*")
    upto = Window.partitionBy("row_", "kind", "loose").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("body")
    end = F.sum(F.col("gap").cast("long") + size).over(upto)
    return found.withColumn("end", end).withColumn("start", F.col("end") - size).drop("i", "gap")


def _judged(found: DataFrame) -> DataFrame:
    """Matches with ``base`` (valid by the rules), the labelers' votes and shape flags."""
    digits = F.regexp_replace("body", "[^0-9]", "")
    df = found.withColumn("digits", digits).withColumn("n", F.length("digits"))
    kind, n = F.col("kind"), F.col("n")
    parts = F.transform(F.split("body", "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    countable = (kind == "card") & n.between(13, 19)
    sized = F.when(countable, _luhn(F.when(countable, F.col("digits")).otherwise("0")))
    valid = (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", F.coalesce(sized, F.lit(False)))
        .otherwise(n.between(9, 15))
    )
    df = df.withColumn("base", ~F.col("loose") & valid)
    yes = lambda c: F.when(c, 1).otherwise(-1)
    code = F.array(*[F.lit(c) for c in CALLING_CODES])
    gazetteer = (
        F.when(kind == "email", yes(F.lower(F.regexp_extract("body", "([A-Za-z0-9-]+)$", 1)).isin(DOMAINS)))
        .when(kind == "ip", yes(F.regexp_extract("body", "^0*([0-9]*)", 1).rlike("^([1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])$")))
        .when(kind == "card", yes(F.col("digits").rlike("^[3-6]")))
        .when(F.col("loose"), yes(F.col("digits").rlike("^[2-9]")))
        .otherwise(yes(F.exists(code, lambda c: F.startswith(F.col("digits"), c))))
    )
    checksum = (
        F.when(kind == "card", yes(F.coalesce(sized, F.lit(False))))
        .when((kind == "phone") & F.col("digits").rlike("^([0-9])\\1*$"), -1)
        .when((kind == "ip") & F.col("body").rlike("(^|\\.)0[0-9]"), -1)
        .otherwise(0)
    )
    near = F.lower("before")
    speaks = F.lit(False)
    for name, words in CONTEXT.items():
        speaks = speaks | ((kind == name) & near.rlike(words))
    votes = {
        "rule": F.when(F.col("base"), 1).when(F.col("loose"), 0).otherwise(-1),
        "gazetteer": gazetteer,
        "checksum": checksum,
        "context": F.when(speaks, 1).otherwise(0),
        "against": F.when(near.rlike(AGAINST), -1).otherwise(0),
        "boundary": yes(~F.col("before").rlike("[\\p{L}0-9_]$") & ~F.col("after").rlike("^[\\p{L}0-9_]")),
    }
    shapes = {"short": n < 10, "long": n > 16, "parted": F.col("body").rlike("[ ()-]"), "loose": F.col("loose")}
    return df.select("row_", "kind", "start", "end", "base", *[v.cast("int").alias(f"v_{k}") for k, v in votes.items()], *[v.cast("int").alias(f"s_{k}") for k, v in shapes.items()])


# -- learning -------------------------------------------------------------------


#: Places of a model's parameters: the prior log odds of each kind, then the log odds
#: that each vote (-1, 0, 1) of each labeler gives.
PARAMETERS = [("prior", kind) for kind in KINDS] + [(name, vote) for name in LABELERS for vote in (-1, 0, 1)]


def _posterior(model: list[float]) -> Column:
    """Probability that a row of counts or candidates is a true span.  The model is
    one array literal, so every round of EM runs the same generated code."""
    values = F.lit(model)
    odds = F.element_at(values, F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int"))
    for j, name in enumerate(LABELERS):
        odds = odds + F.element_at(values, F.col(f"v_{name}") + F.lit(len(KINDS) + 3 * j + 2))
    return 1 / (1 + F.exp(-odds))


def _reestimated(counts: DataFrame, posterior: Column) -> list[float]:
    """The M step, from the weights of true and false spans in each parameter's rows."""
    weighted = counts.select("*", (F.col("n") * posterior).alias("t")).withColumn("f", F.col("n") - F.col("t"))
    asked = []
    for name, value in PARAMETERS:
        holds = F.col("kind") == value if name == "prior" else F.col(f"v_{name}") == value
        asked += [F.sum(F.when(holds, F.col(side)).otherwise(0.0)) for side in ("t", "f")]
    row = weighted.agg(*[c.alias(f"c{i}") for i, c in enumerate(asked)]).first()
    true, false = ([1 + (row[2 * i + side] or 0.0) for i in range(len(PARAMETERS))] for side in (0, 1))
    model = [math.log(true[i] / false[i]) for i in range(len(KINDS))]
    for at in range(len(KINDS), len(PARAMETERS), 3):
        t, f = sum(true[at : at + 3]), sum(false[at : at + 3])
        model += [math.log(true[i] / t) - math.log(false[i] / f) for i in range(at, at + 3)]
    return model


def estimate_reliabilities(counts: DataFrame, rounds: int = EM_ROUNDS) -> dict[tuple, float]:
    """EM over vote counts, from the labelers' majority: log odds by parameter."""
    model = [0.0] * len(KINDS) + [float(vote) for _ in LABELERS for vote in (-1, 0, 1)]
    for _ in range(rounds):
        model = _reestimated(counts, _posterior(model))
    return dict(zip(PARAMETERS, model, strict=True))


def _features() -> dict[str, Column]:
    found = {f"k_{kind}": F.col("kind") == kind for kind in KINDS}
    for name in LABELERS:
        found |= {f"y_{name}": F.col(f"v_{name}") == 1, f"n_{name}": F.col(f"v_{name}") == -1}
    return found | {f"f_{s}": F.col(f"s_{s}") == 1 for s in _SHAPES}


def train_classifier(counts: DataFrame, model: dict[tuple, float]) -> Column | None:
    """Acceptance of a candidate, as an expression over its votes and shape; None
    where there is nothing to learn from."""
    posterior, columns = _posterior([model[p] for p in PARAMETERS]), _features()
    sides = [counts.select(F.lit(float(y)).alias("y"), (F.col("n") * p).alias("w"), *[c.cast("double").alias(k) for k, c in columns.items()]) for y, p in ((1, posterior), (0, 1 - posterior))]
    rows = VectorAssembler(inputCols=list(columns), outputCol="x").transform(sides[0].union(sides[1]).where("w > 0")).select("x", "y", "w")
    if rows.isEmpty():
        return None
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-3, maxIter=30).fit(rows)
    odds = F.lit(float(fitted.intercept))
    for weight, c in zip(fitted.coefficients.toArray().tolist(), columns.values(), strict=True):
        odds = odds + F.when(c, weight).otherwise(0.0)
    return odds >= 0


def find_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as ``(row_, doc_id)`` and their spans ``(row_, kind,
    start, end, base)``: offsets in code points, end exclusive; ``base`` for valid
    rule matches, the others are those that the classifier accepts.

    Null and empty texts have no spans; rows with null or repeated ids are kept
    apart by ``row_``; an empty table gives empty ones; other columns don't matter.
    """
    rows = row_ids(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text")), "row_")
    found = stored(_judged(_places(rows.select("row_", "text"))))
    shape = ["kind", *[f"v_{n}" for n in LABELERS], *[f"s_{s}" for s in _SHAPES]]
    counts = stored(found.groupBy(*shape).agg(F.count(F.lit(1)).alias("n")))
    accepted = train_classifier(counts, estimate_reliabilities(counts))
    kept = F.col("base") if accepted is None else F.col("base") | accepted
    return rows.select("row_", "doc_id"), found.where(kept).select("row_", "kind", "start", "end", "base")


def span_summary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, counts of valid rule matches by
    kind, ``base_spans`` and ``spans`` (``kind:start:end``, by kind, then start)."""
    rows, spans = find_spans(docs, text, doc_id)
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    item = F.struct(order.alias("o"), "start", "end", "kind")
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    by_row = spans.groupBy("row_").agg(*counts, listed(F.collect_list(F.when(F.col("base"), item))).alias("base_spans"), listed(F.collect_list(item)).alias("spans"))
    out = rows.join(by_row, "row_", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")])
