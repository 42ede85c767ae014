"""Frequent itemsets, association rules and the minimum-support sweep.

The original sweep refits FP-growth for 200 minimum supports.  Itemsets are
anti-monotone, so every itemset frequent at a support ``s`` is frequent at
the smallest support of the grid, with the same count.  We therefore mine
**once** at the smallest support and expand each itemset (and each rule,
through the count of its full item set) to the grid levels where
``freq >= ceil(s * n_baskets)`` — the same threshold FP-growth applies.  The
expansion is a per-row ``filter(sequence(..))`` + ``explode``: no join with
the grid, no repeated mining.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.strings import items_to_text
from cartlens.operators.ranking import global_position
from cartlens.session import materialize

# Fixed values of the workload: minimum confidence 0.2; supports
# 0.001, 0.002, ... 0.200 computed as i / 1000.0 for i = 1..200.
MIN_CONFIDENCE = 0.2
SUPPORT_STEPS = 200
SUPPORT_DENOMINATOR = 1000.0
# Row labels and column names of the itemset/rule report.
ITEMSET_LABEL = "FREQUENCIA"
RULE_LABEL = "REGRA"
REPORT_COLUMNS = ("SUPPORT", "TYPE", "ANTECEDENT/ITEMSET", "CONSEQUENT", "CONFIANCA/FREQ")


def support_level(i: int | Column, denominator: float = SUPPORT_DENOMINATOR) -> Column:
    """Support of grid step ``i`` as DOUBLE, computed ``i / denominator``."""
    step = F.lit(i) if isinstance(i, int) else i
    return step.cast("double") / F.lit(denominator)


def min_count(support: Column, n_baskets: Column) -> Column:
    """FP-growth's threshold: ``ceil(support * n)``."""
    return F.ceil(support * n_baskets.cast("double"))


def mine_frequent_itemsets(
    baskets: DataFrame,
    min_support: float,
    min_confidence: float = MIN_CONFIDENCE,
    num_partitions: int | None = None,
    items_col: str = "items",
) -> FPGrowthModel:
    """Fit parallel FP-growth.  ``items`` must hold distinct values per basket
    (see :func:`cartlens.functions.parse_basket_line`)."""
    fp = FPGrowth(itemsCol=items_col, minSupport=min_support, minConfidence=min_confidence)
    if num_partitions:
        fp.setNumPartitions(num_partitions)
    return fp.fit(baskets.select(items_col))


def frequent_itemsets(model: FPGrowthModel) -> DataFrame:
    """``(items ARRAY<STRING> sorted, freq BIGINT, size INT)``."""
    return model.freqItemsets.select(
        F.array_sort("items").alias("items"), F.col("freq").cast("bigint").alias("freq"), F.size("items").alias("size")
    )


def association_rules(model: FPGrowthModel, n_baskets: Column) -> DataFrame:
    """``(antecedent, consequent, confidence, lift, freq)``; ``freq`` is the count
    of antecedent ∪ consequent, recovered exactly from the rule support."""
    return model.associationRules.select(
        F.array_sort("antecedent").alias("antecedent"),
        F.array_sort("consequent").alias("consequent"),
        F.col("confidence").cast("double").alias("confidence"),
        F.col("lift").cast("double").alias("lift"),
        F.round(F.col("support") * n_baskets.cast("double")).cast("bigint").alias("freq"),
    )


def rules_from_itemsets(itemsets: DataFrame, n_baskets: Column, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Association rules with a one-item consequent, derived from frequent
    itemsets with DataFrame operations (same definition as Spark ML):
    ``confidence = freq(S) / freq(S - {y})``, ``lift = confidence / support({y})``.

    Works on a checkpointed itemset table, so the mining is never redone.
    Output ``(antecedent, consequent, confidence, lift, freq)``; ``freq`` is
    the count of the full item set.
    """
    cand = itemsets.where(F.col("size") >= 2).select("items", "freq", F.explode("items").alias("__y"))
    cand = cand.select(
        F.array_remove("items", F.col("__y")).alias("antecedent"), F.col("__y"), F.col("freq")
    )
    ante = itemsets.select(F.col("items").alias("antecedent"), F.col("freq").alias("__af"))
    single = itemsets.where(F.col("size") == 1).select(F.col("items")[0].alias("__y"), F.col("freq").alias("__yf"))
    rules = (
        cand.join(ante, "antecedent")
        .withColumn("confidence", F.col("freq").cast("double") / F.col("__af").cast("double"))
        .where(F.col("confidence") >= F.lit(min_confidence))
        .join(single, "__y")
    )
    return rules.select(
        "antecedent",
        F.array(F.col("__y")).alias("consequent"),
        "confidence",
        (F.col("confidence") / (F.col("__yf").cast("double") / n_baskets.cast("double"))).alias("lift"),
        F.col("freq").cast("bigint").alias("freq"),
    )


def mine_once(
    baskets: DataFrame,
    min_support: float,
    num_partitions: int | None = None,
    items_col: str = "items",
) -> tuple[DataFrame, int]:
    """Mine frequent itemsets once and freeze them.

    Spark ML keeps the itemsets of a fitted model lazy over the training
    input, which it unpersists after ``fit`` — every later use would mine
    again from the source tables.  Here the baskets stay persisted for the
    fit and the itemsets are checkpointed before they are released.
    Returns ``(itemsets, n_baskets)``.
    """
    data = baskets.select(items_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = data.count()
        model = mine_frequent_itemsets(data, min_support, num_partitions=num_partitions, items_col=items_col)
        itemsets = materialize(frequent_itemsets(model))
    finally:
        data.unpersist()
    return itemsets, n


def itemsets_by_freq(itemsets: DataFrame) -> DataFrame:
    """Most frequent first, ties by the item text: the place of each itemset in that
    order as ``position`` (0-based), from a distributed sort."""
    named = itemsets.select(items_to_text("items").alias("items_text"), "freq", "size")
    return global_position(named, [F.col("freq").desc(), F.col("items_text").asc()], pos_col="position")


def rules_by_confidence(rules: DataFrame) -> DataFrame:
    """Most confident first, ties by antecedent then consequent text, as ``position``."""
    named = rules.select(items_to_text("antecedent").alias("antecedent_text"), items_to_text("consequent").alias("consequent_text"), "freq", "confidence")
    order = [F.col("confidence").desc(), F.col("antecedent_text").asc(), F.col("consequent_text").asc()]
    return global_position(named, order, pos_col="position")


def _levels(freq: Column, n_baskets: Column, steps: int, denominator: float) -> Column:
    """Grid steps whose threshold ``freq`` reaches.  Thresholds only rise, so these
    are 1 up to a highest step: the one that the share gives, or a neighbour of it
    (division and ceiling are rounded), which the exact rule decides."""
    guess = F.floor(freq * F.lit(denominator) / n_baskets).cast("int")
    near = [F.greatest(F.least(guess + d, F.lit(steps)), F.lit(0)) for d in (1, 0, -1)]
    reaches = lambda i: min_count(support_level(i, denominator), n_baskets) <= freq
    top = F.when(reaches(near[0]), near[0]).when(reaches(near[1]), near[1]).otherwise(near[2])
    return F.when(top >= 1, F.sequence(F.lit(1), F.greatest(top, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def support_sweep(
    itemsets: DataFrame,
    rules: DataFrame,
    n_baskets: Column,
    steps: int = SUPPORT_STEPS,
    denominator: float = SUPPORT_DENOMINATOR,
) -> tuple[DataFrame, DataFrame]:
    """Itemsets and rules of every grid support, each with a ``support`` column.

    ``n_baskets`` may be a scalar sub-query; it is projected as a column
    first because lambdas cannot hold sub-queries."""

    def expand(df: DataFrame) -> DataFrame:
        cols = df.columns
        withn = df.withColumn("__n", n_baskets)
        levels = _levels(F.col("freq"), F.col("__n"), steps, denominator)
        return withn.select(*cols, F.explode(levels).alias("__s")).select(
            *cols, support_level(F.col("__s"), denominator).alias("support")
        )

    return expand(itemsets), expand(rules)


def rules_report(swept_itemsets: DataFrame, swept_rules: DataFrame) -> DataFrame:
    """Itemset and rule rows in one typed frame:
    ``(support, type, antecedent_itemset, consequent, freq, confidence)``."""
    a = swept_itemsets.select(
        "support",
        F.lit(ITEMSET_LABEL).alias("type"),
        items_to_text("items").alias("antecedent_itemset"),
        F.lit("").alias("consequent"),
        "freq",
        F.lit(None).cast("double").alias("confidence"),
    )
    b = swept_rules.select(
        "support",
        F.lit(RULE_LABEL).alias("type"),
        items_to_text("antecedent").alias("antecedent_itemset"),
        items_to_text("consequent").alias("consequent"),
        "freq",
        "confidence",
    )
    return a.unionByName(b)


def report_strings(report: DataFrame) -> DataFrame:
    """Five text columns for the delimited sink: the frequency for itemset
    rows, the confidence for rule rows."""
    support, kind, antecedent, consequent, value = REPORT_COLUMNS
    return report.select(
        F.col("support").cast("string").alias(support),
        F.col("type").alias(kind),
        F.col("antecedent_itemset").alias(antecedent),
        F.col("consequent").alias(consequent),
        F.when(F.col("type") == ITEMSET_LABEL, F.col("freq").cast("string"))
        .otherwise(F.col("confidence").cast("string"))
        .alias(value),
    )


def mine_support_sweep(
    baskets: DataFrame,
    steps: int = SUPPORT_STEPS,
    denominator: float = SUPPORT_DENOMINATOR,
    min_confidence: float = MIN_CONFIDENCE,
    num_partitions: int | None = None,
) -> DataFrame:
    """One FP-growth pass at the smallest grid support, expanded over the grid."""
    itemsets, n = mine_once(baskets, 1.0 / denominator, num_partitions)
    rules = rules_from_itemsets(itemsets, F.lit(n), min_confidence)
    swept_items, swept_rules = support_sweep(itemsets, rules, F.lit(n), steps, denominator)
    return rules_report(swept_items, swept_rules)
