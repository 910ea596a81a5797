"""Frequent itemsets and association rules."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage, keep


def frequent_itemsets(
    transactions: DataFrame, items: str, min_support: float, n: int | None = None, alg: str = "fpgrowth"
) -> DataFrame:
    """(itemset sorted, freq, support) of all itemsets in at least ``min_support`` of the rows.

    Any ``alg`` but ``fpgrowth`` mines level by level (:func:`apriori`).
    """
    if alg != "fpgrowth":
        return apriori(transactions, items, min_support)
    n = transactions.count() if n is None else n
    found = FPGrowth(itemsCol=items, minSupport=min_support).fit(transactions).freqItemsets
    return found.select(
        F.sort_array("items").alias("itemset"), "freq", (F.col("freq") / F.lit(float(max(n, 1)))).alias("support")
    )


def support_schedule(start: float, factor: float = 0.9, floor: float = 0.01) -> list[float]:
    """The thresholds tried in turn: lowered before each attempt, while above the floor."""
    out, s = [], start
    while s > floor:
        s = s * factor
        out.append(s)
    return out


def frequent_itemsets_decreasing(
    transactions: DataFrame, items: str, start: float = 0.35, min_patterns: int = 30, alg: str = "fpgrowth"
) -> tuple[DataFrame, float | None]:
    """Itemsets at the first threshold of the schedule that yields enough of them.

    Mines at positions 0, 1, 3, 7, ... of the schedule and reads the exact
    threshold off the last result: a handful of passes instead of one per
    threshold, and never far below the support that is needed.
    """
    schedule = support_schedule(start)
    if not schedule:
        return frequent_itemsets(transactions, items, 1.0).limit(0), None
    baskets = keep(transactions.select(items))
    n = baskets.count()
    previous, position = -1, 0
    while True:
        mined = keep(frequent_itemsets(baskets, items, schedule[position], n, alg))
        steps = range(previous + 1, position + 1)
        row = mined.agg(
            *[F.count_if(F.col("freq") >= math.ceil(schedule[j] * n)).alias(f"s{j}") for j in steps]
        ).first()
        enough = [j for j in steps if row[f"s{j}"] >= min_patterns]
        if enough or position == len(schedule) - 1:
            hit = enough[0] if enough else position
            return mined.where(F.col("freq") >= math.ceil(schedule[hit] * n)), schedule[hit]
        previous, position = position, min(2 * position + 1, len(schedule) - 1)


def _singles(transactions: DataFrame, items: str) -> tuple[DataFrame, int]:
    """(itemset, bucket, bits) of each item, a bitmap per 32,768 transactions, and the number of transactions."""
    # the numbers are made once: a lost task may not deal them out anew
    numbered = cut_lineage(transactions.select(F.monotonically_increasing_id().alias("tid"), F.col(items).alias("items")))
    held = numbered.select(
        F.bitmap_bucket_number("tid").alias("bucket"), F.bitmap_bit_position("tid").alias("bit"),
        F.explode(F.array_distinct("items")).alias("item"),
    )
    bits = held.where(F.col("item").isNotNull()).groupBy(F.array("item").alias("itemset"), "bucket")
    return bits.agg(F.bitmap_construct_agg("bit").alias("bits")), numbered.count()


def _candidates(frequent: DataFrame, size: int) -> DataFrame:
    """(candidate, itemset): sets of ``size`` items whose subsets are all frequent, beside each of the two they are joined from."""
    parts = frequent.select("itemset", F.slice("itemset", 1, size - 2).alias("prefix"), F.element_at("itemset", -1).alias("last"))
    b = parts.select("prefix", F.col("itemset").alias("other"), F.col("last").alias("next"))
    joined = parts.join(b, "prefix").where(F.col("last") < F.col("next"))
    joined = joined.select(F.concat("itemset", F.array("next")).alias("candidate"), F.array("itemset", "other").alias("parents"))
    if size > 2:
        # the parents lack the last and the last but one item
        subsets = F.transform(F.sequence(F.lit(0), F.lit(size - 3)), lambda i: F.filter("candidate", lambda x, j: j != i))
        whole = (
            joined.select("candidate", F.explode(subsets).alias("itemset"))
            .join(frequent, "itemset", "left_semi")
            .groupBy("candidate")
            .agg(F.count(F.lit(1)).alias("met"))
            .where(F.col("met") == size - 2)
        )
        joined = joined.join(whole, "candidate", "left_semi")
    return joined.select("candidate", F.explode("parents").alias("itemset"))


def apriori(transactions: DataFrame, items: str, min_support: float) -> DataFrame:
    """(itemset sorted, freq, support) as of :func:`frequent_itemsets`, mined level by level.

    Candidates of a level join frequent sets that share all but the last item; one
    with an infrequent subset goes.  Their transactions are the common bits of the
    two sets they come from, so the transactions are read once.
    """
    bits, n = _singles(transactions, items)
    least = math.ceil(min_support * n)
    found = None
    size = 1
    while True:
        bits = cut_lineage(bits)
        counts = bits.groupBy("itemset").agg(F.sum(F.bitmap_count("bits")).alias("freq"))
        frequent = cut_lineage(counts.where(F.col("freq") >= least))
        found = frequent if found is None else found.unionByName(frequent)
        size += 1
        candidates = _candidates(frequent.select("itemset"), size)
        if frequent.limit(2).count() < 2:
            break
        both = candidates.join(bits, "itemset").groupBy("candidate", "bucket")
        met = both.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("parents")).where("parents = 2")
        bits = met.where(F.bitmap_count("bits") > 0).select(F.col("candidate").alias("itemset"), "bucket", "bits")
    return found.select("itemset", "freq", (F.col("freq") / F.lit(float(max(n, 1)))).alias("support"))


def _least_confidence(metric: str, threshold: float) -> Column:
    """What a rule's confidence has to be at least if it, or one with more of the itemset behind it, is to meet the metric.

    The confidence falls as the consequent grows, and the consequent's support stays
    above the itemset's.
    """
    own = F.col("support")
    if metric == "confidence":
        return F.lit(threshold)
    if metric == "lift":
        return F.lit(threshold) * own
    if metric == "leverage":
        return F.when(own > threshold, own * own / (own - F.lit(threshold))).otherwise(F.lit(math.inf))
    if metric == "conviction" and threshold > 0:
        return F.lit(1.0) - (F.lit(1.0) - own) / F.lit(threshold)
    return F.lit(0.0)


def association_rules(
    itemsets: DataFrame, metric: str = "confidence", min_conf: float = 0.9, min_lift: float = 1.2
) -> DataFrame:
    """Every split of every itemset into antecedent and consequent that meets the metric.

    The threshold is ``min_conf`` for confidence and ``min_lift`` for every other metric.  With
    each itemset the table holds its subsets, as mined tables do.  Consequents
    grow by one item a level, from those whose confidence can still meet the metric.
    """
    threshold = min_conf if metric == "confidence" else min_lift
    # rounding may not lose a rule on the threshold; the metric itself decides below
    least = _least_confidence(metric, threshold) * F.lit(1 - 1e-9) - F.lit(1e-12)
    itemsets = keep(itemsets.select("itemset", "support"))
    left = itemsets.select(F.col("itemset").alias("antecedent"), F.col("support").alias("antecedent_support"))
    longest = itemsets.agg(F.max(F.size("itemset"))).first()[0] or 0
    split = None
    level = itemsets.where(F.size("itemset") > 1).withColumn("consequent", F.array().cast(itemsets.schema["itemset"].dataType))
    for size in range(1, longest):
        further = F.filter("itemset", lambda x: F.col("consequent")[size - 2] < x) if size > 1 else F.col("itemset")
        grown = level.where(F.size("itemset") > size).select("itemset", "support", "consequent", F.explode(further).alias("item"))
        told = grown.withColumn("consequent", F.concat("consequent", F.array("item"))).drop("item")
        told = told.withColumn("antecedent", F.array_except("itemset", "consequent")).join(left, "antecedent")
        level = keep(told.withColumn("confidence", F.col("support") / F.col("antecedent_support")).where(F.col("confidence") >= least))
        split = level if split is None else split.unionByName(level)
        level = level.select("itemset", "support", "consequent")
        if size + 1 < longest and level.isEmpty():
            break
    if split is None:
        split = level.withColumns({"antecedent": F.col("itemset"), "antecedent_support": F.col("support"), "confidence": F.lit(1.0)}).limit(0)
    right = itemsets.select(F.col("itemset").alias("consequent"), F.col("support").alias("consequent_support"))
    rules = (
        split.join(right, "consequent")
        .withColumn("lift", F.col("confidence") / F.col("consequent_support"))
        .withColumn("leverage", F.col("support") - F.col("antecedent_support") * F.col("consequent_support"))
        .withColumn(
            "conviction",
            F.when(F.col("confidence") >= 1.0, F.lit(float("inf"))).otherwise(
                (1.0 - F.col("consequent_support")) / (1.0 - F.when(F.col("confidence") < 1.0, F.col("confidence")))
            ),
        )
    )
    return rules.where(F.col(metric) >= threshold).select(
        "antecedent",
        "consequent",
        "antecedent_support",
        "consequent_support",
        "support",
        "confidence",
        "lift",
        "leverage",
        "conviction",
        F.size("antecedent").alias("antecedent_len"),
    )


def rule_summary(rules: DataFrame) -> DataFrame:
    """Number of rules and the mean of each measure.

    The per-rule lists of the measures are the columns of the rule table itself;
    they are not gathered into one cell because their number is not bounded.
    """
    return rules.agg(
        F.count(F.lit(1)).alias("n_rules"),
        F.avg("support").alias("avg_support"),
        F.avg("lift").alias("avg_lift"),
        F.avg("confidence").alias("avg_confidence"),
    )


def rule_values(rules: DataFrame, run: str) -> DataFrame:
    """(run, rule, measure, value): the value lists of a run's rules as a long table that run records can hold."""
    named = rules.withColumn("rule", F.concat_ws(" -> ", F.concat_ws(",", "antecedent"), F.concat_ws(",", "consequent")))
    measures = ["support", "lift", "confidence"]
    return named.select(F.lit(run).alias("run"), "rule", *measures).unpivot(["run", "rule"], measures, "measure", "value")


def top_rules(rules: DataFrame, n: int = 10) -> DataFrame:
    """The n rules of highest lift."""
    return rules.orderBy(
        F.col("lift").desc(), F.col("support").desc(), F.concat_ws(",", "antecedent"), F.concat_ws(",", "consequent")
    ).limit(n)
