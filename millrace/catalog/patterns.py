"""Queries: frequent itemsets and association rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import fixtures as fx
from millrace.catalog import statements as st
from millrace.catalog.prepare import anova_cells, cut_sql
from millrace.catalog.registry import query, rounded
from millrace.operators import mining
from millrace.plans.jobs import mining_job
from millrace.session import new_path
from millrace.sources import csv

BASKET_ITEMS_SQL = fx.BASKETS_SQL + ", tx AS (SELECT user_id || '|' || d AS tid, item FROM baskets)"
N_BASKETS = "(SELECT count(DISTINCT tid) FROM tx)"


def names(df, *cols):
    return df.withColumns({c: F.array_join(c, ",") for c in cols})


def frequent(min_support: float, n: str = N_BASKETS) -> str:
    return f"frequent AS (SELECT itemset, freq, freq * 1.0::DOUBLE / {n} AS support FROM sets WHERE freq >= ceil({min_support} * {n}))"


@query(
    f"WITH RECURSIVE {BASKET_ITEMS_SQL}, {st.itemsets_cte('tx', 'tid')}, {frequent(0.05)} "
    f"SELECT array_to_string(itemset, ',') AS itemset, freq, {st.r('support', 'support')} FROM frequent"
)
def frequent_itemsets(spark, sf):
    baskets = fx.baskets(spark, sf).select("items").persist()
    return rounded(names(mining.frequent_itemsets(baskets, "items", 0.05), "itemset"), "support")


@query(
    f"WITH RECURSIVE {BASKET_ITEMS_SQL}, {st.itemsets_cte('tx', 'tid')}, {frequent(0.02)} "
    f"SELECT array_to_string(itemset, ',') AS itemset, freq, {st.r('support', 'support')} FROM frequent"
)
def apriori_itemsets(spark, sf):
    return rounded(names(mining.apriori(fx.baskets(spark, sf), "items", 0.02), "itemset"), "support")


@query(
    f"WITH RECURSIVE {BASKET_ITEMS_SQL}, {st.itemsets_cte('tx', 'tid')}, {st.schedule_cte(0.35, 18, N_BASKETS)} "
    f"SELECT array_to_string(itemset, ',') AS itemset, freq, {st.r('s', 'min_support')} FROM sets, chosen WHERE freq >= ceil(s * {N_BASKETS})"
)
def frequent_itemsets_decreasing(spark, sf):
    """The support is lowered until at least 18 patterns are found."""
    found, support = mining.frequent_itemsets_decreasing(fx.baskets(spark, sf), "items", 0.35, 18)
    return names(found, "itemset").select("itemset", "freq", F.round(F.lit(support), 6).alias("min_support"))


MEASURES = "antecedent_support consequent_support support confidence lift leverage conviction".split()
RULE_OUT = (
    "array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent, "
    + ", ".join(st.r(m, m) for m in MEASURES)
    + ", CAST(len(antecedent) AS INTEGER) AS antecedent_len"
)
RULES_SQL = f"{BASKET_ITEMS_SQL}, {st.itemsets_cte('tx', 'tid')}, {frequent(0.02)}, {st.rules_cte()}"


def basket_rules(spark, sf, metric, **thresholds):
    itemsets = mining.frequent_itemsets(fx.baskets(spark, sf).select("items").persist(), "items", 0.02).persist()
    return mining.association_rules(itemsets, metric, **thresholds)


@query(f"WITH RECURSIVE {RULES_SQL} SELECT {RULE_OUT} FROM rules WHERE lift >= 0.7")
def rules_by_lift(spark, sf):
    return rounded(names(basket_rules(spark, sf, "lift", min_lift=0.7), "antecedent", "consequent"), *MEASURES)


@query(f"WITH RECURSIVE {RULES_SQL} SELECT {RULE_OUT} FROM rules WHERE confidence >= 0.3")
def rules_by_confidence(spark, sf):
    return rounded(names(basket_rules(spark, sf, "confidence", min_conf=0.3), "antecedent", "consequent"), *MEASURES)


@query(
    f"WITH RECURSIVE {RULES_SQL} SELECT count(*) AS n_rules, {st.r('avg(support)', 'avg_support')}, "
    f"{st.r('avg(lift)', 'avg_lift')}, {st.r('avg(confidence)', 'avg_confidence')} FROM rules WHERE lift >= 0.7"
)
def rule_summary(spark, sf):
    out = mining.rule_summary(basket_rules(spark, sf, "lift", min_lift=0.7))
    return rounded(out, "avg_support", "avg_lift", "avg_confidence")


@query(
    f"""WITH RECURSIVE {RULES_SQL} SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent,
  {st.r('support', 'support')}, {st.r('lift', 'lift')} FROM rules WHERE lift >= 0.7
  ORDER BY round(rules.lift, 9) DESC, round(rules.support, 9) DESC, array_to_string(rules.antecedent, ','), array_to_string(rules.consequent, ',') LIMIT 10"""
)
def top_rules_csv(spark, sf):
    """The ten rules of highest lift written as CSV and read back."""
    rules = basket_rules(spark, sf, "lift", min_lift=0.7)
    # equal lifts may differ in the last digit, so ties are broken on nine
    top = mining.top_rules(rules.withColumns({"lift": F.round("lift", 9), "support": F.round("support", 9)}))
    path = new_path(spark, "rules")
    out = names(top, "antecedent", "consequent").select(F.lit(0).alias("index"), "antecedent", "consequent", "support", "lift")
    csv.write_results(out, path)
    return rounded(csv.read_results(spark, path).drop("index"), "support", "lift")


PART_ITEMS_SQL = f"""{fx.PARTS_SQL}, binned AS (SELECT row_id, {cut_sql('size', 'parts_f')} AS s, {cut_sql('price', 'parts_f')} AS p, standard, brand FROM parts_f),
tx AS (SELECT row_id AS tid, 'size_' || s AS item FROM binned UNION ALL SELECT row_id, 'price_' || p FROM binned
       UNION ALL SELECT row_id, 'standard' FROM binned WHERE standard = 1)"""
N_PARTS = "(SELECT count(*) FROM parts_f)"


@query(
    f"WITH RECURSIVE {PART_ITEMS_SQL}, {st.itemsets_cte('tx', 'tid')}, {frequent(0.05, N_PARTS)} "
    f"SELECT array_to_string(itemset, ',') AS itemset, freq, {st.r('support', 'support')} FROM frequent"
)
def itemsets_of_binned_attributes(spark, sf):
    """Binned and one-hot encoded part attributes as transactions."""
    from millrace.operators.encode import discretize, items_of

    binned, edges = discretize(fx.part_features(spark, sf), fx.PARTS.features, 3, "cut")
    items = binned.select(items_of(list(edges), ["standard"]).alias("items")).persist()
    return rounded(names(mining.frequent_itemsets(items, "items", 0.05), "itemset"), "support")


DOC_COLS = fx.DOCS.features
_BINS = " UNION ALL ".join(
    f"SELECT row_id AS tid, '{c}' AS c, '{c}_' || {cut_sql(c, 'docs_f')} AS item FROM docs_f" for c in DOC_COLS
)


@query(
    f"""WITH RECURSIVE {fx.DOCS_SQL}, scores AS ({anova_cells(DOC_COLS, 'docs_f', 'quality')}),
best AS (SELECT feature FROM scores ORDER BY score DESC NULLS LAST, position DESC LIMIT 3),
tx AS (SELECT tid, item FROM ({_BINS}) WHERE c IN (SELECT feature FROM best)),
{st.itemsets_cte('tx', 'tid')}, {st.schedule_cte(0.35, 12, '(SELECT count(*) FROM docs_f)')},
frequent AS (SELECT itemset, freq * 1.0::DOUBLE / (SELECT count(*) FROM docs_f) AS support FROM sets, chosen
             WHERE freq >= ceil(s * (SELECT count(*) FROM docs_f))),
{st.rules_cte()} SELECT {RULE_OUT} FROM rules WHERE lift >= 1.2"""
)
def pattern_mining_job(spark, sf):
    """Best features, bins, one-hot, itemsets at falling support, rules by lift."""
    config = {"featureFunction": "f_classif", "nFeatures": 3, "miningParams": {"min_patterns": 12}}
    rules = mining_job(fx.doc_features(spark, sf), fx.DOCS, config)
    return rounded(names(rules, "antecedent", "consequent"), *MEASURES)
