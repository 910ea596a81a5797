"""Quality rules with host verdicts.

Each document is held against simple rules.  Failures are added up by host, the
failure rate of a host is shrunk with a beta prior estimated from all hosts, and
a host whose shrunk rate of any rule exceeds a limit loses all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, small_side, stored
from millrace.llm.textstats import text_stats

#: A host fails a rule if its shrunk failure rate is above this.
HOST_LIMIT = 0.5
#: The two rules that reject a document by themselves.
BASE = ("few_words", "repetition")
#: Prior strengths (in documents) are kept within these.
LEAST_PRIOR, MOST_PRIOR = 0.01, 1e6


def rules(s: str = "s_") -> dict[str, Column]:
    """Rule name -> whether a document with the counts in struct ``s`` fails it."""
    c = lambda name: F.col(f"{s}.{name}")
    n = c("n_words")
    return {
        "few_words": n < 10,
        "repetition": 100 * c("n_repeat_words") > 20 * n,
        "symbols": 10 * c("n_symbols") > n,
        "repeated_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
    }


def beta_prior(n_hosts: float, n: float, n_squared: float, failures: float, spread: float) -> tuple[float, float]:
    """(mean, strength) of the beta prior by moments of the beta-binomial.

    ``spread`` is the sum over hosts of n * (rate - mean)^2.  Rates that differ no
    more than chance allows give the largest strength, one host as well.
    """
    mean = failures / n if n else 0.0
    noise = mean * (1 - mean)
    room = n - n_squared / n - (n_hosts - 1) if n else 0.0
    if noise <= 0 or room <= 0:
        return mean, MOST_PRIOR
    share = (spread - noise * (n_hosts - 1)) / (noise * room)  # correlation of two documents of a host
    if share <= 0:
        return mean, MOST_PRIOR
    return mean, min(max(1 / share - 1, LEAST_PRIOR), MOST_PRIOR)


def host_verdicts(counted: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, <rule>_rate (shrunk) and rejected, from documents with struct ``s_``; null is a host too."""
    named = rules()
    hosts = counted.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(fails.cast("long")).alias(f"{r}_failed") for r, fails in named.items()]
    )
    hosts = stored(hosts, "hosts")
    n = F.col("n_docs").cast("double")
    totals = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"),
        *[F.sum(f"{r}_failed").alias(r) for r in named],
    ).first()
    if not totals["hosts"]:
        return hosts.select(
            "host", "n_docs", *[F.lit(0.0).alias(f"{r}_rate") for r in named], F.lit(False).alias("rejected")
        )
    spreads = hosts.agg(
        *[F.sum(n * F.pow(F.col(f"{r}_failed") / n - F.lit(totals[r] / totals["n"]), 2)).alias(r) for r in named]
    ).first()
    rates = {}
    for r in named:
        mean, strength = beta_prior(totals["hosts"], totals["n"], totals["nn"], totals[r], spreads[r])
        rates[f"{r}_rate"] = (F.col(f"{r}_failed") + F.lit(mean * strength)) / (n + F.lit(strength))
    return (
        hosts.withColumns(rates)
        .withColumn("rejected", F.greatest(*[F.col(c) for c in rates]) > limit)
        .select("host", "n_docs", *rates, "rejected")
    )


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, the counts of the rules, base_failed and kept.

    Null texts count as empty (no words, so they fail); a null host is one host;
    repeated rows are judged like others; an empty table gives no rows.  Other
    columns are not read.
    """
    counted = stored(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host_"), text_stats(as_bytes(text)).alias("s_")),
        "rules",
    )
    bad = host_verdicts(counted, "host_").where("rejected").select(F.col("host").alias("bad_"), F.lit(True).alias("rejected_"))
    failed = rules()
    base = F.coalesce(failed[BASE[0]] | failed[BASE[1]], F.lit(True))
    return counted.join(small_side(bad), F.col("host_").eqNullSafe(F.col("bad_")), "left").select(
        "doc_id",
        *[F.col(f"s_.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        (~base & F.col("rejected_").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and whose host is not rejected, all columns as they are.

    The counts are taken twice, once for the hosts and once for the filter: that
    is cheaper than shuffling the texts.
    """
    counted = docs.select(F.col(host).alias("host_"), text_stats(as_bytes(text)).alias("s_"))
    bad = host_verdicts(counted, "host_").where("rejected").select(F.col("host").alias("bad_"))
    rows = docs.select(F.struct("*").alias("row_"), F.col(host).alias("host_"), text_stats(as_bytes(text)).alias("s_"))
    failed = rules()
    return (
        rows.where(~failed[BASE[0]] & ~failed[BASE[1]])
        .join(small_side(bad), F.col("host_").eqNullSafe(F.col("bad_")), "left_anti")
        .select("row_.*")
    )
