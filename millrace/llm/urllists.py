"""URL lists whose entries are dated, applied to captures as of the time they were fetched.

Events (entry added, entry removed) become disjoint validity intervals per entry.
A capture looks up its url, its host and every parent domain; the join is on the
pattern and the month, and within it on the day, so that neither an entry that
changes daily nor a host that holds a third of all captures makes a long list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import digest
from millrace.llm.common import small_side, stored

ALLOW = "allow"
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host, empty if the url has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)", 2))


def page_of(url: Column) -> Column:
    """What lies between scheme and query, empty if there is no scheme."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)


def patterns_of(url: Column) -> Column:
    """The patterns a url answers to: (scope, pattern) for its page, its host and its parent domains but the last label."""
    host, parts = host_of(url), F.split(host_of(url), r"\.")
    parents = F.when(
        F.size(parts) > 2,
        F.transform(
            F.sequence(F.lit(2), F.size(parts) - 1),
            lambda i: F.struct(F.lit("domain").alias("scope"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("pattern")),
        ),
    )
    own = F.array(
        F.struct(F.lit("url").alias("scope"), page_of(url).alias("pattern")),
        F.struct(F.lit("host").alias("scope"), host.alias("pattern")),
        F.struct(F.lit("domain").alias("scope"), host.alias("pattern")),
    )
    return F.filter(F.concat(own, F.coalesce(parents, F.array_remove(own, own[0]))), lambda x: x["pattern"] != "")


def validity(events: DataFrame) -> DataFrame:
    """(list, scope, pattern, valid_from, valid_to): half-open intervals in which an entry is active.

    ``events`` holds list, scope, pattern, dated (a date) and action (add or remove).
    Of events of one day a removal counts; a second add changes nothing.  Events
    with a null in any of these are not used.
    """
    key = ["list", "scope", "pattern"]
    daily = events.dropna(subset=[*key, "dated", "action"]).groupBy(*key, "dated").agg(F.max(F.col("action") == "remove").alias("gone"))
    following = F.lead("dated").over(Window.partitionBy(*key).orderBy("dated"))
    return daily.withColumn("valid_to", F.coalesce(following, F.lit(FOREVER).cast("date"))).where(~F.col("gone")).select(
        *key, F.col("dated").alias("valid_from"), "valid_to"
    )


def judged(
    captures: DataFrame, events: DataFrame, page_id: str = "page_id", url: str = "url", fetched: str = "fetched"
) -> DataFrame:
    """page_id, url, host, fetched, n_active, lists and blocked per row of ``captures``.

    n_active counts the active entries that the url answers to, lists names their
    lists (sorted, comma-joined, empty if none), and blocked tells whether one of
    them is not the allow list and none is.  A null url answers to nothing, and at
    a null time nothing is active; repeated rows are rows like others; an empty
    table on either side is no special case.  Other columns are not read.
    """
    rows = captures.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(fetched).cast("date").alias("fetched"))
    span = rows.agg(F.min("fetched").alias("a"), F.max("fetched").alias("b")).first()
    intervals = validity(events)
    if span["a"] is None:
        intervals = intervals.where(F.lit(False))
    first, last = F.lit(str(span["a"] or "1970-01-01")).cast("date"), F.lit(str(span["b"] or "1970-01-01")).cast("date")
    months = F.sequence(
        F.trunc(F.greatest("valid_from", first), "month"),
        F.trunc(F.least(F.date_sub("valid_to", 1), last), "month"),
        F.expr("interval 1 month"),
    )
    alive = (F.col("valid_from") <= last) & (F.col("valid_to") > first)
    entries = stored(intervals.where(alive).withColumn("month", F.explode(months)), "entries")
    asked = rows.where(F.col("fetched").isNotNull()).select("*", F.explode(patterns_of(F.col("url"))).alias("x"))
    asked = asked.select("page_id", "url", "fetched", "x.scope", "x.pattern", F.trunc("fetched", "month").alias("month"))
    active = (
        asked.join(small_side(entries), ["scope", "pattern", "month"])
        .where((F.col("valid_from") <= F.col("fetched")) & (F.col("fetched") < F.col("valid_to")))
        .select("page_id", "url", "fetched", "list", "scope", "pattern")
        .distinct()
        .groupBy("page_id", "url", "fetched")
        .agg(
            F.count(F.lit(1)).alias("n_active"),
            F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
            F.max(F.col("list") == ALLOW).alias("allowed"),
        )
    )
    active = active.select(*[F.col(c).alias(f"{c}_") for c in ("page_id", "url", "fetched")], "n_active", "lists", "allowed")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("page_id", "url", "fetched")]
    n = F.coalesce("n_active", F.lit(0)).cast("bigint")
    return rows.join(active, same[0] & same[1] & same[2], "left").select(
        "page_id",
        "url",
        host_of(F.col("url")).alias("host"),
        "fetched",
        n.alias("n_active"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        ((n > 0) & ~F.coalesce("allowed", F.lit(False))).alias("blocked"),
    )


def _number(seed: str, c: Column) -> Column:
    return F.conv(F.substring(digest(seed, c), 1, 8), 16, 10).cast("bigint")


def with_fetch_day(pages: DataFrame) -> DataFrame:
    """The pages table tells no time: its ids are dealt over two years."""
    return pages.withColumn("fetched", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("page_id", F.lit(730)).cast("int")))


def derived_events(pages: DataFrame, url: str = "url") -> DataFrame:
    """Dated list entries made from the hosts, domains and pages of a table of pages.

    A third of the hosts is listed as spam, dropped and listed again; a quarter of
    the three-label domains is listed for good; one page in twenty is allowed.
    """
    hosts = pages.select(host_of(F.col(url)).alias("pattern")).where("pattern <> ''").distinct()
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int"))
    spam = hosts.withColumn("r", _number("spam", F.col("pattern"))).where("r % 3 = 0")
    spam = spam.select(
        F.lit("spam").alias("list"),
        F.lit("host").alias("scope"),
        "pattern",
        F.explode(
            F.array(
                F.struct(day(F.col("r") % 400).alias("dated"), F.lit("add").alias("action")),
                F.struct(day(F.col("r") % 400 + 90 + F.col("r") % 50).alias("dated"), F.lit("remove").alias("action")),
                F.struct(day(F.col("r") % 400 + 200).alias("dated"), F.lit("add").alias("action")),
            )
        ).alias("e"),
    ).select("list", "scope", "pattern", "e.dated", "e.action")
    domains = hosts.select(F.substring_index("pattern", ".", -3).alias("pattern")).distinct()
    adult = domains.withColumn("r", _number("adult", F.col("pattern"))).where("r % 4 = 0").select(
        F.lit("adult").alias("list"), F.lit("domain").alias("scope"), "pattern", day(F.col("r") % 500).alias("dated"), F.lit("add").alias("action")
    )
    allowed = pages.select(page_of(F.col(url)).alias("pattern")).where("pattern <> ''").distinct()
    allowed = allowed.withColumn("r", _number("allow", F.col("pattern"))).where("r % 20 = 0").select(
        F.lit(ALLOW).alias("list"), F.lit("url").alias("scope"), "pattern", day(F.col("r") % 300).alias("dated"), F.lit("add").alias("action")
    )
    return spam.unionByName(adult).unionByName(allowed)


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)', 2))"
_PAGE = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1)"
_R = "CAST(('0x' || substr(md5('{}:' || pattern), 1, 8)) AS BIGINT)"
SQL = rf"""
WITH captures AS (
  SELECT page_id, url, {_HOST} AS host, {_PAGE} AS page, DATE '2023-01-01' + CAST(page_id % 730 AS INTEGER) AS fetched FROM pages
), hosts AS (
  SELECT pattern, {_R.format("spam")} AS r FROM (SELECT DISTINCT host AS pattern FROM captures WHERE host <> '')
), domains AS (
  SELECT pattern, {_R.format("adult")} AS r
  FROM (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS pattern FROM captures WHERE host <> '')
), paths AS (
  SELECT pattern, {_R.format("allow")} AS r FROM (SELECT DISTINCT page AS pattern FROM captures WHERE page <> '')
), entries AS (
  SELECT 'spam' AS list, 'host' AS scope, pattern, DATE '2023-01-01' + CAST(r % 400 AS INTEGER) AS a, DATE '2023-01-01' + CAST(r % 400 + 90 + r % 50 AS INTEGER) AS b
  FROM hosts WHERE r % 3 = 0
  UNION ALL
  SELECT 'spam', 'host', pattern, DATE '2023-01-01' + CAST(r % 400 + 200 AS INTEGER), DATE '9999-12-31' FROM hosts WHERE r % 3 = 0
  UNION ALL
  SELECT 'adult', 'domain', pattern, DATE '2023-01-01' + CAST(r % 500 AS INTEGER), DATE '9999-12-31' FROM domains WHERE r % 4 = 0
  UNION ALL
  SELECT 'allow', 'url', pattern, DATE '2023-01-01' + CAST(r % 300 AS INTEGER), DATE '9999-12-31' FROM paths WHERE r % 20 = 0
), hits AS (
  SELECT c.page_id, count(*) AS n, string_agg(DISTINCT e.list, ',' ORDER BY e.list) AS lists, bool_or(e.list = 'allow') AS allowed
  FROM captures c JOIN entries e ON e.a <= c.fetched AND c.fetched < e.b AND (
    (e.scope = 'host' AND e.pattern = c.host) OR (e.scope = 'url' AND e.pattern = c.page)
    OR (e.scope = 'domain' AND (c.host = e.pattern OR c.host LIKE '%.' || e.pattern)))
  GROUP BY 1
)
SELECT c.page_id, c.url, c.host, CAST(c.fetched AS VARCHAR) AS fetched, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(lists, '') AS lists,
  coalesce(n, 0) > 0 AND NOT coalesce(allowed, false) AS blocked
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id
"""
