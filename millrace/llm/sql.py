"""SQL of the queries that SQL can express, for comparison."""

from __future__ import annotations

from millrace.llm.host_rules import HOST_LIMIT, LEAST_PRIOR, MOST_PRIOR
from millrace.llm.substrings import WINDOW

# rows are numbered, so that repeated ids stay apart
_WORDS = r"""w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
  [x for x in string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+') if x <> ''] AS ws FROM documents)"""

SUBSTRINGS = f"""WITH {_WORDS},
win AS (SELECT r, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h
        FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
hit AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS k FROM hit),
runs AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE k <> before + 1 OR before IS NULL) AS n_intervals
         FROM (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS before FROM gone) GROUP BY r),
word AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS k FROM w),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_intervals, 0) AS BIGINT) AS n_intervals, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN runs USING (r) LEFT JOIN kept USING (r)"""

_RULES = ("few_words", "repetition", "symbols", "repeated_lines")


def _host_rules() -> str:
    failures = ", ".join(f"sum({x}::INTEGER) AS {x}" for x in _RULES)
    moments = ", ".join(
        f"sum({x}) / sum(n) AS m_{x}, sum(n * pow({x} / n - (SELECT sum({x}) / sum(n) FROM host), 2)) AS s_{x}" for x in _RULES
    )
    # strength of the beta prior from the moments of the beta-binomial
    strengths = ", ".join(
        f"""CASE WHEN m_{x} * (1 - m_{x}) <= 0 OR room <= 0 OR s_{x} - m_{x} * (1 - m_{x}) * (hosts - 1) <= 0 THEN {MOST_PRIOR}
  ELSE least(greatest(m_{x} * (1 - m_{x}) * room / (s_{x} - m_{x} * (1 - m_{x}) * (hosts - 1)) - 1, {LEAST_PRIOR}), {MOST_PRIOR}) END AS p_{x}"""
        for x in _RULES
    )
    rates = ", ".join(f"({x} + m_{x} * p_{x}) / (n + p_{x})" for x in _RULES)
    return f"""WITH {_WORDS},
win AS (SELECT r, i, ws[i:i + 4] AS five FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT r, five FROM win GROUP BY r, five HAVING count(*) > 1),
again AS (SELECT r, count(DISTINCT k) AS n_repeat_words
          FROM (SELECT win.r, unnest(range(i, i + 5)) AS k FROM win JOIN twice ON twice.r = win.r AND twice.five = win.five) GROUP BY r),
c AS (SELECT r, doc_id, source, len(ws) AS n_words, coalesce(list_sum([length(x) for x in ws]), 0) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')] AS lines FROM w),
counted AS (SELECT c.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN again USING (r)),
ruled AS (SELECT *, n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repetition,
        10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS repeated_lines FROM counted),
host AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {failures} FROM ruled GROUP BY source),
overall AS (SELECT count(*) AS hosts, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room, {moments} FROM host),
prior AS (SELECT *, {strengths} FROM overall),
bad AS (SELECT source FROM host, prior WHERE greatest({rates}) > {HOST_LIMIT})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, few_words OR repetition AS base_failed,
  NOT (few_words OR repetition) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM ruled.source) AS kept
FROM ruled"""


HOST_RULES = _host_rules()
