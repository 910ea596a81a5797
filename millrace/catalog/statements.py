"""SQL building blocks shared by several statements."""

from __future__ import annotations

from millrace.functions.hashing import hash_key_sql, uniform_sql
from millrace.operators.classify import POISSON_STEPS


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def folds_cte(src: str, label: str, k: int, keep: str) -> str:
    """folds(row_id, label, fold, keep...): contiguous key ranges per class."""
    return f"""cls_ AS (SELECT {label} AS c, count(*) AS n, min(row_id) AS first FROM {src} GROUP BY {label}),
start_ AS (SELECT c, n, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cls_),
size_ AS (SELECT c, i, floor((s + n - 1 - i) / {k}.0) - floor((s - 1 - i) / {k}.0) AS z FROM start_, range({k}) t(i)),
upto_ AS (SELECT c, i, z, sum(z) OVER (PARTITION BY c ORDER BY i) AS u FROM size_),
folds AS (SELECT t.row_id, t.{label}, CAST(u_.i AS INTEGER) AS fold, {keep}
          FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY row_id) - 1 AS rn FROM {src}) t
          JOIN upto_ u_ ON u_.c = t.{label} AND t.rn < u_.u AND t.rn >= u_.u - u_.z)"""


def split_cte(src: str, seed: int = 420, share: float = 0.3) -> str:
    return f"""marked AS (SELECT *, row_number() OVER (ORDER BY {hash_key_sql(seed, 'row_id')}, row_id)
      <= ceil({share} * (SELECT count(*) FROM {src})) AS is_test FROM {src})"""


def bayes_folds_cte(cols, label: str, k: int, scaled: bool = True) -> str:
    """pred(fold, row_id, label, prediction) from folds(...): each fold predicted from the others."""
    xs = [f"x{i}" for i in range(len(cols))]
    if scaled:
        rng = ", ".join(f"min({c}) AS lo{i}, max({c}) - min({c}) AS w{i}" for i, c in enumerate(cols))
        val = ", ".join(f"(t.{c} - g.lo{i}) / g.w{i} AS x{i}" for i, c in enumerate(cols))
    else:
        rng = "1 AS one"
        val = ", ".join(f"t.{c} AS x{i}" for i, c in enumerate(cols))
    stats = ", ".join(f"avg({x}) AS m_{x}, var_pop({x}) AS v_{x}" for x in xs)
    eps = "1e-9 * greatest(" + ", ".join(f"var_pop({x})" for x in xs) + ")"
    ll = " + ".join(
        f"-0.5 * ln(2 * pi() * (v_{x} + eps)) - (s.{x} - m_{x}) * (s.{x} - m_{x}) / (2 * (v_{x} + eps))" for x in xs
    )
    return f"""out_ AS (SELECT CAST(i AS INTEGER) AS f FROM range({k}) t(i)),
rng_ AS (SELECT f, {rng} FROM folds JOIN out_ ON fold <> f GROUP BY f),
sc_ AS (SELECT g.f, t.fold, t.row_id, t.{label} AS label, {val} FROM folds t, rng_ g),
st_ AS (SELECT f, label, count(*) AS n, {stats} FROM sc_ WHERE fold <> f GROUP BY f, label),
tot_ AS (SELECT f, count(*) AS n_all, {eps} AS eps FROM sc_ WHERE fold <> f GROUP BY f),
ll_ AS (SELECT s.f, s.row_id, s.label, st_.label AS c, ln(n * 1.0 / n_all) + {ll} AS score
        FROM sc_ s JOIN st_ ON st_.f = s.f JOIN tot_ ON tot_.f = s.f WHERE s.fold = s.f),
pred AS (SELECT f AS grp, row_id, label, c AS prediction FROM
         (SELECT *, row_number() OVER (PARTITION BY f, row_id ORDER BY score DESC, c) AS rn FROM ll_) WHERE rn = 1)"""


METRIC_NAMES = (
    "accuracy precision recall f1 kappa ref_sensitivity ref_specificity tpr tnr cost precision_macro recall_macro f1_macro"
).split()


def metrics_cte(src: str = "pred") -> str:
    """metrics(grp, <METRIC_NAMES>) from pred(grp, label, prediction)."""
    return f"""conf_ AS (SELECT grp, label, prediction, count(*) AS n FROM {src} GROUP BY ALL),
known_ AS (SELECT grp, c, dense_rank() OVER (PARTITION BY grp ORDER BY c) AS k
           FROM (SELECT grp, label AS c FROM conf_ UNION SELECT grp, prediction FROM conf_)),
marg_ AS (SELECT grp, c, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM (
            SELECT grp, label AS c, n AS t, 0 AS p, 0 AS h FROM conf_
            UNION ALL SELECT grp, prediction, 0, n, CASE WHEN label = prediction THEN n ELSE 0 END FROM conf_) GROUP BY ALL),
macro_ AS (SELECT grp, avg(coalesce(h / nullif(p, 0), 0)) AS precision_macro, avg(coalesce(h / nullif(t, 0), 0)) AS recall_macro,
                  avg(coalesce(2 * h / nullif(t + p, 0), 0)) AS f1_macro, sum(t * p) AS tp FROM marg_ GROUP BY grp),
all_ AS (SELECT grp, sum(n) AS n, sum(CASE WHEN label = prediction THEN n ELSE 0 END) / sum(n) AS accuracy FROM conf_ GROUP BY grp),
cell_ AS (SELECT conf_.grp,
            coalesce(sum(n) FILTER (WHERE a.k = 1 AND b.k = 1), 0) AS c00, coalesce(sum(n) FILTER (WHERE a.k = 1 AND b.k = 2), 0) AS c01,
            coalesce(sum(n) FILTER (WHERE a.k = 2 AND b.k = 1), 0) AS c10, coalesce(sum(n) FILTER (WHERE a.k = 2 AND b.k = 2), 0) AS c11
          FROM conf_ JOIN known_ a ON a.grp = conf_.grp AND a.c = label JOIN known_ b ON b.grp = conf_.grp AND b.c = prediction
          GROUP BY conf_.grp),
metrics AS (SELECT all_.grp, accuracy, accuracy AS precision, accuracy AS recall, accuracy AS f1,
            (accuracy - tp / (n * n)) / nullif(1 - tp / (n * n), 0) AS kappa,
            c00 / nullif(c00 + c10, 0) AS ref_sensitivity, c11 / nullif(c11 + c01, 0) AS ref_specificity,
            c11 / nullif(c11 + c10, 0) AS tpr, c00 / nullif(c00 + c01, 0) AS tnr,
            (c00 / nullif(c00 + c10, 0) + c11 / nullif(c11 + c01, 0)) / 2 AS cost, precision_macro, recall_macro, f1_macro
          FROM all_ JOIN macro_ ON macro_.grp = all_.grp JOIN cell_ ON cell_.grp = all_.grp)"""


def knn_cte(
    queries: str, points: str, k: int, same: str | None = None, carry: str | None = None, not_self: bool = True, out: str = "near"
) -> str:
    """near(row_id, neighbor_id, distance, rank[, carry]) by comparing all rows."""
    conditions = [f"q.{same} = p.{same}"] if same else []
    conditions += ["q.row_id <> p.row_id"] if not_self else []
    where = f"WHERE {' AND '.join(conditions)}" if conditions else ""
    more = f", p.{carry} AS {carry}" if carry else ""
    return f"""{out}_d AS (SELECT q.row_id, p.row_id AS neighbor_id, list_distance(q.vec, p.vec) AS distance{more}
         FROM {queries} q, {points} p {where}),
{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, neighbor_id) AS rank FROM {out}_d)
         WHERE rank <= {k})"""


def vote_cte(label: str, weights: str, near: str = "near", out: str = "votes") -> str:
    """votes(row_id, prediction) from near."""
    w = "1.0" if weights == "uniform" else (
        "CASE WHEN min(distance) OVER (PARTITION BY row_id) = 0 THEN (distance = 0)::INTEGER ELSE 1.0 / nullif(distance, 0) END"
    )
    return f"""{out}_w AS (SELECT row_id, {label} AS c, {w} AS w FROM {near}),
{out} AS (SELECT row_id, c AS prediction FROM (
   SELECT row_id, c, row_number() OVER (PARTITION BY row_id ORDER BY sum(w) DESC, c) AS rn FROM {out}_w GROUP BY row_id, c) WHERE rn = 1)"""


def undersample_cte(src: str, label: str, quota: str, seed: int = 0, out: str = "sampled") -> str:
    """The quota(label) rows of each class with the smallest hash."""
    return f"""{out} AS (SELECT * EXCLUDE (rn, q) FROM (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {hash_key_sql(seed, 'row_id')}, row_id) AS rn, {quota} AS q FROM {src}) WHERE rn <= q)"""


def smote_cte(src: str, cols, label: str, goal: str, k: int = 5, seed: int = 0) -> str:
    """grown(row_id, label, cols..., synthetic); ``goal`` is the wanted class size given n and label."""
    vec = "[" + ", ".join(cols) + "]"
    made = ", ".join(f"b.{c} + {uniform_sql(f'{seed}:step', 'b.row_id', 'copy')} * (m.{c} - b.{c}) AS {c}" for c in cols)
    return f"""count_ AS (SELECT {label}, count(*) AS n FROM {src} GROUP BY {label}),
need_ AS (SELECT {label}, n, {goal} - n AS need FROM count_ WHERE {goal} > n),
most_ AS (SELECT max(need // n + 1) AS most FROM need_),
small_ AS (SELECT s.*, {vec} AS vec, need, n,
             row_number() OVER (PARTITION BY s.{label} ORDER BY {hash_key_sql(f'{seed}:extra', 's.row_id')}, s.row_id) AS rn
           FROM {src} s JOIN need_ ON need_.{label} = s.{label}),
{knn_cte('small_', 'small_', k, same=label)},
have_ AS (SELECT row_id, count(*) AS have FROM near GROUP BY row_id),
copy_ AS (SELECT s.*, unnest(range(need // n + CASE WHEN rn <= need % n THEN 1 ELSE 0 END)) AS copy FROM small_ s),
made_ AS (SELECT -(b.row_id * most + copy) - 1 AS row_id, b.{label}, {made}, true AS synthetic
          FROM copy_ b JOIN have_ ON have_.row_id = b.row_id
          JOIN near ON near.row_id = b.row_id AND near.rank = 1 + floor({uniform_sql(f'{seed}:near', 'b.row_id', 'copy')} * have)
          JOIN {src} m ON m.row_id = near.neighbor_id, most_),
grown AS (SELECT row_id, {label}, {', '.join(cols)}, false AS synthetic FROM {src}
          UNION ALL SELECT row_id, {label}, {', '.join(cols)}, synthetic FROM made_)"""


def boot_weight_sql(seed, row_id: str, replicate: str) -> str:
    u = uniform_sql(f"{seed}:boot", row_id, replicate)
    return "(" + " + ".join(f"({u} >= {s!r})::INTEGER" for s in POISSON_STEPS) + ")"


def itemsets_cte(src: str, key: str) -> str:
    """sets(itemset, freq) of every item combination that occurs; src has (key, item)."""
    return f"""grow_ AS (
  SELECT {key}, [item] AS itemset, item AS last FROM {src}
  UNION ALL SELECT g.{key}, list_append(g.itemset, b.item), b.item FROM grow_ g JOIN {src} b ON g.{key} = b.{key} AND b.item > g.last),
sets AS (SELECT itemset, count(*) AS freq FROM grow_ GROUP BY itemset)"""


def rules_cte(itemsets: str = "frequent") -> str:
    """rules from frequent(itemset, support)."""
    return f"""parts_ AS (SELECT f.itemset, f.support, a.itemset AS antecedent, a.support AS antecedent_support,
              list_filter(f.itemset, lambda x: NOT list_contains(a.itemset, x)) AS consequent
            FROM {itemsets} f JOIN {itemsets} a ON len(a.itemset) < len(f.itemset) AND list_has_all(f.itemset, a.itemset)),
rules AS (SELECT antecedent, consequent, antecedent_support, c.support AS consequent_support, p.support,
            p.support / antecedent_support AS confidence, p.support / antecedent_support / c.support AS lift,
            p.support - antecedent_support * c.support AS leverage,
            CASE WHEN p.support / antecedent_support >= 1 THEN CAST('Infinity' AS DOUBLE)
                 ELSE (1 - c.support) / (1 - p.support / antecedent_support) END AS conviction
          FROM parts_ p JOIN {itemsets} c ON c.itemset = p.consequent)"""


def schedule_cte(start: float, min_patterns: int, n: str) -> str:
    """chosen(s): the first lowered support with enough itemsets, else the last one."""
    return f"""sched_ AS (SELECT 0 AS i, CAST({start} AS DOUBLE) AS s UNION ALL SELECT i + 1, s * CAST(0.9 AS DOUBLE) FROM sched_ WHERE s > 0.01),
tried_ AS (SELECT i, s, (SELECT count(*) FROM sets WHERE freq >= ceil(sched_.s * {n})) AS found FROM sched_ WHERE i > 0),
chosen AS (SELECT s FROM tried_ ORDER BY (found >= {min_patterns}) DESC, CASE WHEN found >= {min_patterns} THEN i ELSE -i END LIMIT 1)"""


def trees_cte(
    train: str, test: str, cols, label: str, classes, depth: int, criterion: str = "gini", trees: int = 1,
    weight: str = "1", subset: int | None = None, seed: int = 0,
) -> str:
    """share_(row_id, tree, p0, p1, ...): the class shares of the leaf that each test row reaches in each tree.

    Every midpoint of every attribute is tried at every node, a CTE per level; ``weight`` may use ``tree``.
    """
    k = len(classes)
    names = [f"c{i}" for i in range(k)]

    def side(values) -> str:
        total = "(" + " + ".join(values) + ")"
        if criterion == "gini":
            return "(" + " + ".join(f"{v} * {v}" for v in values) + f") / {total}"
        parts = " + ".join(f"CASE WHEN {v} > 0 THEN {v} * ln({v}) ELSE 0 END" for v in values)
        return f"({parts} - {total} * ln({total}))"

    y = "CASE " + " ".join(f"WHEN {label} = {c!r} THEN {i}" for i, c in enumerate(classes)) + " END"
    xs = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in cols) + "]"
    score = side([f"l_{n}" for n in names]) + " + " + side([f"(t_{n} - l_{n})" for n in names])
    mixed = " + ".join(f"(t_{n} > 0)::INTEGER" for n in names)
    sums = ", ".join(f"CAST(coalesce(sum(w) FILTER (WHERE y = {i}), 0) AS DOUBLE) AS {n}" for i, n in enumerate(names))
    before = ", ".join(f"sum({n}) OVER b AS l_{n}, sum({n}) OVER g AS t_{n}" for n in names)
    tried = f"QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY md5('{seed}:' || tree || ':' || node || ':' || a)) <= {subset}"
    out = [
        f"""n0_ AS MATERIALIZED (SELECT * FROM (SELECT tree, 1::BIGINT AS node, {y} AS y, CAST({weight} AS DOUBLE) AS w, {xs} AS xs
  FROM {train}, (SELECT unnest(range({trees})) AS tree)) WHERE w > 0)""",
        f"s0_ AS (SELECT row_id, tree, 1::BIGINT AS node, {xs} AS xs FROM {test}, (SELECT unnest(range({trees})) AS tree))",
    ]
    for d in range(depth):
        sent = "CASE WHEN v.a IS NULL THEN node ELSE 2 * node + (xs[v.a + 1] > v.cut)::INTEGER END AS node"
        out += [
            f"""v{d}_ AS MATERIALIZED (
  WITH u AS (SELECT tree, node, y, w, unnest(range({len(cols)})) AS a, unnest(xs) AS x FROM n{d}_),
  c AS (SELECT tree, node, a, x, {sums} FROM u GROUP BY ALL),
  p AS (SELECT *, lag(x) OVER (PARTITION BY tree, node, a ORDER BY x) AS low, {before} FROM c
        WINDOW g AS (PARTITION BY tree, node, a), b AS (PARTITION BY tree, node, a ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  r AS (SELECT tree, node, a FROM c GROUP BY tree, node, a HAVING min(x) < max(x) {tried if subset else ''})
  SELECT tree, node, a, CASE WHEN low + (x - low) / 2 >= x THEN low ELSE low + (x - low) / 2 END AS cut
  FROM p JOIN r USING (tree, node, a) WHERE low IS NOT NULL AND {mixed} > 1
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {score} DESC, a, x) = 1)""",
            f"n{d + 1}_ AS MATERIALIZED (SELECT tree, {sent}, y, w, xs FROM n{d}_ LEFT JOIN v{d}_ v USING (tree, node))",
            f"s{d + 1}_ AS MATERIALIZED (SELECT row_id, tree, {sent}, xs FROM s{d}_ LEFT JOIN v{d}_ v USING (tree, node))",
        ]
    shares = ", ".join(f"coalesce(sum(w) FILTER (WHERE y = {i}), 0) / sum(w) AS p{i}" for i in range(k))
    out.append(f"leaf_ AS (SELECT tree, node, {shares} FROM n{depth}_ GROUP BY ALL)")
    out.append(f"share_ AS (SELECT * EXCLUDE (node, xs) FROM s{depth}_ JOIN leaf_ USING (tree, node))")
    return ",\n".join(out)


def best_class(values, classes) -> str:
    """The class of the largest value, the first one when equal."""
    best = "greatest(" + ", ".join(f"round({v}, 9)" for v in values) + ")"
    return "CASE " + " ".join(f"WHEN round({v}, 9) = {best} THEN {c!r}" for v, c in zip(values, classes)) + " END"
