"""The registered queries over the inference operators, with SQL for those that have a closed form.

Floating results are rounded, as sums in another order differ in their last digits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.normal import ERFC, binomial_bounds, dkw_error, max_binomial_error, z_of
from .operators import baselines, cross, experiment, glm, labelshift, linear, mean, power, ptd, quantile, resample
from .plans.scratch import shared_dir
from .sources.tables import labelled_documents, load, order_lines
from .streaming.means import StreamingMean

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 5


def query(fn=None, *, sql: str | None = None, name: str | None = None):
    """Register fn under its name (or `name`), with its results rounded."""
    if fn is None:
        return lambda f: query(f, sql=sql, name=name)
    key = name or fn.__name__

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        cols = [F.round(F.col(c), DIGITS).alias(c) + 0.0 if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
        return df.select(*[c.alias(n) for c, n in zip(cols, df.columns, strict=True)])

    QUERIES[key] = run
    if sql:
        ORACLE_SQL[key] = sql
    return fn


def docs(spark, d) -> DataFrame:
    return labelled_documents(spark, d).withColumn("one", F.lit(1.0))


def orders(spark, d) -> DataFrame:
    return order_lines(spark, d).withColumn("one", F.lit(1.0))


Z = z_of(0.1)

#: The tables that the queries are about, as DuckDB sees them.
DOCS = """d AS (
  SELECT doc_id, lang, source, n_chars, len(list_distinct(string_split(text, ' ')))::DOUBLE / len(string_split(text, ' ')) AS f,
         quality::DOUBLE AS y, toxic::DOUBLE AS y2, ln(n_chars) - 7 AS x, (1 + n_chars % 3)::DOUBLE AS w
  FROM documents LEFT JOIN labels USING (doc_id))"""
ORDERS = """d AS (
  SELECT o, CASE WHEN o % 10 = 0 THEN k END AS items, CASE WHEN o % 10 = 0 THEN money END AS price, q / 25.5 AS fi, q * 0.148 AS fp, q / 100 AS x, k, money, 1.0::DOUBLE AS w
  FROM (SELECT l_orderkey AS o, count(*)::DOUBLE AS k, sum(l_quantity) AS q, sum(l_extendedprice) / 10000 AS money FROM lineitem GROUP BY 1))"""


def rounded(columns: str) -> str:
    """`a, b` as rounded columns of the same names; plain ones are marked with a colon."""
    return ", ".join(c[1:] if c[0] == ":" else f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in columns.split(", "))


def mean_sql(y="y", f="f", w="1.0", by="", lam="tuned", source=DOCS, clip=True, table="d", columns="lam, estimate, se, lower, upper", z=Z, one_sided=False) -> str:
    """SQL of a rectified mean with weights w, by group; see operators.mean."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    tuned = "coalesce(c / nullif((1 + n / N_) * v, 0), 0)"
    lam = (f"greatest(0.0, least(1.0, {tuned}))" if clip else tuned) if lam == "tuned" else f"{lam}::DOUBLE"
    upper = "'infinity'::DOUBLE" if one_sided else f"estimate + {z} * se"
    return f"""WITH {source}, s AS (
  SELECT {keys}count({y}) AS n, count(*) - count({y}) AS N_, sum({w}) FILTER ({y} IS NOT NULL) AS wl, sum({w}) FILTER ({y} IS NULL) AS wu FROM {table} {group}
), r AS (
  SELECT {", ".join(f"d.{k.strip()}" for k in by.split(",")) + "," if by else ""} d.{y} AS y, d.{f} AS f, n, N_, CASE WHEN d.{y} IS NULL THEN ({w}) * N_ / wu ELSE ({w}) * n / wl END AS a
  FROM {table} d {f"JOIN s USING ({by})" if by else "CROSS JOIN s"}
), t AS (
  SELECT {keys}max(n) AS n, max(N_) AS N_, avg(a * f) FILTER (y IS NULL) + avg(a * (y - f)) AS theta FROM r {group}
), m AS (
  SELECT {", ".join(f"r.{k.strip()}" for k in by.split(",")) + "," if by else ""} max(r.n)::DOUBLE AS n, max(r.N_)::DOUBLE AS N_, covar_pop(a * (y - theta), a * (f - theta)) AS c, var_samp(a * (f - theta)) AS v,
         avg(a * y) AS ay, avg(a * f) FILTER (y IS NOT NULL) AS af, avg(a * f) FILTER (y IS NULL) AS au, var_pop(a * y) AS vy, var_pop(a * f) FILTER (y IS NOT NULL) AS vf, var_pop(a * f) FILTER (y IS NULL) AS vu, covar_pop(a * y, a * f) AS vyf
  FROM r {f"JOIN t USING ({by})" if by else "CROSS JOIN t"} {f"GROUP BY {', '.join('r.' + k.strip() for k in by.split(','))}" if by else ""}
), l AS (
  SELECT *, {lam} AS lam FROM m WHERE n > 0
), e AS (
  SELECT *, lam * au + ay - lam * af AS estimate, sqrt(lam * lam * vu / N_ + (vy + lam * lam * vf - 2 * lam * vyf) / n) AS se FROM l
), o AS (
  SELECT *, estimate - {z} * se AS lower, {upper} AS upper FROM e
)
SELECT {keys}0::INTEGER AS coord, n::BIGINT AS n, N_::BIGINT AS n_unlabeled, {rounded(columns)} FROM o"""


_POLY = "0.0"
for _c in reversed(ERFC):
    _POLY = f"(({_POLY}) * t + ({_c}))"


def p_value_sql(z: str) -> str:
    """Two-sided, of |z|, by the same fit of erfc as in functions.normal."""
    return f"(SELECT t * exp(-q * q + {_POLY}) FROM (SELECT {z} / sqrt(2) AS q, 1 / (1 + 0.5 * {z} / sqrt(2)) AS t))"


P_VALUE = p_value_sql("abs(estimate - 0.85) / se")

query(lambda s, d: mean.mean_ci(docs(s, d), "quality", "yhat", by="lang"), name="rectified_mean_by_lang", sql=mean_sql(by="lang"))
query(lambda s, d: mean.mean_ci(docs(s, d), "quality", "yhat", lam=0.0), name="rectified_mean_lam0", sql=mean_sql(lam="0"))
query(lambda s, d: mean.mean_ci(docs(s, d), "quality", "yhat", lam=1.0), name="rectified_mean_lam1", sql=mean_sql(lam="1"))
query(lambda s, d: mean.mean_ci(docs(s, d), "quality", "yhat", by="lang", w="w"), name="rectified_mean_weighted", sql=mean_sql(by="lang", w="w"))
query(lambda s, d: mean.mean_ci(docs(s, d), "quality", "yhat", alternative="larger"), name="rectified_mean_onesided", sql=mean_sql(z=z_of(0.1, "larger"), one_sided=True))
query(lambda s, d: mean.mean_estimate(docs(s, d), "quality", "yhat", by="source"), name="rectified_mean_estimate", sql=mean_sql(by="source", columns="lam, estimate"))
query(lambda s, d: mean.mean_pval(docs(s, d), "quality", "yhat", null=0.85), name="rectified_mean_pval", sql=mean_sql(clip=False, columns="lam, estimate, se, p_value").replace("FROM o", f"FROM (SELECT *, {P_VALUE} AS p_value FROM o)"))
query(
    lambda s, d: mean.mean_ci(docs(s, d), ["quality", "toxic"], ["yhat", "yhat"], mode="element"),
    name="rectified_mean_multid_element",
    sql=f"SELECT * FROM ({mean_sql()}) UNION ALL SELECT * REPLACE (1::INTEGER AS coord) FROM ({mean_sql(y='y2')})",
)
query(
    lambda s, d: mean.mean_ci(docs(s, d).withColumn("g", F.expr("explode(array('all', lang))")), "quality", "yhat", by="g"),
    name="mean_cube_rollup",
    sql=mean_sql(by="g", source=DOCS.replace("d AS (", "d0 AS (") + ", d AS (SELECT *, lang AS g FROM d0 UNION ALL SELECT *, 'all' AS g FROM d0)"),
)
CLASSICAL = mean_sql(by="lang", lam="0", table="d", columns="estimate, se, lower, upper").replace(", N_::BIGINT AS n_unlabeled", "")
query(lambda s, d: mean.classical_mean_ci(docs(s, d), "quality", by="lang"), name="classical_mean_ci", sql=CLASSICAL)
query(
    lambda s, d: experiment.imputed_mean_ci(docs(s, d), "yhat", 0.5),
    name="imputation_mean_ci",
    sql=f"WITH {DOCS}, e AS (SELECT count(*) AS n, avg((f > 0.5)::INTEGER) AS estimate, stddev_pop((f > 0.5)::INTEGER) / sqrt(count(*)) AS se FROM d), o AS (SELECT *, estimate - {Z} * se AS lower, estimate + {Z} * se AS upper FROM e) SELECT n, {rounded('estimate, se, lower, upper')} FROM o",
)


def grid_sql(pick: str, f="fp", y="price", w="1.0", models: str | None = None, exact=False) -> str:
    """SQL of a rectified quantile on the 5000-point grid, or on all values."""
    cross_u = f"SELECT unnest({models}) AS v, w / len({models}) AS u, 0.0 AS p FROM d WHERE {y} IS NULL UNION ALL SELECT list_avg({models}), 0.0, w FROM d WHERE {y} IS NULL" if models else f"SELECT {f} AS v, w AS u, w AS p FROM d WHERE {y} IS NULL"
    grid = "SELECT DISTINCT v AS grid FROM ev" if exact else "SELECT CASE WHEN i = 4999 THEN hi ELSE lo + i * ((hi - lo) / 4999) END AS grid FROM ends, range(5000) r(i)"
    return f"""WITH {ORDERS.replace("1.0::DOUBLE AS w", f"({w})::DOUBLE AS w")}, ev AS (
  SELECT {y} AS v, w AS a, 0.0 AS b, w * w AS q, 0.0 AS u, 0.0 AS p, 0.0 AS p2 FROM d WHERE {y} IS NOT NULL
  UNION ALL SELECT {f}, 0.0, w, w * w, 0.0, 0.0, 0.0 FROM d WHERE {y} IS NOT NULL
  UNION ALL SELECT greatest({y}, {f}), 0.0, 0.0, -2 * w * w, 0.0, 0.0, 0.0 FROM d WHERE {y} IS NOT NULL
  UNION ALL SELECT v, 0.0, 0.0, 0.0, u, p, p * p FROM ({cross_u})
), ends AS (
  SELECT min(v) AS lo, max(v) AS hi FROM ev
), g AS (
  {grid}
), s AS (
  SELECT v, sum(a) OVER t AS a, sum(b) OVER t AS b, sum(q) OVER t AS q, sum(u) OVER t AS u, sum(p) OVER t AS p, sum(p2) OVER t AS p2
  FROM (SELECT v, sum(a) AS a, sum(b) AS b, sum(q) AS q, sum(u) AS u, sum(p) AS p, sum(p2) AS p2 FROM ev GROUP BY v) WINDOW t AS (ORDER BY v)
), z AS (
  SELECT count({y}) AS n, count(*) - count({y}) AS m, sum(w) FILTER ({y} IS NOT NULL) AS wl, sum(w) FILTER ({y} IS NULL) AS wu FROM d
), c AS (
  SELECT grid, n, m, u / wu + (a - b) / wl AS cdf, greatest(1e-16, sqrt(greatest(0, n / (wl * wl) * q - ((a - b) / wl) ** 2) / n + greatest(0, p2 * m / (wu * wu) - (p / wu) ** 2) / m)) AS se
  FROM g ASOF JOIN s ON g.grid >= s.v, z
)
SELECT max(n)::BIGINT AS n, max(m)::BIGINT AS n_unlabeled, {pick} FROM c"""


POINT = "round(arg_min(grid, (round(abs(cdf - {q}), 12), grid)), 5) + 0.0 AS estimate"
RANGE = f"round(min(grid) FILTER (abs((cdf - {{q}}) / se) < {Z}), 5) + 0.0 AS lower, round(max(grid) FILTER (abs((cdf - {{q}}) / se) < {Z}), 5) + 0.0 AS upper"
query(lambda s, d: quantile.quantile_estimate(orders(s, d), "price", "yhat_price", 0.5), name="rectified_quantile_point", sql=grid_sql(POINT.format(q=0.5)))
query(lambda s, d: quantile.quantile_ci(orders(s, d), "price", "yhat_price", 0.75), name="rectified_quantile_ci", sql=grid_sql(RANGE.format(q=0.75)))
query(lambda s, d: quantile.quantile_ci(orders(s, d), "price", "yhat_price", 0.25, w=F.col("o") % 3 + 1), name="rectified_quantile_weighted", sql=grid_sql(RANGE.format(q=0.25), w="o % 3 + 1"))
MODELS = "[fp * 0.9, fp * 1.1, fp + 1]"
models = lambda: F.array(F.col("yhat_price") * 0.9, F.col("yhat_price") * 1.1, F.col("yhat_price") + 1)
query(lambda s, d: quantile.quantile_estimate(orders(s, d), "price", "yhat_price", 0.5, models=models()), name="crossfit_quantile_point", sql=grid_sql(POINT.format(q=0.5), models=MODELS))
query(lambda s, d: quantile.quantile_ci(orders(s, d), "price", "yhat_price", 0.5, models=models()), name="crossfit_quantile_ci", sql=grid_sql(RANGE.format(q=0.5), models=MODELS))
query(lambda s, d: quantile.quantile_estimate(orders(s, d), "price", "yhat_price", 0.5, exact_grid=True), name="rectified_quantile_exact", sql=grid_sql(POINT.format(q=0.5), exact=True))
query(lambda s, d: quantile.quantile_ci(orders(s, d), "price", "yhat_price", 0.5, exact_grid=True), name="rectified_quantile_exact_ci", sql=grid_sql(RANGE.format(q=0.5), exact=True))
query(
    lambda s, d: quantile.classical_quantile_ci(orders(s, d), "price", 0.5),
    name="classical_quantile_ci",
    sql=f"WITH {ORDERS}, r AS (SELECT price, row_number() OVER (ORDER BY price) - 1 AS k, count(*) OVER () AS n FROM d WHERE price IS NOT NULL) SELECT max(n)::BIGINT AS n, round(min(price) FILTER (k = trunc(n * 0.5 - {Z} * sqrt(n * 0.25))::BIGINT), 5) + 0.0 AS lower, round(min(price) FILTER (k = trunc(n * 0.5 + {Z} * sqrt(n * 0.25))::BIGINT), 5) + 0.0 AS upper FROM r",
)
query(
    lambda s, d: quantile.conformal_mean_ci(orders(s, d), "price", "yhat_price", bonferroni=False),
    name="conformal_mean_ci",
    sql=f"WITH {ORDERS}, r AS (SELECT abs(price - fp) AS e, row_number() OVER (ORDER BY abs(price - fp)) - 1 AS k, count(*) OVER () AS n FROM d WHERE price IS NOT NULL), h AS (SELECT max(n) AS n, min(e) FILTER (k = ceil(0.9 * (1 + 1 / n) * (n - 1))) AS q FROM r), o AS (SELECT n, q, (SELECT count(*) FROM d WHERE price IS NULL) AS m, (SELECT avg(fp) FROM d WHERE price IS NULL) AS estimate FROM h) SELECT n::BIGINT AS n, m::BIGINT AS n_unlabeled, round(estimate, 5) + 0.0 AS estimate, round(estimate - q, 5) + 0.0 AS lower, round(estimate + q, 5) + 0.0 AS upper FROM o",
)
query(
    lambda s, d: quantile.discrete_distribution(load(s, d, "embeddings"), "label"),
    name="discrete_distribution",
    sql="SELECT label AS value, round(count(*) / sum(count(*)) OVER (), 5) + 0.0 AS frequency FROM embeddings GROUP BY label",
)


def regression_sql(kind: str, x1: str, x2: str, y: str, f: str, source: str, lam: str | None = None, fu: str | None = None, cross_fit=False, classical=False, w="1.0", model_based=False, pick: str | None = None) -> str:
    """SQL of a regression on two covariates: least squares in closed form, logistic and Poisson by unrolled Newton steps.

    See operators.linear, operators.glm and operators.rectify. lam None is tuned, at the estimate of 1 and again.
    """
    mu = {"ols": "e", "logistic": "1 / (1 + exp(-e))", "poisson": "exp(e)"}[kind]
    v = {"ols": "1.0", "logistic": "mu * (1 - mu)", "poisson": "mu"}[kind]
    out = [f"""{source}, s AS (
  SELECT count({y})::DOUBLE AS n, (count(*) - count({y}))::DOUBLE AS m, sum({w}) FILTER ({y} IS NOT NULL) AS wl, sum({w}) FILTER ({y} IS NULL) AS wu FROM d
), r AS (
  SELECT {y} IS NOT NULL AS l, ({x1})::DOUBLE AS x1, ({x2})::DOUBLE AS x2, {y} AS y, CASE WHEN {y} IS NULL THEN {fu or f} ELSE {f} END AS f, n, m, CASE WHEN {y} IS NULL THEN ({w}) * m / wu ELSE ({w}) * n / wl END AS a
  FROM d, s {f'WHERE {y} IS NOT NULL' if classical else ''}
)"""]
    inverse = lambda p: f"{p}22 / ({p}11 * {p}22 - {p}12 * {p}12) AS i11, -{p}12 / ({p}11 * {p}22 - {p}12 * {p}12) AS i12, {p}11 / ({p}11 * {p}22 - {p}12 * {p}12) AS i22"

    def fit(name: str, lam: str) -> None:
        """CTE name(t1, t2, lam)."""
        if kind == "ols":
            sums = ", ".join(f"sum(a * {c}) FILTER ({'l' if k == 'l' else 'NOT l'}) AS {k}{n}" for k in "lu" for n, c in (("11", "x1 * x1"), ("12", "x1 * x2"), ("22", "x2 * x2"), ("1", "x1 * (y - lam * f)" if k == "l" else "x1 * lam * f"), ("2", "x2 * (y - lam * f)" if k == "l" else "x2 * lam * f")))
            half = lambda k: (f"coalesce(({k}22 * {k}1 - {k}12 * {k}2) / ({k}11 * {k}22 - {k}12 * {k}12), 0)", f"coalesce(({k}11 * {k}2 - {k}12 * {k}1) / ({k}11 * {k}22 - {k}12 * {k}12), 0)")
            out.append(f"{name} AS (SELECT {half('l')[0]} + {half('u')[0]} AS t1, {half('l')[1]} + {half('u')[1]} AS t2, lam FROM (SELECT {sums}, max(lam) AS lam FROM r, (SELECT {lam} AS lam)))")
            return
        out.append(f"{name}_0 AS (SELECT 0.0::DOUBLE AS t1, 0.0::DOUBLE AS t2, ({lam})::DOUBLE AS lam)")
        steps = 18 if kind == "poisson" else 9
        for k in range(steps):
            c = "CASE WHEN l THEN (1 - lam) / n ELSE lam / m END"
            rest = "CASE WHEN l THEN (lam * f - y) / n ELSE -lam * f / m END"
            sums = f"sum(a * x1 * ({c} * mu + {rest})) AS g1, sum(a * x2 * ({c} * mu + {rest})) AS g2, sum(a * x1 * x1 * v * {c}) AS h11, sum(a * x1 * x2 * v * {c}) AS h12, sum(a * x2 * x2 * v * {c}) AS h22"
            out.append(f"{name}_{k + 1} AS (SELECT t1 - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS t1, t2 - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS t2, lam FROM (SELECT {sums}, max(t1) AS t1, max(t2) AS t2, max(lam) AS lam FROM (SELECT *, {v} AS v FROM (SELECT *, {mu} AS mu FROM (SELECT *, x1 * t1 + x2 * t2 AS e FROM r, {name}_{k})))))")
        out.append(f"{name} AS (SELECT * FROM {name}_{steps})")

    def stats(name: str, at: str) -> None:
        """CTE name: the inverse curvature i, and covariances of gradients: gg, gf (symmetric sum), ff on labelled rows, uu on others, pp pooled."""
        g = "f - y" if cross_fit else "mu - y"
        out.append(f"{name}_r AS MATERIALIZED (SELECT l, n, m, lam, t1, t2, a * x1 * ({g}) AS g1, a * x2 * ({g}) AS g2, a * x1 * (mu - f) AS f1, a * x2 * (mu - f) AS f2, a * x1 * x1 * v AS h11, a * x1 * x2 * v AS h12, a * x2 * x2 * v AS h22 FROM (SELECT *, {v} AS v FROM (SELECT *, {mu} AS mu FROM (SELECT *, x1 * t1 + x2 * t2 AS e FROM r, {at}))))")
        cov = ", ".join(
            [f"covar_pop(g{i}, g{j}) AS gg{i}{j}, covar_pop(f{i}, f{j}) FILTER (l) AS ff{i}{j}, covar_pop(f{i}, f{j}) FILTER (NOT l) AS uu{i}{j}, covar_samp(f{i}, f{j}) AS pp{i}{j}, covar_pop(g{i}, f{j}) + covar_pop(g{j}, f{i}) AS gf{i}{j}" for i, j in ((1, 1), (1, 2), (2, 2))]
        )
        every = "count(*)" if not classical and lam != "0" else "count(*) FILTER (l)"
        some = "" if not classical and lam != "0" else " FILTER (l)"
        out.append(f"{name} AS (SELECT *, {inverse('h')} FROM (SELECT {cov}, sum(h11){some} / {every} AS h11, sum(h12){some} / {every} AS h12, sum(h22){some} / {every} AS h22, max(n) AS n, max(m) AS m, max(lam) AS lam, max(t1) AS t1, max(t2) AS t2 FROM {name}_r))")

    def weight(name: str) -> str:
        """The tuned weight, from CTE name."""
        trace = lambda c: f"((i11 * i11 + i12 * i12) * {c}11 + 2 * (i11 * i12 + i12 * i22) * {c}12 + (i12 * i12 + i22 * i22) * {c}22)"
        return f"(SELECT greatest(0.0, least(1.0, {trace('gf')} / (2 * (1 + n / m) * {trace('pp')}))) FROM {name})"

    if lam is None:
        fit("a1", "1.0")
        stats("b1", "a1")
        fit("a2", weight("b1"))
        stats("b2", "a2")
        fit("a3", weight("b2"))
    else:
        fit("a3", lam)
    stats("b3", "a3")
    if classical and kind == "ols":  # HC0 has no correction for the number of rows
        part = "gg{0}"
    elif cross_fit:
        part = "(gg{0} * n / (n - 1) + n / m * uu{0} * m / (m - 1))"
    else:
        part = "((gg{0} - lam * coalesce(gf{0}, 0) + lam * lam * coalesce(ff{0}, 0)) * n / (n - 1) + coalesce(n / nullif(m, 0) * lam * lam * uu{0} * m / (m - 1), 0))"
    sums = ", ".join(f"{part.format(k)} AS s{k}" for k in ("11", "12", "22"))
    rows = " UNION ALL ".join(
        f"SELECT {k - 1}::INTEGER AS coord, n::BIGINT AS n, {'0' if classical else 'm'}::BIGINT AS n_unlabeled, lam, t{k} AS estimate, {f"sqrt(i{k}{k} / n)" if model_based else f"sqrt((i{i} * i{i} * s11 + 2 * i{i} * i{j} * s12 + i{j} * i{j} * s22) / n)"} AS se FROM b" for k, i, j in ((1, "11", "12"), (2, "12", "22"))
    )
    columns = pick or f"coord, n, n_unlabeled, {rounded('lam, estimate, se, lower, upper')}"
    final = f"SELECT {columns} FROM (SELECT *, estimate - {Z} * se AS lower, estimate + {Z} * se AS upper FROM ({rows}))"
    return "WITH " + ",\n".join(out) + f",\nb AS (SELECT *, {sums} FROM b3)\n{final}"


NO_P = lambda df: df.drop("p_value", "converged")
query(lambda s, d: NO_P(linear.ols_ci(orders(s, d), ["one", "x"], "price", "yhat_price")), name="rectified_ols_ci", sql=regression_sql("ols", "1", "x", "price", "fp", ORDERS))
query(lambda s, d: NO_P(linear.ols_ci(orders(s, d), ["one", "x"], "price", "yhat_price", lam=0.0)), name="rectified_ols_lam0", sql=regression_sql("ols", "1", "x", "price", "fp", ORDERS, lam="0"))
query(lambda s, d: NO_P(linear.ols_ci(orders(s, d), ["one", "x"], "price", "yhat_price", w=F.col("o") % 3 + 1)), name="rectified_wls_ci", sql=regression_sql("ols", "1", "x", "price", "fp", ORDERS, w="o % 3 + 1"))
query(lambda s, d: linear.ols_estimate(orders(s, d), ["one", "x"], "price", "yhat_price", lam=0.5).drop("lam"), name="rectified_ols_estimate", sql=f"SELECT coord, n, n_unlabeled, estimate FROM ({regression_sql('ols', '1', 'x', 'price', 'fp', ORDERS, lam='0.5')})")
query(lambda s, d: NO_P(linear.classical_ols_ci(orders(s, d), ["one", "x"], "price")), name="classical_ols_ci", sql=regression_sql("ols", "1", "x", "price", "fp", ORDERS, lam="0", classical=True))
query(lambda s, d: NO_P(linear.cross_ols_ci(orders(s, d), ["one", "x"], "price", "yhat_price", models())), name="crossfit_ols_ci", sql=regression_sql("ols", "1", "x", "price", "fp", ORDERS, lam="1", fu=f"list_avg({MODELS})", cross_fit=True))
query(lambda s, d: NO_P(glm.glm_ci(docs(s, d), "logistic", ["one", "lx"], "quality", "yhat")), name="rectified_logistic_ci_d2", sql=regression_sql("logistic", "1", "x", "y", "f", DOCS))
query(lambda s, d: NO_P(glm.glm_ci(orders(s, d), "poisson", ["one", "x"], "items", "yhat_items")), name="rectified_poisson_ci_d2", sql=regression_sql("poisson", "1", "x", "items", "fi", ORDERS))
query(lambda s, d: glm.glm_estimate(docs(s, d), "logistic", ["one", "lx"], "quality", "yhat", lam=0.5).drop("lam", "converged"), name="rectified_logistic_estimate", sql=f"SELECT coord, n, n_unlabeled, estimate FROM ({regression_sql('logistic', '1', 'x', 'y', 'f', DOCS, lam='0.5')})")
query(lambda s, d: glm.glm_ci(docs(s, d), "logistic", ["one", "lx"], "quality", "yhat").select("coord", "p_value"), name="rectified_logistic_pval_d2", sql=regression_sql("logistic", "1", "x", "y", "f", DOCS, pick=f"coord, round({p_value_sql('abs(estimate) / se')}, {DIGITS}) + 0.0 AS p_value"))
query(lambda s, d: NO_P(glm.classical_glm_ci(docs(s, d), "logistic", ["one", "lx"], "quality")), name="classical_logistic_ci_d2", sql=regression_sql("logistic", "1", "x", "y", "f", DOCS, lam="0", classical=True))
query(lambda s, d: NO_P(glm.classical_glm_ci(orders(s, d), "poisson", ["one", "x"], "items")), name="classical_poisson_ci_d2", sql=regression_sql("poisson", "1", "x", "items", "fi", ORDERS, lam="0", classical=True))
query(lambda s, d: glm.classical_glm_ci(docs(s, d), "logistic", ["one", "lx"], "quality", model_based=True).select("coord", "estimate", "se"), name="model_based_logistic_ci", sql=regression_sql("logistic", "1", "x", "y", "f", DOCS, lam="0", classical=True, model_based=True, pick=f"coord, {rounded('estimate, se')}"))
query(
    lambda s, d: NO_P(glm.cross_glm_ci(docs(s, d), "logistic", ["one", "lx"], "quality", "yhat", F.array(F.col("yhat") * 0.9, F.col("yhat")))),
    name="crossfit_logistic_ci",
    sql=regression_sql("logistic", "1", "x", "y", "f", DOCS, lam="1", fu="f * 0.95", cross_fit=True),
)


# Classes of a table as labels, and the label of the class whose frequency is asked for.
def languages(spark, d) -> DataFrame:
    """(y, yhat): 0 for English documents and 1 for others, as labelled rows of every fourth document; yhat by a crude guess at common words."""
    text = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    guess = F.when(text.contains(" the ") & ~text.contains(" von "), 0).otherwise(1)
    other = F.when(F.col("lang") == "en", 0).otherwise(1)
    return load(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, other).alias("y"), guess.alias("yhat"))


LANGUAGES = """d AS (
  SELECT CASE WHEN doc_id % 4 = 0 THEN CASE WHEN lang = 'en' THEN 0 ELSE 1 END END AS y, CASE WHEN (' ' || lower(text) || ' ') LIKE '% the %' AND (' ' || lower(text) || ' ') NOT LIKE '% von %' THEN 0 ELSE 1 END AS f FROM documents)"""
query(
    lambda s, d: labelshift.shifted_ci(languages(s, d), "y", "yhat", 2, [0, 1]).select("n", "n_unlabeled", "estimate"),
    name="labelshift_point",
    sql=f"""WITH {LANGUAGES}, c AS (
      SELECT count(y) AS n, count(*) FILTER (y IS NULL) AS m, avg(f) FILTER (y = 0) AS a, avg(f) FILTER (y = 1) AS b, avg(f) FILTER (y IS NULL) AS q FROM d)
      SELECT n::BIGINT AS n, m::BIGINT AS n_unlabeled, round((q - a) / (b - a), 5) + 0.0 AS estimate FROM c""",
)
query(lambda s, d: labelshift.shifted_ci(languages(s, d), "y", "yhat", 2, [0, 1]), name="labelshift_counts")
query(lambda s, d: labelshift.shifted_ci(languages(s, d), "y", "yhat", 2, [0, 1], counts=False), name="labelshift_shares")

query(
    lambda s, d: cross.cross_mean_ci(docs(s, d), "quality", "yhat", F.array(F.col("yhat") * 0.9, F.col("yhat") * 1.05, F.col("yhat")), by="lang"),
    name="crossfit_mean_ci",
    sql=f"""WITH {DOCS}, e AS (
      SELECT lang, count(y) AS n, count(*) - count(y) AS m, avg(f * 2.95 / 3) FILTER (y IS NULL) + avg(y - f) AS estimate, var_pop(f * 2.95 / 3) FILTER (y IS NULL) AS vu, var_pop(y - f) AS ve FROM d GROUP BY lang
    ), o AS (SELECT *, sqrt(vu / m + ve / n) AS se FROM e), p AS (SELECT *, estimate - {Z} * se AS lower, estimate + {Z} * se AS upper FROM o)
    SELECT lang, n::BIGINT AS n, m::BIGINT AS n_unlabeled, {rounded('estimate, se, lower, upper')} FROM p""",
)


def shift_weights(spark, d) -> DataFrame:
    return experiment.covariate_shift_weights(docs(spark, d), "lang", F.col("quality").isNotNull())


SHIFT = DOCS.replace("d AS (", "d0 AS (") + """, g AS (SELECT lang, count(y) AS n, count(*) - count(y) AS m FROM d0 GROUP BY lang), gs AS (SELECT sum(n) AS tn, sum(m) AS tm FROM g),
  d AS (SELECT d0.* EXCLUDE (w), CASE WHEN y IS NULL THEN 1.0 ELSE (g.m / gs.tm) / (g.n / gs.tn) END::DOUBLE AS w FROM d0 JOIN g USING (lang), gs)"""
query(lambda s, d: mean.mean_ci(shift_weights(s, d), "quality", "yhat", w="weight"), name="covshift_mean_ci", sql=mean_sql(w="w", source=SHIFT))
query(lambda s, d: NO_P(linear.ols_ci(shift_weights(s, d), ["one", "lx"], "quality", "yhat", w="weight")), name="covshift_ols_ci", sql=regression_sql("ols", "1", "x", "y", "f", SHIFT, w="w"))
query(
    lambda s, d: docs(s, d).select("doc_id", experiment.inverse_probability(F.col("quality").isNotNull(), F.lit(0.4)).alias("w")),
    name="ipw_weights",
    sql=f"WITH {DOCS} SELECT doc_id, round(CASE WHEN y IS NOT NULL THEN 1 / 0.4 ELSE 1 / 0.6 END, 5) + 0.0 AS w FROM d",
)
query(
    lambda s, d: experiment.quantile_bins(orders(s, d), "x", 4).groupBy("bin").agg(F.count(F.lit(1)).alias("n")),
    name="quartile_bins",
    sql=f"WITH {ORDERS}, c AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM d) SELECT ((x >= a)::INTEGER + (x >= b)::INTEGER + (x >= c)::INTEGER) AS bin, count(*) AS n FROM d, c GROUP BY 1",
)
query(
    lambda s, d: baselines.odds_ratio(mean.mean_ci(docs(s, d), "quality", "yhat", by=(F.col("lang") == "en").alias("en"), alpha=0.05).withColumnRenamed("by0", "en"), "en"),
    name="odds_ratio_ci",
    sql=f"""WITH m AS ({mean_sql(by='g', z=z_of(0.05), source=DOCS.replace('d AS (', 'd0 AS (') + ", d AS (SELECT *, lang = 'en' AS g FROM d0)").replace("round(", "identity_(").replace(f", {DIGITS}) + 0.0", ")").replace("identity_(", "(")}), o AS (
      SELECT g, greatest(0.0, least(1.0, estimate)) AS e, greatest(0.0, least(1.0, lower)) AS l, greatest(0.0, least(1.0, upper)) AS u FROM m
    ) SELECT round(a.e / nullif(1 - a.e, 0) / (b.e / nullif(1 - b.e, 0)), 5) + 0.0 AS estimate, round(a.l / nullif(1 - a.l, 0) / (b.u / nullif(1 - b.u, 0)), 5) + 0.0 AS lower, round(a.u / nullif(1 - a.u, 0) / (b.l / nullif(1 - b.l, 0)), 5) + 0.0 AS upper
    FROM o a JOIN o b ON a.g AND NOT b.g""",
)
query(
    lambda s, d: mean.mean_ci(docs(s, d), "quality", "yhat", by="lang")
    .select("lang", (F.col("upper") - F.col("lower")).alias("a"))
    .join(mean.mean_ci(docs(s, d), "quality", "yhat", by="lang", lam=0.0).select("lang", (F.col("upper") - F.col("lower")).alias("b")), "lang")
    .where("a > 0")
    .select("lang", experiment.effective_ratio(F.col("a"), F.col("b")).alias("ratio")),
    name="effective_n_ratio",
    sql=f"SELECT lang, round((b / a) ** 2, 5) + 0.0 AS ratio FROM (SELECT lang, upper - lower AS a FROM ({mean_sql(by='lang', columns=':lower, :upper')})) JOIN (SELECT lang, upper - lower AS b FROM ({mean_sql(by='lang', lam='0', columns=':lower, :upper')})) USING (lang) WHERE a > 0",
)


def plan_sql(rho: str, budget: float | None, size: float | None, cx: float, cy: float, cf: float, source: str = "") -> str:
    """SQL of a plan without n_max; rounding is half to even."""
    gamma = f"({cf} + {cx}) / {cy}::DOUBLE"
    start = f"{budget} / each" if budget else f"{size}::DOUBLE"
    return f"""WITH {source} p AS (SELECT {rho} AS rho), c AS (
      SELECT rho, rho * rho AS r, {gamma} AS g, {cy} * (1 - rho * rho + {gamma} * rho * rho + 2 * sqrt({gamma} * rho * rho * (1 - rho * rho))) AS each, ({cx} + {cy})::DOUBLE AS one FROM p
    ), s AS (SELECT *, {start} AS n0 FROM c), n AS (SELECT *, n0 * (1 - r + sqrt(g * r * (1 - r))) AS nx FROM s), k AS (
      SELECT *, round_even(nx, 0) AS n, CASE WHEN r = 0 THEN 0 ELSE round_even(nx * (n0 - nx) / (nx - (1 - r) * n0), 0) END AS m FROM n
    ), b AS (SELECT *, one < each OR m < 0 AS alone, round_even({f"{budget} / one" if budget else "n0"}, 0) AS a FROM k)
    SELECT CASE WHEN alone THEN a ELSE n END::BIGINT AS n, CASE WHEN alone THEN 0 ELSE m END::BIGINT AS n_unlabeled, round(CASE WHEN alone THEN a * one ELSE n * {cy} + (n + m) * ({cf} + {cx}) END, 5) + 0.0 AS cost,
           CASE WHEN alone THEN a ELSE round_even(n * (n + m) / (n + (1 - r) * m), 0) END::BIGINT AS effective_n, round(rho, 5) + 0.0 AS correlation FROM b"""


#: The correlation of a label's and its prediction's influence on the second coefficient of price ~ 1 + x.
INFLUENCE = ORDERS + """, r AS (
  SELECT x, price AS y, fp AS f FROM d WHERE price IS NOT NULL
), h AS (
  SELECT count(*) AS k, sum(x) AS h12, sum(x * x) AS h22, sum(y) AS b1, sum(x * y) AS b2 FROM r
), t AS (
  SELECT *, (h22 * b1 - h12 * b2) / (k * h22 - h12 * h12) AS t1, (k * b2 - h12 * b1) / (k * h22 - h12 * h12) AS t2 FROM h
), rho AS (
  SELECT max(k) AS k, corr((k * x - h12) * (t1 + x * t2 - y), (k * x - h12) * (t1 + x * t2 - f)) AS rho FROM r, t
),"""
query(lambda s, d: power.as_frame(s, power.plan(0.8, 0.0, 1.0, 0.1, budget=1000)), name="power_known_corr", sql=plan_sql("0.8::DOUBLE", 1000, None, 0, 1, 0.1))
query(lambda s, d: power.as_frame(s, power.plan(0.5, 0.1, 2.0, 0.1, effective_n=500)), name="power_cheap", sql=plan_sql("0.5::DOUBLE", None, 500, 0.1, 2, 0.1))


def limited_sql(rho: float, budget: float | None, size: float | None, cf: float, n_max: int) -> str:
    """SQL of a plan of at most n_max rows, with covariates for nothing and labels for 1."""
    free, r = plan_sql(f"{rho}::DOUBLE", budget, size, 0, 1, cf), rho * rho
    n = f"round_even({budget} / 1 - {n_max} * {cf}, 0)" if budget else f"round_even({size} * {n_max} * (1 - {r}) / ({n_max} - {r} * {size}), 0)"
    return f"""SELECT * FROM (SELECT CASE WHEN over THEN l ELSE n END::BIGINT AS n, CASE WHEN over THEN {n_max} - l ELSE n_unlabeled END::BIGINT AS n_unlabeled, CASE WHEN over THEN round(l + {n_max} * {cf}, 5) ELSE cost END AS cost,
  CASE WHEN over THEN round_even(l * {n_max} / (l + (1 - {r}) * ({n_max} - l)), 0) ELSE effective_n END::BIGINT AS effective_n, correlation FROM (SELECT *, n + n_unlabeled > {n_max} AS over, {n} AS l FROM ({free})))"""


query(
    lambda s, d: power.as_frame(s, power.plan(0.9, 0.0, 1.0, 0.1, budget=1000, n_max=2000), power.plan(0.9, 0.0, 1.0, 0.1, effective_n=1000, n_max=1500)),
    name="power_n_max",
    sql=f"{limited_sql(0.9, 1000, None, 0.1, 2000)} UNION ALL {limited_sql(0.9, None, 1000, 0.1, 1500)}",
)


def influence_sql(kind: str, y: str, f: str, source: str) -> str:
    """The correlation of a label's and its prediction's influence on the first of two coefficients, fitted to the labelled rows; at most 1 - 1 / n."""
    fits = regression_sql(kind, "1", "x", y, f, source, lam="0", classical=True).rsplit(",\nb AS (SELECT", 1)[0]
    at = lambda c: f"(i11 * i11 * {c}11 + 2 * i11 * i12 * {c}12 + i12 * i12 * {c}22)"
    return f"({fits} SELECT least({at('gf')} / 2 / sqrt({at('gg')} * {at('ff')}), 1 - 1 / n) FROM b3)"


def phi_sql(x: str) -> str:
    """The normal distribution function."""
    return f"CASE WHEN {x} >= 0 THEN 1 - {p_value_sql(f'abs({x})')} / 2 ELSE {p_value_sql(f'abs({x})')} / 2 END"


def bisected_sql(low: float, high: float, rises: str, steps: int = 60) -> str:
    """The root between low and high; rises: whether the root is above m."""
    return f"""(WITH RECURSIVE t(i, lo, hi) AS (SELECT 0, {low}::DOUBLE, {high}::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN up THEN m ELSE lo END, CASE WHEN up THEN hi ELSE m END FROM (SELECT i, lo, hi, m, {rises} AS up FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m FROM t WHERE i < {steps}))) SELECT lo FROM t WHERE i = {steps})"""


def binomial_root_sql(k: int, n: int, level: float) -> str:
    """The chance of success with which k or fewer of n have the probability `level`."""
    cdf = f"list_sum(list_transform(range({k + 1}), lambda x: exp(lgamma({n + 1}) - lgamma(x + 1) - lgamma({n + 1} - x) + x * ln(m) + ({n} - x) * ln(1 - m))))"
    return bisected_sql(0.0, 1.0, f"{cdf} > {level}")


def effect_sql(effect: float, sd: float, power: float) -> str:
    z = z_of(0.05)
    return f"ceil(({bisected_sql(0.0, 50.0, f'({phi_sql(f"(m - {z})")}) + ({phi_sql(f"(-m - {z})")}) < {power}')} * {sd} / {effect}) ** 2)::BIGINT"


ERRORS = f"""SELECT round(sqrt(2 / 1000 * ln(2 / 0.1)), 5) + 0.0 AS dkw, round({binomial_root_sql(30, 100, 0.95)}, 5) + 0.0 AS low, round({binomial_root_sql(30, 100, 0.05)}, 5) + 0.0 AS high,
  round(greatest({", ".join(f"abs({binomial_root_sql(k, 100, level)} - {m})" for k, m in ((30, 0.3), (70, 0.7)) for level in (0.025, 0.975))}), 5) + 0.0 AS worst"""
query(
    lambda s, d: power.mean_power(docs(s, d), "quality", "yhat", 1.0, 0.05, budget=500),
    name="power_mean",
    sql=plan_sql("(SELECT least(corr(y, f), 1 - 1 / count(y)) FROM d WHERE y IS NOT NULL)", 500, None, 0, 1, 0.05, source=DOCS + ","),
)
query(lambda s, d: power.ols_power(orders(s, d), ["one", "x"], "price", "yhat_price", 0.0, 1.0, 0.1, 1, budget=200), name="power_ols", sql=plan_sql("(SELECT least(rho, 1 - 1 / k) FROM rho)", 200, None, 0, 1, 0.1, source=INFLUENCE))
query(lambda s, d: power.glm_power(docs(s, d), "logistic", ["one", "lx"], "quality", "yhat", 0.0, 1.0, 0.1, 0, budget=200), name="power_logistic", sql=plan_sql(influence_sql("logistic", "y", "f", DOCS), 200, None, 0, 1, 0.1))
query(lambda s, d: power.glm_power(orders(s, d), "poisson", ["one", "x"], "items", "yhat_items", 0.0, 1.0, 0.1, 0, budget=200), name="power_poisson", sql=plan_sql(influence_sql("poisson", "items", "fi", ORDERS), 200, None, 0, 1, 0.1))
query(lambda s, d: s.createDataFrame([(power.size_for_effect(0.05, 0.5), power.size_for_effect(0.1, 0.5, 0.9))], "a long, b long"), name="size_for_effect", sql=f"SELECT {effect_sql(0.05, 0.5, 0.8)} AS a, {effect_sql(0.1, 0.5, 0.9)} AS b")
query(lambda s, d: s.createDataFrame([(dkw_error(1000, 0.1), *map(float, binomial_bounds(100, 0.1, 0.3)), float(max_binomial_error(100, 2, 0.1, [0.3, 0.7])))], "dkw double, low double, high double, worst double"), name="binomial_errors", sql=ERRORS)


def replicates_sql(source: str, key: str, columns: str, n: int, tuning: int = 0, where: str = "true", whole: bool = True) -> str:
    """CTEs up to w(b, columns, w): each row's weight in each replicate; see operators.resample."""
    prime, first = resample.PRIME, 0 if whole else 1
    ids = f"SELECT unnest(range({first}, {n + 1})) AS b" + (f" UNION ALL SELECT {resample.TUNING} + unnest(range({tuning}))" if tuning else "")
    rounds = "".join(f", k{i + 1} AS (SELECT b, j, (x * x % {prime} * 48271 + 12345) % {prime} AS x FROM k{i})" for i in range(3))
    poly = "a0"
    for j in (1, 2, 3):
        poly = f"({poly} * k + a{j}) % {prime}"
    return f"""WITH {source}, ids AS ({ids}), k0 AS (SELECT b, j, (4 * b + j + 1) % {prime} AS x FROM ids, range(4) t(j)){rounds},
  c AS (SELECT b, {", ".join(f"max(x) FILTER (j = {j}) AS a{j}" for j in range(4))} FROM k3 GROUP BY b),
  w AS (SELECT b, {columns}, CASE WHEN b = 0 THEN 1 ELSE {" + ".join(f"(h >= {t})::INTEGER" for t in resample.LIMITS)} END AS w FROM (SELECT b, {columns}, {poly} AS h FROM (SELECT ({key})::BIGINT % {prime} AS k, {columns} FROM d WHERE {where}), c))"""


def bootstrap_sql(replicated: str, parts: str, n: int, alpha: float = 0.1, method: str = "percentile", lam: str | None = None) -> str:
    """SQL of a rectified bootstrap; parts: the estimates yl, fl and fu of a group of w."""
    tuned = lam or f"(SELECT covar_samp(yl, fl) / (var_pop(fl) + var_pop(fu)) FROM e WHERE b >= {resample.TUNING})"
    low, high = f"quantile_cont(v, {alpha / 2}) FILTER (b BETWEEN 1 AND {n})", f"quantile_cont(v, {1 - alpha / 2}) FILTER (b BETWEEN 1 AND {n})"
    whole = "max(v) FILTER (b = 0)"
    if method == "basic":
        low, high = f"2 * {whole} - {high}", f"2 * {whole} - {low}"
    return f"""{replicated}, e AS (SELECT b, {parts} FROM w GROUP BY b), l AS (SELECT {tuned} AS lam), v AS (SELECT b, lam, lam * fu + yl - lam * fl AS v FROM e, l),
  o AS (SELECT max(lam) AS lam, {whole} AS estimate, {low} AS lower, {high} AS upper FROM v)
SELECT 0::INTEGER AS coord, {rounded('lam, estimate, lower, upper')} FROM o"""


MEAN_PARTS = "sum(w * y) / sum(w) FILTER (y IS NOT NULL) AS yl, sum(w * f) FILTER (y IS NOT NULL) / sum(w) FILTER (y IS NOT NULL) AS fl, sum(w * f) FILTER (y IS NULL) / sum(w) FILTER (y IS NULL) AS fu"


def corr_sql(x: str, v: str, on: str) -> str:
    s = lambda e: f"sum(w * {e}) FILTER ({on})"
    n = f"sum(w) FILTER ({on})"
    return f"({n} * {s(f'{x} * {v}')} - {s(x)} * {s(v)}) / sqrt(({n} * {s(f'{x} * {x}')} - {s(x)} ** 2) * ({n} * {s(f'{v} * {v}')} - {s(v)} ** 2))"


query(lambda s, d: resample.bootstrap_ci(docs(s, d), resample.MEAN, "quality", "yhat", key="doc_id"), name="rectified_bootstrap_mean", sql=bootstrap_sql(replicates_sql(DOCS, "doc_id", "y, f", 1000, 50), MEAN_PARTS, 1000))
query(
    lambda s, d: resample.bootstrap_ci(orders(s, d), resample.CORRELATION, "price", "yhat_price", x="count", n_resamples=300, method="basic", key="o"),
    name="rectified_bootstrap_corr",
    sql=bootstrap_sql(replicates_sql(ORDERS, "o", "price, fp, k AS z", 300, 50).replace("SELECT b, price, fp, k AS z,", "SELECT b, price, fp, z,"), ", ".join(f"{corr_sql('z', v, on)} AS {name}" for v, on, name in (("price", "price IS NOT NULL", "yl"), ("fp", "price IS NOT NULL", "fl"), ("fp", "price IS NULL", "fu"))), 300, method="basic"),
)
query(
    lambda s, d: resample.classical_bootstrap_ci(docs(s, d), resample.MEAN, "quality", key="doc_id"),
    name="classical_bootstrap_mean",
    sql=bootstrap_sql(replicates_sql(DOCS, "doc_id", "y", 1000, where="y IS NOT NULL"), "sum(w * y) / sum(w) AS yl, 0 AS fl, 0 AS fu", 1000, lam="0.0::DOUBLE"),
)
query(
    lambda s, d: resample.poisson_mean_ci(docs(s, d), "quality", "yhat", "doc_id"),
    name="poisson_bootstrap_mean",
    sql=f"{replicates_sql(DOCS, 'doc_id', 'y, f', 200, whole=False)}, v AS (SELECT fu + yl - fl AS v FROM (SELECT b, {MEAN_PARTS} FROM w GROUP BY b)), o AS (SELECT avg(v) AS estimate, quantile_cont(v, 0.05) AS lower, quantile_cont(v, 0.95) AS upper FROM v) SELECT {rounded('estimate, lower, upper')} FROM o",
)


def ptd_linear_sql(n: int, alpha: float = 0.05) -> str:
    """SQL of predict-then-debias for y ~ 1 + x, where x is imputed as its whole part, tuned by coordinate."""

    def fit(name: str, v: str, x: str, on: str) -> str:
        s = lambda e: f"sum(w * {e}) FILTER ({on})"
        det = f"({s('1')} * {s(f'{x} * {x}')} - {s(x)} ** 2)"
        return f"({s(f'{x} * {x}')} * {s(v)} - {s(x)} * {s(f'{x} * {v}')}) / {det} AS {name}0, ({s('1')} * {s(f'{x} * {v}')} - {s(x)} * {s(v)}) / {det} AS {name}1"

    fits = ", ".join(fit(*p) for p in (("a", "y", "x", "y IS NOT NULL"), ("p", "f", "floor(x)", "y IS NOT NULL"), ("u", "f", "floor(x)", "y IS NULL")))
    rows = " UNION ALL ".join(
        f"""SELECT {k}::INTEGER AS coord, max(t) AS tuning, max(v) FILTER (b = 0) AS estimate, quantile_cont(v, {alpha / 2}) FILTER (b > 0) AS lower, quantile_cont(v, {1 - alpha / 2}) FILTER (b > 0) AS upper
  FROM (SELECT b, t, t * u{k} + a{k} - t * p{k} AS v FROM e, (SELECT covar_samp(a{k}, p{k}) / (var_samp(p{k}) + var_samp(u{k})) AS t FROM e WHERE b > 0))"""
        for k in (0, 1)
    )
    return f"{replicates_sql(DOCS, 'doc_id', 'y, f, x', n)}, e AS (SELECT b, {fits} FROM w GROUP BY b), o AS ({rows}) SELECT coord, {rounded('tuning, estimate, lower, upper')} FROM o"


query(lambda s, d: ptd.ptd_linear(docs(s, d).withColumn("imputed", F.floor("lx")), ["one", "lx"], ["one", "imputed"], "quality", "yhat", n_resamples=200, key="doc_id"), name="ptd_linear", sql=ptd_linear_sql(200))
query(lambda s, d: ptd.ptd_logistic(docs(s, d), ["one", "lx"], ["one", "lx"], "quality", "yhat", n_resamples=100, tuning="optimal", key="doc_id"), name="ptd_logistic")
query(lambda s, d: ptd.ptd_quantile(orders(s, d), 0.5, "price", "yhat_price", n_resamples=200, key="o"), name="ptd_quantile")
SEMISUPERVISED = f"""WITH {ORDERS}, l AS (SELECT x, price AS y, row_number() OVER (ORDER BY o) - 1 AS r, count(*) OVER () AS n FROM d WHERE price IS NOT NULL), u AS (
  SELECT x, x - avg(x) OVER () AS c, row_number() OVER (ORDER BY o) - 1 AS r FROM d WHERE price IS NULL
), f AS (SELECT *, r // (n // 5) AS fold FROM l), b AS (
  SELECT j, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM f, range(5) t(j) WHERE fold <> j GROUP BY j
), t AS (SELECT avg(x) AS mx, var_pop(x) AS vx, count(*) AS m FROM u), p AS (
  SELECT f.y, fold, coalesce(b0 + b1 * f.x, 0) AS fitted, coalesce(f.y - b1 * c, 0) AS rest, b1 * c AS along FROM f LEFT JOIN b ON j = fold LEFT JOIN u ON u.r = f.r AND fold < 5
), e AS (SELECT (SELECT avg(b0 + b1 * mx) FROM b, t) + avg(y - fitted) AS estimate, count(*) AS n FROM p), s AS (
  SELECT avg(b1 * b1 * vx + 2 * both_ - 2 * a * estimate) AS s FROM (SELECT fold, avg(along) AS a, avg(along * rest) AS both_ FROM p WHERE fold < 5 GROUP BY fold) JOIN b ON j = fold, t, e
), o AS (SELECT n, m, estimate, sqrt(((SELECT avg((rest - estimate) ** 2) FROM p, e) + n / m * s) / n) AS se FROM e, s, t)
SELECT n::BIGINT AS n, m::BIGINT AS n_unlabeled, round(estimate, 5) + 0.0 AS estimate, round(se, 5) + 0.0 AS se, round(estimate - {Z} * se, 5) + 0.0 AS lower, round(estimate + {Z} * se, 5) + 0.0 AS upper FROM o"""
query(lambda s, d: baselines.semisupervised_mean_ci(orders(s, d), ["x"], "price", 5, "o"), name="semisupervised_mean", sql=SEMISUPERVISED)
query(lambda s, d: baselines.postprediction_ols_ci(orders(s, d), ["one", "x"], "price", "yhat_price", "o"), name="postprediction_ols")
query(lambda s, d: NO_P(linear.classical_ols_ci(orders(s, d), ["one", "x"], "price", w=F.col("o") % 3 + 1)), name="classical_wls_ci", sql=regression_sql("ols", "1", "x", "price", "fp", ORDERS, lam="0", classical=True, w="o % 3 + 1"))
query(lambda s, d: baselines.maritz_jarrett_ci(orders(s, d), "price", 0.5), name="maritz_jarrett_ci")


def hashed_sql(trials: int) -> str:
    """CTEs up to h(key, b, h, columns of d): the cubic polynomials of resample.hashes(), seed 0; b 0 is that of weighted_sample, others are trials."""
    prime, poly = resample.PRIME, "a0"
    rounds = "".join(f", k{i + 1} AS (SELECT b, j, (x * x % {prime} * 48271 + 12345) % {prime} AS x FROM k{i})" for i in range(3))
    for j in (1, 2, 3):
        poly = f"({poly} * (doc_id::BIGINT % {prime}) + a{j}) % {prime}"
    return f"""{DOCS}, k0 AS (SELECT b, j, (4 * b + j + 1) % {prime} AS x FROM range({trials + 1}) r(b), range(4) t(j)){rounds},
  c AS (SELECT b, {", ".join(f"max(x) FILTER (j = {j}) AS a{j}" for j in range(4))} FROM k3 GROUP BY b), h AS (SELECT d.*, b, {poly} AS h FROM d, c)"""


def trials_sql(lam: str) -> str:
    """SQL of trial_grid with sizes 50 and 100 in 20 trials, at a weight."""
    split = f"""{hashed_sql(20)}, p AS (
    SELECT (b - 1)::INTEGER AS trial, y, f, row_number() OVER (PARTITION BY b ORDER BY h, doc_id) AS place FROM h WHERE y IS NOT NULL AND b > 0
  ), g AS (SELECT trial, size, CASE WHEN place <= size THEN y END AS y, f FROM p, (SELECT unnest([50, 100]) AS size))"""
    return mean_sql(by="trial, size", lam=lam, table="g", columns=":estimate, :lower, :upper", source=split).replace("FROM g d JOIN", "FROM g AS d JOIN")


GRID = " UNION ALL ".join(f"SELECT trial, size::INTEGER AS n, '{method}' AS method, estimate, lower, upper, upper - lower AS width FROM ({trials_sql(lam)})" for method, lam in (("rectified", "tuned"), ("classical", "0")))
query(lambda s, d: experiment.weighted_sample(docs(s, d), 50, "n_chars", "doc_id").select("doc_id", "n_chars"), name="weighted_sample", sql=f"WITH {hashed_sql(0)} SELECT doc_id, n_chars FROM h ORDER BY -ln((h + 0.5) / {float(resample.PRIME)}) / n_chars, doc_id LIMIT 50")
query(lambda s, d: experiment.trial_grid(docs(s, d), "quality", "yhat", "doc_id", [50, 100], 20), name="trial_grid", sql=f"SELECT trial, n, method, {rounded('estimate, lower, upper, width')} FROM ({GRID})")
query(lambda s, d: experiment.width_summary(experiment.trial_grid(docs(s, d), "quality", "yhat", "doc_id", [50, 100], 20)), name="width_summary", sql=f"SELECT method, n, round(avg(width), 5) + 0.0 AS width, count(*) AS trials FROM ({GRID}) GROUP BY method, n")
query(lambda s, d: experiment.rejection_search(docs(s, d), "quality", "yhat", "doc_id", 0.7, 0.8, [25, 50, 100, 200], 20), name="power_search")


def streamed(spark, d) -> DataFrame:
    """The rectified mean price of order lines that arrive as a stream, every tenth order's being known."""
    lines = load(spark, d, "lineitem")
    known = F.when(F.col("l_orderkey") % 10 == 0, F.col("l_extendedprice") / 10000)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/lineitem.parque[t]")  # a pattern may be a file or a folder
    mean_ = StreamingMean("y", "yhat")
    rows = stream.select(known.alias("y"), (F.col("l_quantity") * 0.148).alias("yhat"))
    checkpoint = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.writeStream.foreachBatch(mean_.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    estimate, se, lam = mean_.estimate()
    return spark.createDataFrame([(int(mean_.total["n"]), int(mean_.total["big"]), lam, estimate, se)], "n long, n_unlabeled long, lam double, estimate double, se double")


LINES = "d AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN l_extendedprice / 10000 END AS y, l_quantity * 0.148 AS f FROM lineitem)"
query(streamed, name="streaming_mean", sql=f"SELECT n, n_unlabeled, {rounded('lam, estimate, se')} FROM ({mean_sql(source=LINES, columns=':lam, :estimate, :se')})")
