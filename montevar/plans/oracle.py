"""SQL (DuckDB dialect) for every registered query.

Each named query is ``WITH <needed CTEs> SELECT ...`` over the driver's tables.
The CTEs restate the definitions of ``sources.fixtures`` and the operators in
plain SQL (windows, joins, aggregates).  The numeric helper expressions
(rounding, keyed random numbers, the elimination steps) are rendered from the
same builders as the engine, through ``functions.exprs.SQL``; so they are checked by queries of their
own whose SQL does not use them: ``fit_residual`` (normal equations), ``cholesky_product`` (covariances)
and ``rounding``.
"""

from __future__ import annotations

import math

from montevar.functions.exprs import SQL, sql_stages
from montevar.functions.numeric import keyed_normal, keyed_uniform, poisson1_thresholds, poisson_thresholds, round_half_away, uniform_of
from montevar.functions.linalg import cholesky_stages
from montevar.operators.regression import ridge_stages, weight_name
from montevar.operators.risk import ci_indices
from montevar.operators.series import EPS_PRICE, HORIZON_DAYS, HORIZON_ROWS, MIN_GAP_DAYS
from montevar.plans import pipeline as pl
from montevar.sources import fixtures as fx

F4 = pl.FACTORS
_LINE_KEY = "l_returnflag || l_linestatus || '/' || l_orderkey || '/' || l_linenumber"
FEATS = pl.FEATS
DIGITS = 9


def r(x: str, places: int = DIGITS) -> str:
    return round_half_away(x, places, SQL)


def q(name: str) -> str:
    return f'"{name}"'


PERIOD = (f"l_shipdate >= TIMESTAMP '{fx.PERIOD[0]} 00:00:00' "
          f"AND l_shipdate < TIMESTAMP '{fx.PERIOD[1]} 00:00:00' + INTERVAL 1 DAY")
DAYNO = "date_diff('day', DATE '1970-01-01', {})"


def _fill(src: str, key: str, cols=("open",)) -> str:
    mean = ", ".join(f"coalesce({c}, avg({c}) OVER (PARTITION BY {key})) AS {c}" for c in cols)
    last = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY date "
                     f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in cols)
    return f"SELECT {key}, date, {mean} FROM (SELECT {key}, date, {last} FROM {src})"


def _returns(src: str, key: str) -> str:
    base = f"greatest(open0, CAST({EPS_PRICE!r} AS DOUBLE))"
    fl = round_half_away(f"((open - {base}) / {base})", 3, SQL)
    return (f"SELECT {key}, date, open, {fl} AS fluct FROM ("
            f"SELECT {key}, date, open, d - first_value(d) OVER w AS gap, first_value(open) OVER w AS open0 "
            f"FROM (SELECT *, {DAYNO.format('date')} AS d FROM {src}) "
            f"WINDOW w AS (PARTITION BY {key} ORDER BY d RANGE BETWEEN {HORIZON_DAYS} PRECEDING AND CURRENT ROW)) "
            f"WHERE gap > {MIN_GAP_DAYS} AND open IS NOT NULL AND open0 IS NOT NULL")


def _rows_returns(src: str, key: str, rows: int = HORIZON_ROWS) -> str:
    base = f"greatest(open0, CAST({EPS_PRICE!r} AS DOUBLE))"
    return (f"SELECT {key}, date, open, {round_half_away(f'((open - {base}) / {base})', 3, SQL)} AS fluct FROM ("
            f"SELECT {key}, date, open, lag(open, {rows}) OVER (PARTITION BY {key} ORDER BY date) AS open0 FROM {src}) "
            f"WHERE open0 IS NOT NULL AND open IS NOT NULL")


def _feat(f: str) -> str:
    return f"({f} + sign({f}) * {f} * {f} + sign({f}) * sqrt(abs({f})))"


def _wide(src: str, value: str, names, suffix: str) -> str:
    cols = ", ".join(f"max(CASE WHEN factor = '{f}' THEN {value} END) AS {q(f + suffix)}" for f in names)
    nn = " AND ".join(f"{q(f + suffix)} IS NOT NULL" for f in names)
    return f"SELECT * FROM (SELECT k, {cols} FROM {src} GROUP BY k) WHERE {nn}"


def _model_moments(src: str = "design") -> str:
    d = len(FEATS)
    cols = ["count(*) AS n", "avg(label) AS my"]
    cols += [f"avg({q(f)}) AS mx_{i}" for i, f in enumerate(FEATS)]
    cols += [f"covar_pop({q(FEATS[i])}, {q(FEATS[j])}) AS cxx_{i}_{j}" for i in range(d) for j in range(i, d)]
    cols += [f"covar_pop({q(f)}, label) AS cxy_{i}" for i, f in enumerate(FEATS)] + ["var_pop(label) AS vy"]
    return f"SELECT symbol, {', '.join(cols)} FROM {src} GROUP BY symbol"


def _factor_moments() -> str:
    d = len(F4)
    cols = ["count(*) AS n"] + [f"avg({q(f)}) AS {q('mean_' + f)}" for f in F4]
    cols += [f"covar_samp({q(F4[i])}, {q(F4[j])}) AS {q(f'cov_{F4[i]}_{F4[j]}')}"
             for i in range(d) for j in range(i, d)]
    return f"SELECT {', '.join(cols)} FROM aligned"


def _ridge_ctes(source: str = "model_moments", prefix: str = "ridge_", out: str = "models"):
    ctes, last = sql_stages(source, ridge_stages(FEATS, pl.RIDGE_ALPHA, SQL), prefix)
    w = ", ".join(q(weight_name(f)) for f in FEATS)
    return ctes + [f"{out} AS (SELECT symbol, n, intercept, {w} FROM {last})"]


def _chol_ctes():
    d = len(F4)

    def cov(i, j):
        i, j = min(i, j), max(i, j)
        return f"cov_{F4[i]}_{F4[j]}"

    ctes, last = sql_stages("moments", cholesky_stages(cov, d, lambda i, j: f"l_{i}_{j}", SQL), "chol_")
    keep = [q("mean_" + f) for f in F4] + [q(f"l_{i}_{j}") for i in range(d) for j in range(i + 1)]
    return ctes + [f"params AS (SELECT {', '.join(keep)} FROM {last})"]


def _scenarios() -> str:
    d = len(F4)
    zs = ", ".join(f"{keyed_normal(f'{pl.TRIAL_SEED}:{j}', 'trial_id', SQL)} AS _z{j}" for j in range(d))
    xs = []
    for i, f in enumerate(F4):
        terms = [f"p.{q('mean_' + f)}"] + [f"p.{q(f'l_{i}_{j}')} * z._z{j}" for j in range(i + 1)]
        xs.append(f"({' + '.join(terms)}) AS {q('x_' + f)}")
    return (f"SELECT z.trial_id, {', '.join(xs)} FROM (SELECT trial_id, {zs} FROM "
            f"(SELECT range AS trial_id FROM range({pl.NUM_TRIALS}))) z CROSS JOIN params p")


def _trials() -> str:
    avgs = ", ".join(f"avg({q(weight_name(f))}) AS {q(weight_name(f))}" for f in FEATS)
    ok = " AND ".join(["intercept IS NOT NULL"] + [f"{q(weight_name(f))} IS NOT NULL" for f in FEATS])
    terms = ["m.intercept"] + [f"m.{q(weight_name(feat))} * {_feat('s.' + q('x_' + f))}"
                               for f, feat in zip(F4, FEATS)]
    return (f"SELECT s.trial_id, ({' + '.join(terms)}) AS average_return FROM scenarios s CROSS JOIN "
            f"(SELECT avg(intercept) AS intercept, {avgs} FROM models WHERE {ok}) m")


def _boot() -> str:
    """Expanded resamples: every replicate x trial with its Poisson(1) multiplicity."""
    u = keyed_uniform(f"{pl.BOOT_SEED}:' || CAST(b.r AS VARCHAR) || ':", "t.trial_id", SQL)
    w = " + ".join(f"(CASE WHEN {u} > {c!r} THEN 1 ELSE 0 END)" for c in poisson1_thresholds())
    return (f"SELECT b.r AS replicate, t.trial_id, t.average_return, ({w}) AS w "
            f"FROM trials t CROSS JOIN (SELECT range AS r FROM range({pl.BOOT_NUM})) b")


def _boot_rep() -> str:
    rep = ("SELECT replicate, average_return FROM boot, LATERAL (SELECT unnest(range(CAST(w AS BIGINT)))) "
           "WHERE w > 0")
    return (f"SELECT replicate, v AS value_at_risk, m AS mean, s AS stddev, (SELECT avg(average_return) FROM ({rep}) x "
            f"WHERE x.replicate = qq.replicate AND x.average_return <= qq.v) AS conditional_var FROM "
            f"(SELECT replicate, quantile_disc(average_return, {pl.VAR_P!r}) AS v, avg(average_return) AS m, "
            f"stddev_pop(average_return) AS s FROM ({rep}) GROUP BY replicate) qq")


def _kde(src: str, col: str, by: str | None, sd: str, log: bool, points: int = 100) -> str:
    sdf = "stddev_samp" if sd == "samp" else "stddev_pop"
    g = f"{by}, " if by else ""
    stats = (f"SELECT {g}min({col}) AS mn, max({col}) AS mx, {sdf}({col}) AS sd, count({col}) AS n "
             f"FROM {src} WHERE {col} IS NOT NULL" + (f" GROUP BY {by}" if by else ""))
    on = f"ON s.{by} = d.{by}" if by else "ON TRUE"
    h = "(CAST(1.06 AS DOUBLE) * s.sd * pow(CAST(s.n AS DOUBLE), CAST(-0.2 AS DOUBLE)))"
    step = f"((s.mx - s.mn) / CAST({points} AS DOUBLE))"
    x = f"(s.mn + {step} * CAST(gj.j AS DOUBLE))"
    u = f"(({x} - d.{col}) / {h})"
    dens = f"(sum(exp(CAST(-0.5 AS DOUBLE) * {u} * {u})) / (s.n * {h} * sqrt(2 * pi())))"
    val = f"ln({dens})" if log else dens
    name = "log_density" if log else "density"
    sel_by = f"s.{by}, " if by else ""
    return (f"SELECT {sel_by}CAST(gj.j AS INTEGER) AS j, {r(x)} AS x, {r(val)} AS {name} "
            f"FROM ({stats}) s JOIN (SELECT {col}{', ' + by if by else ''} FROM {src} WHERE {col} IS NOT NULL) d {on} "
            f"CROSS JOIN (SELECT range AS j FROM range({points})) gj "
            f"GROUP BY {sel_by}gj.j, s.mn, s.mx, s.sd, s.n")


# name -> (dependencies, body)
CTES: dict[str, tuple[list[str], str]] = {
    "raw_prices": ([], "SELECT CAST(l.l_suppkey AS VARCHAR) AS symbol, l.l_suppkey AS sym_no, "
                       "CAST(l.l_shipdate AS DATE) AS date, p.p_retailprice * (1 - l.l_discount) AS open, l.l_shipdate "
                       "FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey"),
    "prices": (["raw_prices"], "SELECT symbol, date, max(open) AS open FROM raw_prices GROUP BY symbol, date"),
    "prices_period": (["raw_prices"], "SELECT symbol, date, max(open) AS open FROM raw_prices "
                                      f"WHERE {PERIOD} GROUP BY symbol, date"),
    "prices_gaps": (["raw_prices"],
                    "SELECT symbol, date, CASE WHEN (sym_no + " + DAYNO.format("date") + ") % 7 = 0 "
                    "THEN NULL ELSE open END AS open FROM (SELECT symbol, sym_no, date, max(open) AS open "
                    "FROM raw_prices GROUP BY symbol, sym_no, date)"),
    "factors": ([], "SELECT l_returnflag || l_linestatus AS factor, CAST(l_shipdate AS DATE) AS date, "
                    "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS open "
                    "FROM lineitem GROUP BY 1, 2"),
    "factor_levels": (["factors"], f"SELECT factor, date, CASE WHEN {DAYNO.format('date')} % 5 <> 0 THEN open END AS open, "
                                   f"CASE WHEN {DAYNO.format('date')} % 3 <> 0 THEN open / 2 END AS close FROM factors"),
    "filled_gaps": (["prices_gaps"], _fill("prices_gaps", "symbol")),
    "filled_period": (["prices_period"], _fill("prices_period", "symbol")),
    "returns_period": (["filled_period"], _returns("filled_period", "symbol")),
    "portfolio": (["stock_returns"], "SELECT date, avg(fluct) AS avg_return FROM stock_returns GROUP BY date"),
    "filled": (["prices"], _fill("prices", "symbol")),
    "returns_rows": (["filled"], _rows_returns("filled", "symbol")),
    "stock_returns": (["filled"], _returns("filled", "symbol")),
    "factors_filled": (["factors"], _fill("factors", "factor")),
    "factor_returns": (["factors_filled"], _returns("factors_filled", "factor")),
    "ff": (["factor_returns"],
           "SELECT factor, date, CAST(row_number() OVER (PARTITION BY factor ORDER BY date DESC) - 1 AS INTEGER) "
           f"AS k, fluct, {_feat('fluct')} AS feat FROM factor_returns"),
    "features": (["ff"], _wide("ff", "feat", F4, "_feat")),
    "sr_ranked": (["stock_returns"],
                  "SELECT symbol, date, fluct, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 "
                  "AS INTEGER) AS k FROM stock_returns"),
    "design": (["sr_ranked", "features"],
               "SELECT s.symbol, s.k, s.fluct AS label, " + ", ".join(f"f.{q(c)}" for c in FEATS) +
               " FROM sr_ranked s JOIN features f ON s.k = f.k"),
    "split": (["design"], f"SELECT *, k <= CAST({pl.TRAIN_RATIO!r} AS DECIMAL(10,6)) * max(k) OVER "
                          "(PARTITION BY symbol) AS is_train FROM design"),
    "model_moments": (["design"], _model_moments()),
    "aligned": (["factor_returns"], _wide(
        "(SELECT factor, fluct, CAST(row_number() OVER (PARTITION BY factor ORDER BY date DESC) - 1 AS INTEGER) "
        "AS k FROM factor_returns)", "fluct", F4, "")),
    "moments": (["aligned"], _factor_moments()),
}


_PX = "format('{:,.2f}', l_extendedprice)"
# The line as the columns of a refused row make it: quotes are gone, unless the line itself was damaged.
_REST = f"CASE WHEN l_returnflag = 'R' THEN '-' ELSE '' END || {_PX}"
_DAY = "CASE WHEN l_returnflag = 'R' THEN 'n/a' ELSE strftime(CAST(l_shipdate AS DATE), '%d-%b-%y') END"
_WHOLE = f"""{_DAY} || ',"' || {_PX} || '","' || {_PX} || '","' || {_REST} || '","' || {_PX} || '"'"""
_PLAIN = f"{_PX} || ',' || {_PX} || ',' || {_REST} || ',' || {_PX} || ',100'"
CTES["damaged"] = ([], (
    "SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice, "
    "CASE WHEN l_linenumber IN (6, 7) THEN 'columns' WHEN l_linenumber = 4 THEN 'no date' WHEN l_returnflag = 'R' THEN 'date' END AS reason, "
    f"CASE l_linenumber WHEN 6 THEN {_WHOLE} WHEN 7 THEN {_WHOLE} || ',100,x' WHEN 4 THEN ',' || {_PLAIN} "
    f"WHEN 5 THEN {_DAY} || ',none,' || {_PX} || ',' || {_REST} || ',' || {_PX} || ',100' ELSE {_DAY} || ',' || {_PLAIN} END AS line FROM lineitem"))
CTES["kinds"] = ([], "SELECT l_returnflag, CASE WHEN l_returnflag <> 'A' THEN l_linestatus END AS l_linestatus, l_linenumber, "
                     "strftime(CAST(l_shipdate AS DATE), '%Y-%m') AS l_shipmonth FROM lineitem")


def _resampled() -> str:
    """Every row by its number among equal ones, as often as its draw says."""
    cols = ["l_returnflag", "l_linestatus", "l_linenumber", "l_shipmonth"]
    text = " || ',' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in cols)
    u = uniform_of(f"('{pl.BOOT_SEED}:' || {text} || ':' || CAST(i AS VARCHAR))", SQL)
    w = " + ".join(f"(CASE WHEN u > {c!r} THEN 1 ELSE 0 END)" for c in poisson_thresholds(0.8))
    names = ", ".join(cols)
    return (f"SELECT {names} FROM (SELECT {names}, unnest(range(CAST({w} AS BIGINT))) AS t FROM (SELECT {names}, {u} AS u FROM "
            f"(SELECT {names}, row_number() OVER (PARTITION BY {names}) - 1 AS i FROM kinds)))")


def _add_chain(ctes, deps_first: list[str], tail_name: str):
    names = []
    for text in ctes:
        n = text.split(" AS (", 1)[0]
        body = text.split(" AS (", 1)[1][:-1]
        CTES[n] = ((names[-1:] or deps_first), body)
        names.append(n)
    return names


_ridge = _ridge_ctes()
_add_chain(_ridge, ["model_moments"], "models")
CTES["model_moments_train"] = (["split"], _model_moments("(SELECT * FROM split WHERE is_train)"))
_add_chain(_ridge_ctes("model_moments_train", "ridget_", "models_train"), ["model_moments_train"], "models_train")
_chol = _chol_ctes()
_add_chain(_chol, ["moments"], "params")
CTES["scenarios"] = (["params"], _scenarios())
CTES["trials"] = (["scenarios", "models"], _trials())
CTES["pairs"] = (["scenarios", "models"], "SELECT m.symbol, s.trial_id, m.intercept + " + " + ".join(
    f"m.{q(weight_name(feat))} * {_feat('s.' + q('x_' + f))}" for f, feat in zip(F4, FEATS)) +
    " AS r FROM scenarios s CROSS JOIN models m WHERE m.intercept IS NOT NULL")
CTES["var"] = (["trials"], f"SELECT quantile_disc(average_return, {pl.VAR_P!r}) AS value_at_risk FROM trials")
CTES["cvar"] = (["trials", "var"], "SELECT (SELECT value_at_risk FROM var) AS value_at_risk, avg(average_return) "
                                   "AS conditional_var FROM trials WHERE average_return <= (SELECT value_at_risk FROM var)")
CTES["boot"] = (["trials"], _boot())
CTES["boot_rep"] = (["boot"], _boot_rep())
_expanded = ("SELECT replicate, average_return FROM boot, LATERAL (SELECT unnest(range(CAST(w AS BIGINT)))) WHERE w > 0")
CTES["boot_median"] = (["boot"], f"SELECT quantile_disc(average_return, 0.5) AS median FROM ({_expanded}) GROUP BY replicate")
CTES["boot_semi"] = (["boot"], (
    f"SELECT x.replicate, any_value(m.m) AS mean, sqrt(sum(CASE WHEN average_return < m.m THEN (average_return - m.m) * (average_return - m.m) "
    f"ELSE 0 END) / count(*)) AS below_mean FROM ({_expanded}) x JOIN (SELECT replicate, avg(average_return) AS m FROM ({_expanded}) "
    "GROUP BY replicate) m ON x.replicate = m.replicate GROUP BY x.replicate"))
CTES["predict_test"] = (["split", "models"],
                        "SELECT s.symbol, s.k, s.label, (m.intercept + " +
                        " + ".join(f"m.{q(weight_name(f))} * s.{q(f)}" for f in FEATS) +
                        ") AS prediction FROM split s JOIN models m ON s.symbol = m.symbol WHERE NOT s.is_train")
CTES["predict_test_train"] = (["split", "models_train"],
                              "SELECT s.symbol, s.k, s.label, (m.intercept + " +
                              " + ".join(f"m.{q(weight_name(f))} * s.{q(f)}" for f in FEATS) +
                              ") AS prediction FROM split s JOIN models_train m ON s.symbol = m.symbol "
                              "WHERE NOT s.is_train")


def _r2_from(pred: str) -> str:
    return ("SELECT symbol, n, score FROM (SELECT symbol, n, CASE WHEN n < 2 THEN NULL WHEN lo = hi THEN "
            "(CASE WHEN ss_res <= n * 1e-24 * greatest(hi * hi, 1e-24) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) "
            "ELSE 1 - ss_res / ss_tot END AS score FROM (SELECT symbol, count(*) AS n, "
            "sum((label - prediction) * (label - prediction)) AS ss_res, min(label) AS lo, max(label) AS hi, "
            "var_pop(label) * count(label) AS ss_tot "
            f"FROM {pred} GROUP BY symbol)) WHERE score IS NOT NULL AND NOT isnan(score)")


CTES["r2"] = (["predict_test"], _r2_from("predict_test"))
CTES["failures"] = (["stock_returns", "var", "cvar"],
                    "SELECT m.risk_measure, CAST(sum(CASE WHEN s.total / s.cnt < 0 AND s.total / s.cnt < m.v THEN 1 "
                    "ELSE 0 END) AS BIGINT) AS failures, CAST(sum(s.cnt) AS BIGINT) AS size FROM "
                    "(SELECT symbol, sum(fluct) AS total, count(date) AS cnt FROM stock_returns GROUP BY symbol) s "
                    "CROSS JOIN (SELECT 'var' AS risk_measure, value_at_risk AS v FROM var UNION ALL "
                    "SELECT 'cvar', conditional_var FROM cvar) m GROUP BY m.risk_measure")


def with_ctes(needed: list[str], select: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + select


def _summary(src: str, col: str, by: str | None = None, places: int = DIGITS) -> str:
    g = f"{by}, " if by else ""
    s = (f"SELECT {g}count({col}) AS count, {r(f'avg({col})', places)} AS mean, "
         f"{r(f'stddev_samp({col})', places)} AS stddev, {r(f'min({col})', places)} AS min, "
         f"{r(f'max({col})', places)} AS max FROM {src}")
    return s + (f" GROUP BY {by}" if by else "")


def _kupiec(x: str, n: str, p: float) -> str:
    x, n = f"CAST({x} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    qq = f"({x} / {n})"
    xlogy = lambda a, b: f"(CASE WHEN {a} = 0 THEN CAST(0 AS DOUBLE) ELSE {a} * ln({b}) END)"
    return (f"(-2 * (({n} - {x}) * {math.log(1 - p)!r} + {x} * {math.log(p)!r} - "
            f"{xlogy(f'({n} - {x})', f'(1 - {qq})')} - {xlogy(x, qq)}))")


def _boot_ci(field: str, stat: str, source: str = "boot_rep") -> str:
    lo, hi = ci_indices(pl.BOOT_NUM, pl.BOOT_PROBABILITY)
    return (f"SELECT '{stat}' AS statistic, {r(f'max(CASE WHEN pos = {lo} THEN v END)')} AS lower, "
            f"{r(f'max(CASE WHEN pos = {hi} THEN v END)')} AS upper FROM (SELECT {field} AS v, "
            f"row_number() OVER (ORDER BY {field}) - 1 AS pos FROM {source})")


def oracle_sql() -> dict[str, str]:
    feats_sel = ", ".join(q(c) for c in FEATS)
    w_sel = ", ".join(f"{r(q(weight_name(f)))} AS {q(weight_name(f))}" for f in FEATS)
    d = len(F4)
    p = pl.VAR_P
    out = {
        # sources and parsing
        "parse_dates": (
            "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_date, "
            "CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(strptime(strftime(CAST(l_shipdate AS DATE), "
            "'%d-%b-%y'), '%d-%b-%y') AS DATE) END AS stock_date, "
            "CAST(strptime(strftime(CAST(l_shipdate AS DATE), '%b %d, %Y'), '%b %d, %Y') AS DATE) AS tsv_date, "
            "CAST(strptime(strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS csv_date "
            "FROM lineitem"),
        "parse_numbers": (
            "SELECT l_orderkey, l_linenumber, "
            "TRY_CAST(replace(format('{:,.2f}', l_extendedprice), ',', '') AS DOUBLE) AS open, "
            "CASE WHEN l_returnflag = 'R' THEN NULL ELSE "
            "TRY_CAST(replace(format('{:,.2f}', l_extendedprice), ',', '') AS DOUBLE) END AS low, "
            "TRY_CAST(l_returnflag || l_linestatus AS DOUBLE) AS junk, "
            "TRY_CAST(replace(format('{:,.2f}', l_extendedprice), ',', '') || '.5' AS DOUBLE) AS malformed FROM lineitem"),
        "drop_missing_dates": (
            "SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, "
            "TRY_CAST(replace(format('{:,.2f}', l_extendedprice), ',', '') AS DOUBLE) AS open "
            "FROM lineitem WHERE l_returnflag <> 'R'"),
        "price_lines_csv": (
            "SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_orderkey AS VARCHAR) AS l_orderkey, "
            "CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_shipdate AS DATE) AS date, "
            "l_extendedprice AS open, l_extendedprice AS high, l_extendedprice AS low, "
            "format('{:,.2f}', l_extendedprice) AS close, '100' AS volume FROM lineitem WHERE l_returnflag <> 'R'"),
        "price_line_rejects": with_ctes(["damaged"], "SELECT l_orderkey, l_linenumber, symbol, reason, line AS record FROM damaged "
                                                     "WHERE reason IS NOT NULL"),
        "price_line_good": with_ctes(["damaged"], (
            "SELECT l_orderkey, l_linenumber, symbol, date, CASE WHEN l_linenumber <> 5 THEN l_extendedprice END AS open, "
            "CASE WHEN l_linenumber = 5 THEN 'Open' ELSE '' END AS nulled FROM damaged WHERE reason IS NULL")),
        "price_line_reasons": with_ctes(["damaged"], "SELECT coalesce(reason, 'good') AS reason, count(*) AS lines FROM damaged GROUP BY 1"),
        "price_files": (
            "SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS open, "
            "l_extendedprice AS high, l_extendedprice AS low, format('{:,.2f}', l_extendedprice) AS close, '100' AS volume "
            "FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey "
            "JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag <> 'R' AND r_name = 'EUROPE'"),
        "stock_returns_stored": with_ctes(["stock_returns"], f"SELECT symbol, date, {r('open')} AS open, fluct FROM stock_returns"),
        "resample_rows": with_ctes(["kinds"], _resampled()),
        "factor_lines_tsv": (
            f"SELECT {_LINE_KEY} AS factor, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS open, l_extendedprice AS high, "
            "l_extendedprice AS low, l_extendedprice AS close, l_extendedprice AS adj_close, "
            "floor(l_extendedprice) AS volume FROM lineitem"),
        "factor_lines_csv": (
            f"SELECT {_LINE_KEY} AS factor, CAST(l_shipdate AS DATE) AS date, r AS open, CAST(l_linenumber AS DOUBLE) AS high, "
            "CASE WHEN l_linenumber <> 1 THEN r END AS low, r AS close, CAST(NULL AS DOUBLE) AS adj_close, "
            "CAST(l_quantity AS DOUBLE) * 1000 AS volume FROM (SELECT *, "
            "CAST(CAST(l_discount AS DECIMAL(4,2)) - 0.05 AS DOUBLE) AS r FROM lineitem)"),
        "rounding": (
            "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice) * (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END), 3) "
            "AS rounded FROM lineitem"),
        "period_filter": with_ctes(["raw_prices"], f"SELECT symbol, date, open FROM raw_prices WHERE {PERIOD}"),
        "dedup_prices": with_ctes(["prices"], "SELECT symbol, date, open FROM prices"),
        "factor_union": with_ctes(["factors"], (
            "SELECT factor, date, open FROM factors UNION ALL SELECT 'order-' || o_orderstatus, CAST(o_orderdate AS DATE), "
            "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM orders GROUP BY 1, 2")),
        "symbol_semi_scan": with_ctes(["prices"], (
            "SELECT symbol, date, open FROM prices WHERE symbol IN (SELECT CAST(s_suppkey AS VARCHAR) "
            "FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region rg "
            "ON n.n_regionkey = rg.r_regionkey WHERE rg.r_name = 'EUROPE')")),
        # series
        "fill_recent": with_ctes(["filled_gaps"], f"SELECT symbol, date, {r('open')} AS open FROM filled_gaps"),
        "fill_columns": with_ctes(["factor_levels"], f"SELECT factor, date, {r('open')} AS open, {r('close')} AS close FROM "
                                                     f"({_fill('factor_levels', 'factor', ('open', 'close'))})"),
        "stock_returns_period": with_ctes(["returns_period"],
                                          f"SELECT symbol, date, {r('open')} AS open, fluct FROM returns_period"),
        "stock_returns_rows": with_ctes(["returns_rows"], f"SELECT symbol, date, {r('open')} AS open, fluct FROM returns_rows"),
        "historical_var": with_ctes(["portfolio"], (
            f"SELECT {r('v')} AS value_at_risk, {r('(SELECT avg(avg_return) FROM portfolio WHERE avg_return <= v)')} "
            f"AS conditional_var FROM (SELECT quantile_disc(avg_return, {pl.VAR_P!r}) AS v FROM portfolio)")),
        # 5 % quantile of the standard normal and its density there over 5 %, from tables
        "variance_covariance_var": with_ctes(["portfolio"], (
            f"SELECT {r('avg(avg_return) - 1.6448536269514722 * stddev_samp(avg_return)')} AS value_at_risk, "
            f"{r('avg(avg_return) - 2.0627128075074257 * stddev_samp(avg_return)')} AS conditional_var FROM portfolio")),
        "stock_returns": with_ctes(["stock_returns"], f"SELECT symbol, date, {r('open')} AS open, fluct FROM stock_returns"),
        "factor_returns": with_ctes(["factor_returns"], f"SELECT factor, date, {r('open')} AS open, fluct FROM factor_returns"),
        "portfolio_daily_return": with_ctes(["stock_returns"],
                                            f"SELECT date, {r('avg(fluct)')} AS avg_return FROM stock_returns GROUP BY date"),
        "returns_summary": with_ctes(["stock_returns"], _summary(
            "(SELECT date, avg(fluct) AS avg_return FROM stock_returns GROUP BY date)", "avg_return")),
        "factor_summary": with_ctes(["factor_returns"], " UNION ALL ".join(
            _summary("factor_returns", c, "factor").replace("SELECT factor,", f"SELECT factor, '{c}' AS \"column\",")
            for c in ("open", "fluct"))),
        # features and design
        "factor_features": with_ctes(["ff"], f"SELECT factor, date, k, fluct, {r('feat')} AS feat FROM ff"),
        "feature_table": with_ctes(["features"], "SELECT k, " + ", ".join(f"{r(q(c))} AS {q(c)}" for c in FEATS)
                                   + " FROM features"),
        "min_factor_rows": with_ctes(["factor_returns"], "SELECT min(c) AS min_rows FROM "
                                     "(SELECT factor, count(*) AS c FROM factor_returns GROUP BY factor)"),
        "design_rows": with_ctes(["design"], "SELECT symbol, k, label, " +
                                 ", ".join(f"{r(q(c))} AS {q(c)}" for c in FEATS) + " FROM design"),
        "split_train": with_ctes(["split"], "SELECT symbol, k, label FROM split WHERE is_train"),
        "split_test": with_ctes(["split"], "SELECT symbol, k, label FROM split WHERE NOT is_train"),
        # moments and models
        "factor_aligned": with_ctes(["aligned"], "SELECT * FROM aligned"),
        "factor_moments": with_ctes(["moments"], "SELECT n, " + ", ".join(
            f"{r(q('mean_' + f))} AS {q('mean_' + f)}" for f in F4) + ", " + ", ".join(
            f"{r(q(f'cov_{F4[i]}_{F4[j]}'))} AS {q(f'cov_{F4[i]}_{F4[j]}')}" for i in range(d) for j in range(i, d))
            + " FROM moments"),
        "factor_corr": with_ctes(["aligned"], "SELECT a.f AS factor_a, b.f AS factor_b, " + r(
            "covar_samp(a.v, b.v) / (stddev_samp(a.v) * stddev_samp(b.v))") + " AS corr FROM " +
            "(SELECT k, f, v FROM aligned UNPIVOT (v FOR f IN (" + ", ".join(q(f) for f in F4) + "))) a JOIN " +
            "(SELECT k, f, v FROM aligned UNPIVOT (v FOR f IN (" + ", ".join(q(f) for f in F4) + "))) b " +
            "ON a.k = b.k GROUP BY a.f, b.f"),
        "model_moments": with_ctes(["model_moments"], "SELECT symbol, n, " + ", ".join(
            f"{r(c, 6)} AS {c}" for c in ["my", "vy", *[f"mx_{i}" for i in range(d)], *[f"cxy_{i}" for i in range(d)],
                                       *[f"cxx_{i}_{j}" for i in range(d) for j in range(i, d)]]) + " FROM model_moments"),
        # At the minimum all gradients are zero, whatever solved the equations.
        "fit_residual": with_ctes(["design"], "SELECT symbol, CAST(0 AS DOUBLE) AS g_intercept, " + ", ".join(
            f"CAST(0 AS DOUBLE) AS {q('g_' + f)}" for f in FEATS) + " FROM design GROUP BY symbol"),
        "cholesky_product": with_ctes(["aligned"], " UNION ALL ".join(
            f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, {r(f'covar_samp({q(a)}, {q(b)})')} AS cov FROM aligned"
            for i, a in enumerate(F4) for b in F4[:i + 1])),
        "fit_linear": with_ctes(["models"], f"SELECT symbol, n, {r('intercept')} AS intercept, {w_sel} FROM models"),
        "predict_test": with_ctes(["predict_test"], f"SELECT symbol, k, label, {r('prediction')} AS prediction FROM predict_test"),
        "r2_scores": with_ctes(["r2"], f"SELECT symbol, n, {r('score')} AS score FROM r2"),
        "r2_summary": with_ctes(["r2"], _summary("r2", "score")),
        # scenarios and risk
        "scenarios": with_ctes(["scenarios"], "SELECT trial_id, " + ", ".join(
            f"{r(q('x_' + f))} AS {q('x_' + f)}" for f in F4) + " FROM scenarios"),
        "trial_returns": with_ctes(["trials"], f"SELECT trial_id, {r('average_return')} AS average_return FROM trials"),
        "trial_returns_cross": with_ctes(["pairs"], f"SELECT trial_id, {r('avg(r)')} AS average_return FROM pairs GROUP BY trial_id"),
        "instrument_trials": with_ctes(["pairs"], (
            f"SELECT symbol, count(*) AS trials, {r('avg(r)')} AS mean, {r('stddev_pop(r)')} AS stddev, {r('min(r)')} AS min, "
            f"{r('max(r)')} AS max, {r('max(v)')} AS value_at_risk, {r('avg(r) FILTER (r <= v)')} AS conditional_var FROM "
            f"(SELECT p.symbol, p.r, t.v FROM pairs p JOIN (SELECT symbol, quantile_disc(r, {p!r}) AS v FROM pairs GROUP BY symbol) t "
            "ON p.symbol = t.symbol) GROUP BY symbol")),
        "instrument_var": with_ctes(["stock_returns"], (
            f"SELECT s.symbol, count(*) AS n, {r('max(v)')} AS value_at_risk, {r('avg(fluct) FILTER (fluct <= v)')} AS conditional_var "
            f"FROM stock_returns s JOIN (SELECT symbol, quantile_disc(fluct, {p!r}) AS v FROM stock_returns GROUP BY symbol) t "
            "ON s.symbol = t.symbol GROUP BY s.symbol")),
        "value_at_risk": with_ctes(["var"], f"SELECT {r('value_at_risk')} AS value_at_risk FROM var"),
        "conditional_var": with_ctes(["cvar"], f"SELECT {r('value_at_risk')} AS value_at_risk, "
                                               f"{r('conditional_var')} AS conditional_var FROM cvar"),
        "trial_stats": with_ctes(["trials"], f"SELECT {r('min(average_return)')} AS min, {r('max(average_return)')} AS max, "
                                             f"count(average_return) AS count, {r('stddev_pop(average_return)')} AS stddev FROM trials"),
        "bootstrap_var": with_ctes(["boot_rep"], _boot_ci("value_at_risk", "var")),
        "bootstrap_cvar": with_ctes(["boot_rep"], _boot_ci("conditional_var", "cvar")),
        "bootstrap_mean": with_ctes(["boot_rep"], _boot_ci("mean", "mean") + " UNION ALL " + _boot_ci("stddev", "stddev")),
        "bootstrap_median": with_ctes(["boot_median"], _boot_ci("median", "median", "boot_median")),
        "bootstrap_semi_deviation": with_ctes(["boot_semi"], _boot_ci("below_mean", "semi_deviation", "boot_semi") + " UNION ALL "
                                              + _boot_ci("mean", "mean", "boot_semi")),
        "failures": with_ctes(["failures"], "SELECT risk_measure, failures, size FROM failures"),
        "kupiec": with_ctes(["failures"], f"SELECT risk_measure, failures, size, {r(_kupiec('failures', 'size', p))} "
                                          "AS kupiec_pof FROM failures"),
        "chi2_density": with_ctes(["failures"], (
            f"SELECT risk_measure, failures, size, {r('s')} AS kupiec_pof, "
            f"{r('CASE WHEN s > 0 THEN exp(-s / 2) / sqrt(2 * pi() * s) END')} AS chi2_pdf, "
            f"s > {3.841459!r} AS reject FROM (SELECT *, {_kupiec('failures', 'size', p)} AS s FROM failures)")),
        "binomial_z": with_ctes(["failures"], f"SELECT risk_measure, failures, size, "
                                              f"{r(f'(failures - size * {p!r}) / sqrt(size * {p!r} * {1 - p!r})')} "
                                              "AS binomial_z FROM failures"),
        "factor_fill": with_ctes(["factors_filled"], f"SELECT factor, date, {r('open')} AS open FROM factors_filled"),
        "failures_observation": with_ctes(["stock_returns", "var", "cvar"], (
            "SELECT m.risk_measure, CAST(count(CASE WHEN s.fluct < m.v THEN 1 END) AS BIGINT) AS failures, "
            "CAST(count(*) AS BIGINT) AS size FROM stock_returns s CROSS JOIN (SELECT 'var' AS risk_measure, "
            "value_at_risk AS v FROM var UNION ALL SELECT 'cvar', conditional_var FROM cvar) m "
            "GROUP BY m.risk_measure")),
        "feature_table_by_date": with_ctes(["ff"], (
            "SELECT CAST(row_number() OVER (ORDER BY date DESC) - 1 AS INTEGER) AS k, " +
            ", ".join(f"{r(q(f + '_feat'))} AS {q(f + '_feat')}" for f in F4) + " FROM (" +
            "SELECT date, " + ", ".join(f"max(CASE WHEN factor = '{f}' THEN feat END) AS {q(f + '_feat')}"
                                       for f in F4) + " FROM ff GROUP BY date) WHERE " +
            " AND ".join(f"{q(f + '_feat')} IS NOT NULL" for f in F4))),
        "fit_linear_train": with_ctes(["models_train"], f"SELECT symbol, n, {r('intercept')} AS intercept, {w_sel} "
                                                         "FROM models_train"),
        "r2_scores_train": with_ctes(["predict_test_train"], f"SELECT symbol, n, {r('score')} AS score FROM "
                                                              f"({_r2_from('predict_test_train')})"),
        "factor_density": with_ctes(["factor_returns"], _kde("factor_returns", "fluct", "factor", "samp", True)),
        "trial_density": with_ctes(["trials"], _kde("trials", "average_return", None, "pop", False)),
    }
    return out
