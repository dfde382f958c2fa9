"""Per-instrument scenarios and quantiles, array algebra, caller's statistics, resampled rows, rejects, stored layout, cell densities."""
import math
import os
import re
import tempfile
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from montevar.functions import matrix
from montevar.functions.numeric import poisson_thresholds
from montevar.operators import density, instruments, moments, regression, risk, scenarios, series
from montevar.plans import pipeline as pl
from montevar.sources import files
from montevar.streaming.ingest import ingest_prices, read_prices
from tests.conftest import SF_SMALL

FACTORS = ["p", "q"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan_size(df):
    return len(plan_of(df).splitlines())


# --- per-instrument scenarios -------------------------------------------------

@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = np.round(rng.normal(size=(n, 2)), 1)                        # ties among scenarios
    draws = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "trial_id bigint, x_p double, x_q double").repartition(5)
    models = [(f"S{i}", *map(float, rng.normal(size=3))) for i in range(6)] + [("flat", 1.5, 0.0, 0.0), ("none", 1.0, None, 2.0)]
    table = spark.createDataFrame(models, "symbol string, intercept double, w_p double, w_q double")
    f = x + np.sign(x) * x * x + np.sign(x) * np.sqrt(np.abs(x))
    returns = {m[0]: m[1] + f @ np.array(m[2:]) for m in models if None not in m}
    return draws, table, returns, n


def check_instruments(out, returns, n, p):
    rank = max(math.ceil(p * n), 1)
    assert {r.symbol for r in out} == set(returns)
    for r in out:
        v = np.sort(returns[r.symbol])
        assert r.trials == n
        assert r.value_at_risk == pytest.approx(v[rank - 1], abs=1e-12)
        assert r.conditional_var == pytest.approx(v[v <= v[rank - 1] + 1e-12].mean(), abs=1e-12)
        for got, want in ((r.mean, v.mean()), (r.stddev, v.std()), (r.min, v[0]), (r.max, v[-1])):
            assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 1.0])
def test_instrument_trials_equal_numpy(world, p):
    draws, models, returns, n = world
    check_instruments(instruments.instrument_trials(models, draws, FACTORS, n, p).collect(), returns, n, p)


def test_blocks_of_scenarios_join_up(world, monkeypatch):
    """Many blocks, copied to the executors or shuffled with salts, give the same rows."""
    draws, models, returns, n = world
    monkeypatch.setattr(instruments, "BLOCK_VALUES", 90)
    mean = np.mean(list(returns.values()), axis=0)
    for limit in (1 << 23, 1):
        monkeypatch.setattr(instruments, "BROADCAST_VALUES", limit)
        check_instruments(instruments.instrument_trials(models, draws, FACTORS, n).collect(), returns, n, 0.05)
        got = {r.trial_id: r.average_return for r in instruments.scenario_means(models, draws, FACTORS, n).collect()}
        assert len(got) == n and all(got[i] == pytest.approx(mean[i], abs=1e-12) for i in range(n))


def test_pairs_are_never_shuffled(world):
    """What crosses an exchange above the product is one row per instrument and block, or partial sums."""
    draws, models, _, n = world
    plan = plan_of(instruments.scenario_means(models, draws, FACTORS, n)).splitlines()
    at = next(i for i, line in enumerate(plan) if "Generate explode(cells" in line)
    above = [line for line in plan[:at] if "Exchange" in line]
    assert len(above) == 1 and "partial_avg" in plan[plan.index(above[0]) + 1]
    plan = plan_of(instruments.instrument_trials(models, draws, FACTORS, n))
    assert "explode(cells" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_cross_means_equal_the_collapsed_ones(spark):
    st = pl.RiskStudy.from_tables(spark, SF_SMALL, n_trials=300, keep=("fitted", "factor_moments"))
    a = {r.trial_id: r.average_return for r in st.trials.collect()}
    b = {r.trial_id: r.average_return for r in st.scenario_means.collect()}
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-12) for i in a)


# --- quantiles by group -------------------------------------------------------

@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.97, 1.0])
def test_quantile_by_group_equals_percentile_disc(spark, p):
    """Ties, a hot group, groups of one row, a NULL key and NULL values."""
    df = (spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 997).cast("string"))).alias("k"),
        F.when(F.col("id") % 11 != 0, F.round(F.sin(F.col("id").cast("double") * 1.7), 2)).alias("x"))
        .unionByName(spark.createDataFrame([("one", 4.0), ("void", None), ("big", 1e300), ("big", -1e300), ("big", 0.0)], "k string, x double")))
    got = {r.k: (r.n, r.quantile) for r in risk.quantile_by(df, "k", "x", p, accuracy=200).collect()}
    want = {r.k: (r.n, r.v) for r in df.where("x IS NOT NULL").groupBy("k").agg(
        F.count("x").alias("n"), F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)").alias("v")).collect()}
    assert got == want and None in got and "void" not in got


def test_tail_means_by_group(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), F.round(F.sin(F.col("id").cast("double")), 2).alias("x"))
    rows = df.toPandas()
    for r in risk.value_at_risk_by(df, "k", 0.05, "x").collect():
        v = rows[rows.k == r.k].x
        assert r.conditional_var == pytest.approx(v[v <= r.value_at_risk].mean(), abs=1e-12)
    assert risk.quantile_by(df.limit(0), "k", "x", 0.5).count() == 0


# --- many factors ---------------------------------------------------------------

def test_64_factors_fit_like_numpy_with_a_plan_of_the_same_size(spark):
    rng = np.random.default_rng(8)
    d, n = 64, 200
    feats = [f"f{i}_feat" for i in range(d)]
    x = rng.normal(size=(2, n, d)) * rng.uniform(0.1, 30, size=d) + 5
    y = rng.normal(size=(2, n))
    rows = [(f"S{s}", k, float(y[s, k]), [float(v) for v in x[s, k]]) for s in range(2) for k in range(n)]
    wide = spark.createDataFrame(rows, "symbol string, k int, label double, x array<double>").select(
        "symbol", "k", "label", *[F.col("x")[i].alias(f) for i, f in enumerate(feats)])
    models = {r.symbol: r for r in regression.fit_linear(wide, feats, 1e-4).collect()}
    for s in range(2):
        xc, yc = x[s] - x[s].mean(0), y[s] - y[s].mean()
        w = np.linalg.solve(xc.T @ xc / n + 1e-4 * np.eye(d), xc.T @ yc / n)
        got = np.array([models[f"S{s}"][regression.weight_name(f)] for f in feats])
        assert np.allclose(got, w, atol=1e-9)
        assert models[f"S{s}"].intercept == pytest.approx(y[s].mean() - w @ x[s].mean(0), abs=1e-8)
    few = plan_size(regression.fit_linear(wide, feats[:3]))
    assert plan_size(regression.fit_linear(wide, feats)) == few


def test_64_factors_are_drawn_with_their_covariance(spark):
    rng = np.random.default_rng(9)
    d, n = 64, 3000
    mix = rng.normal(size=(d, d))
    mix[5] = 2 * mix[3] - mix[4]                                   # a combination of others: rank 63
    values = rng.normal(size=(500, d)) @ mix.T
    wide = spark.createDataFrame([([float(v) for v in r],) for r in values], "x array<double>").select(
        *[F.col("x")[i].alias(f"f{i}") for i in range(d)])
    arrays = moments.factor_moment_arrays(wide, [f"f{i}" for i in range(d)])
    row = arrays.collect()[0]
    cov = np.cov(values.T)
    assert row.n == 500 and np.allclose(row.mean, values.mean(0), atol=1e-9)
    assert np.allclose(row["cov"], [cov[i, j] for i in range(d) for j in range(i, d)], atol=1e-8)
    chol = scenarios.factor_arrays(scenarios.draw_params(arrays, d), d).collect()[0].chol
    low = np.array(chol).reshape(d, d).T
    assert np.allclose(low @ low.T, cov, atol=1e-6) and np.allclose(low, np.tril(low))
    drawn = scenarios.draw(spark, arrays, d, n, seed=4)
    x = np.array([r.x for r in drawn.collect()])
    assert np.allclose(x[:, 5] - (2 * x[:, 3] - x[:, 4]), (row.mean[5] - 2 * row.mean[3] + row.mean[4]), atol=1e-5)
    scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    assert np.abs((np.cov(x.T) - cov) / scale).max() < 0.12
    again, few = (scenarios.draw(spark, moments.factor_moment_arrays(wide, [f"f{i}" for i in range(k)]), k, n) for k in (d, 2))
    assert plan_size(again) == plan_size(few)


def test_fit_moments_are_generated_code(spark):
    """The aggregation of the pairs is a hash aggregate whose buffers fit into generated code, whatever the number of factors."""
    st = pl.RiskStudy.from_tables(spark, SF_SMALL, keep=())
    st.fitted.collect()
    text = spark._jvm.PythonSQLUtils.explainString(st.fitted._jdf.queryExecution(), "simple")
    final = text[:text.index("Initial Plan")] if "Initial Plan" in text else plan_of(st.fitted)
    lines = [line for line in final.splitlines() if "partial_covar_pop" in line]
    assert lines and all(re.search(r"\* ?(\(\d+\) )?HashAggregate", line) for line in lines)


def test_array_solve_of_a_singular_matrix_is_null(spark):
    one = spark.range(1)
    w = matrix.solved(lambda i, j: F.lit(0.0), F.array(F.lit(1.0), F.lit(1.0)), 2)
    assert one.select(w.alias("w")).collect()[0].w == [None, None]


# --- bootstrap of any statistic ------------------------------------------------------

def expanded(t, num, seed):
    w = risk.resample_weights(t, num=num, seed=seed).toPandas()
    return {r: np.sort(np.repeat(g["average_return"].to_numpy(), g["w"].astype(int).to_numpy())) for r, g in w.groupby("replicate")}


@pytest.mark.parametrize("values", ["ties", "tails", "constant"])
def test_callers_statistics_equal_expanded_samples(spark, values):
    rng = np.random.default_rng(6)
    v = {"ties": np.round(rng.normal(size=400), 1), "tails": rng.standard_cauchy(400) ** 3, "constant": np.full(50, 0.1)}[values]
    t = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "trial_id bigint, average_return double").repartition(3)
    above = risk.Statistic("share_to_2", lambda whole, below, cut, origin: below["w"] / whole["w"], at=lambda whole: F.lit(1e12))
    third = risk.Statistic("third", lambda whole, below, cut, origin: cut, rank=1 / 3)
    below_mean = risk.Statistic("below_mean", lambda whole, below, cut, origin: below["w"] / whole["w"], {"d": lambda d: d},
                                at=lambda whole: whole["d"] / whole["w"])
    got = {(r.statistic, r.replicate): r.v for r in risk.replicate_values(t, [above, third, below_mean], 15, seed=2).collect()}
    for r, x in expanded(t, 15, 2).items():
        assert got["share_to_2", r] == pytest.approx(1.0)
        assert got["third", r] == x[max(math.ceil(len(x) / 3), 1) - 1]
        if values == "ties":
            assert got["below_mean", r] == pytest.approx(np.mean(x <= x.mean()), abs=1e-12)


def test_ranges_hold_equally_many_trials_however_heavy_the_tails(spark):
    t = spark.range(20_000).select(F.col("id").alias("trial_id"), F.when(F.col("id") == 7, 1e12).otherwise(
        F.sin(F.col("id").cast("double"))).alias("average_return"))
    bounds = t.agg(F.percentile_approx("average_return", [k / risk.BOOT_RANGES for k in range(1, risk.BOOT_RANGES)], 16 * risk.BOOT_RANGES)
                   .alias("b")).collect()[0].b
    sizes = t.select(risk._range_of(F.col("average_return"), F.array(*map(F.lit, bounds))).alias("r")).groupBy("r").count().collect()
    assert max(r["count"] for r in sizes) < 3 * 20_000 / risk.BOOT_RANGES


def test_unknown_and_repeated_statistics_are_refused(spark):
    t = spark.range(3).select(F.col("id").alias("trial_id"), F.lit(1.0).alias("average_return"))
    for stat in ("median", ("var", "var"), ()):
        with pytest.raises(ValueError):
            risk.bootstrap_ci(t, stat)


# --- resampled rows -------------------------------------------------------------------

def test_resampled_rows_do_not_depend_on_partitioning(spark, monkeypatch):
    monkeypatch.setattr(risk, "RESAMPLE_CHUNK", 100)
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 40).cast("string")).alias("a b"),
                                  F.when(F.col("id") % 5 != 0, F.col("id") % 2).alias("x"))
    count = lambda d: sorted((str(r[0]), str(r[1]), r["count"]) for r in d.groupBy(*[F.col(f"`{c}`") for c in d.columns]).count().collect())
    a = risk.resample_rows(df.repartition(7), 1.3, 5)
    assert a.schema == df.schema and count(a) == count(risk.resample_rows(df.coalesce(1), 1.3, 5))
    assert abs(a.count() / 6000 - 1.3) < 0.06
    before, after = (dict(((k, x), n) for k, x, n in count(d)) for d in (df, a))
    assert set(after) <= set(before) and abs(after["hot", "0"] / before["hot", "0"] - 1.3) < 0.15
    assert count(risk.resample_rows(df, 1.3, 6)) != count(a)
    assert risk.resample_rows(df.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        risk.resample_rows(df, 0.0)


@pytest.mark.parametrize("mean", [0.1, 1.0, 7.5])
def test_poisson_thresholds(mean):
    c = poisson_thresholds(mean)
    assert sum(1 - x for x in c) == pytest.approx(mean, abs=1e-9) and c[0] == pytest.approx(math.exp(-mean))


# --- rejected lines ------------------------------------------------------------------

HDR = "Date,Open,High,Low,Close,Volume\n"
BAD = HDR + "31-Dec-13,1,1,1,1,1\n,2,1,1,1,1\nsoon,3,1,1,1,1\n30-Dec-13,4,1\n30-Dec-13,x,-,1,1,1\n29-Dec-13,6,1,1,1,1,9\n"


def test_rejects_and_typed_rows_are_all_landed_rows(spark):
    base = tempfile.mkdtemp(prefix="montevar-rej-")
    with open(os.path.join(base, "A B.csv"), "w") as fh:
        fh.write(BAD)
    open(os.path.join(base, "EMPTY.csv"), "w").close()
    checked = files.checked_prices(files.read_price_records(spark, base))
    good, bad = files.good_rows(checked), files.rejected_rows(checked)
    assert sorted((r.symbol, str(r.date), r.open, r.nulled) for r in good.collect()) == [("A B", "2013-12-30", None, "Open,High"), ("A B", "2013-12-31", 1.0, "")]
    got = sorted((r.reason, r.record) for r in bad.collect())
    assert got == [("columns", "29-Dec-13,6,1,1,1,1,9"), ("columns", "30-Dec-13,4,1"), ("date", "soon,3,1,1,1,1"), ("no date", ",2,1,1,1,1")]
    assert {r.symbol for r in bad.collect()} == {"A B"} and "file" in bad.columns
    assert files.checked_prices(files.read_price_records(spark, tempfile.mkdtemp())).count() == 0


def test_stream_keeps_rejects_beside_the_table(spark):
    base = tempfile.mkdtemp(prefix="montevar-rej-")
    src, out, rej = (os.path.join(base, p) for p in ("src", "table", "rejects"))
    os.makedirs(src)
    with open(os.path.join(src, "AAA.csv"), "w") as fh:
        fh.write(BAD)
    for _ in range(2):                                              # a second run adds nothing
        ingest_prices(spark, src, out, rejects_dir=rej).awaitTermination()
    assert read_prices(spark, out).count() == 2
    assert sorted(r.reason for r in spark.read.parquet(rej).collect()) == ["columns", "columns", "date", "no date"]


# --- stored layout -----------------------------------------------------------------

def test_stored_layout_is_read_without_an_exchange(spark):
    from montevar.sources import fixtures as fx
    name = f"stored_{uuid.uuid4().hex}"
    path = tempfile.mkdtemp(prefix="montevar-stored-") + "/t"
    prices = fx.prices(spark, SF_SMALL)
    stored = series.store_series(prices, name, path, buckets=4)
    assert stored.columns == prices.columns
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, prices.collect()))
    st = pl.RiskStudy(stored, fx.factors(spark, SF_SMALL), pl.FACTORS, keep=("factor_returns",))
    for df in (st.stock_returns, st.design_rows, st.models):
        plan = plan_of(df)
        stock = plan[:plan.index("BroadcastExchange")] if "BroadcastExchange" in plan else plan
        assert not re.search(r"Exchange hashpartitioning\(symbol", plan) and "Bucketed: true" in plan and stock
    cut = series.stored_series(spark, name, "1997-03-01", "1998-02-28")
    plan = plan_of(cut)
    assert re.search(r"PartitionFilters: \[.*year#\d+ >= 1997.*year#\d+ <= 1998", plan)
    want = series.filter_period(prices, "1997-03-01", "1998-02-28")
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, want.collect()))


# --- cell densities -----------------------------------------------------------------

def brute_density(x, points, ddof):
    h = 1.06 * x.std(ddof=ddof) * len(x) ** -0.2
    grid = x.min() + np.arange(points) * (x.max() - x.min()) / points
    return np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))


@pytest.mark.parametrize("kind", ["normal", "gap", "tails", "ties"])
def test_cells_give_the_density_of_all_values(spark, kind):
    rng = np.random.default_rng(12)
    x = {"normal": rng.normal(size=5000), "gap": np.concatenate([rng.normal(size=500), rng.normal(40, 0.01, size=500)]),
         "tails": rng.standard_cauchy(2000), "ties": np.round(rng.normal(size=3000), 1)}[kind]
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(4)
    for log in (False, True):
        rows = sorted(density.kde(df, "v", points=80, sd="pop", log=log).collect())
        want = brute_density(x, 80, 0)
        got = np.array([r[2] if r[2] is not None else -np.inf for r in rows])
        if log:
            with np.errstate(divide="ignore"):
                known = want > 1e-290
                assert np.allclose(got[known], np.log(want[known]), atol=1e-10, rtol=0)
        else:
            assert np.allclose(got, want, rtol=1e-11, atol=1e-300)


def test_work_of_the_grid_does_not_grow_with_the_values(spark):
    """Ten times the values, all different, meet the grid as about as many cells."""
    cells = []
    for n in (20_000, 200_000):
        df = spark.range(n).select(F.randn(5).alias("v"))
        st = df.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("s"), F.count("v").alias("n")).collect()[0]
        h = 1.06 * st.s * st.n ** -0.2
        cells.append(int((st.hi - st.lo) / h * density.CELLS))
    assert cells[1] < 2.5 * cells[0] < 20_000
