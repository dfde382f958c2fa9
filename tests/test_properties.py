"""Properties: closed-form fit, scenario collapse, Cholesky, risk ordering, invariance."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from montevar.operators import density, moments, regression, risk, scenarios
from montevar.plans import pipeline as pl

FEATS = ["a_feat", "b_feat", "c_feat"]


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(6):
        for k in range(40 + s):
            x = rng.normal(size=3)
            y = 0.3 * s + x @ np.array([1.0, -2.0, 0.5]) + rng.normal(scale=0.1)
            rows.append((f"S{s}", k, float(y), *map(float, x)))
    return spark.createDataFrame(rows, "symbol string, k int, label double, a_feat double, b_feat double, c_feat double")


def test_fit_matches_penalised_least_squares(design):
    alpha = 1e-4
    models = {r.symbol: r for r in regression.fit_linear(design, FEATS, alpha).collect()}
    pdf = design.toPandas()
    for sym, g in pdf.groupby("symbol"):
        x, y = g[FEATS].to_numpy(), g["label"].to_numpy()
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc / len(y) + alpha * np.eye(3), xc.T @ yc / len(y))
        b = y.mean() - w @ x.mean(0)
        m = models[sym]
        got = np.array([m.w_a, m.w_b, m.w_c])
        assert np.allclose(got, w, atol=1e-10) and m.intercept == pytest.approx(b, abs=1e-10)


def test_residuals_orthogonal_to_features(design):
    m = regression.fit_linear(design, FEATS, 0.0)
    pred = regression.predict(design, m, FEATS).toPandas()
    res = pred["label"] - pred["prediction"]
    for f in FEATS:
        for _, g in pred.assign(res=res).groupby("symbol"):
            assert abs((g["res"] * (g[f] - g[f].mean())).sum()) < 1e-8
    assert abs(res.sum()) < 1e-8


def test_collapse_equals_mean_of_predictions(spark):
    factors = ["AF", "AO", "NF", "NO"]
    feats = [f"{f}_feat" for f in factors]
    rng = np.random.default_rng(3)
    mrows = [(f"S{i}", 10, *map(float, rng.normal(size=5))) for i in range(25)]
    models = spark.createDataFrame(mrows, "symbol string, n bigint, intercept double, w_AF double, w_AO double, "
                                          "w_NF double, w_NO double")
    srows = [(i, *map(float, rng.normal(scale=0.05, size=4))) for i in range(40)]
    scen = spark.createDataFrame(srows, "trial_id bigint, x_AF double, x_AO double, x_NF double, x_NO double")
    got = {r.trial_id: r.average_return for r in scenarios.score_scenarios(scen, models, factors, feats).collect()}
    mp = models.toPandas()
    for tid, *xs in srows:
        fx = [x + np.sign(x) * x * x + np.sign(x) * np.sqrt(abs(x)) for x in xs]
        preds = mp["intercept"] + sum(mp[f"w_{f}"] * v for f, v in zip(factors, fx))
        assert got[tid] == pytest.approx(preds.mean(), abs=1e-12)


def test_scenarios_follow_the_covariance(spark):
    factors = ["p", "q", "r"]
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    one = spark.createDataFrame([(1, 0.1, -0.2, 0.0, 0.04, 0.01, 0.0, 0.09, 0.02, 0.16)],
                                "n long, mean_p double, mean_q double, mean_r double, cov_p_p double, cov_p_q double, "
                                "cov_p_r double, cov_q_q double, cov_q_r double, cov_r_r double")
    prm = scenarios.scenario_params(one, factors).collect()[0]
    L = np.zeros((3, 3))
    for i in range(3):
        for j in range(i + 1):
            L[i, j] = prm[f"l_{i}_{j}"]
    assert np.allclose(L @ L.T, cov, atol=1e-12)
    draws = scenarios.sample_scenarios(spark, one, factors, 20000, seed=11).toPandas()
    x = draws[["x_p", "x_q", "x_r"]].to_numpy()
    assert np.allclose(x.mean(0), [0.1, -0.2, 0.0], atol=0.01)
    assert np.allclose(np.cov(x.T), cov, atol=0.01)


def test_scenarios_do_not_depend_on_partitioning(spark):
    one = spark.createDataFrame([(1, 0.0, 0.01)], "n long, mean_p double, cov_p_p double")
    a = scenarios.sample_scenarios(spark, one, ["p"], 500, partitions=1).orderBy("trial_id").collect()
    b = scenarios.sample_scenarios(spark, one, ["p"], 500, partitions=7).orderBy("trial_id").collect()
    assert a == b


def test_bootstrap_weighted_quantile_matches_expanded_sample(spark):
    rng = np.random.default_rng(5)
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.round(rng.normal(size=300), 2))],
                              "trial_id bigint, average_return double")
    got = {r.replicate: r for r in risk.replicate_stats(t, num=20, p=0.05, seed=9).collect()}
    w = risk.resample_weights(t, num=20, seed=9).toPandas()
    for r, g in w.groupby("replicate"):
        vals = np.sort(np.repeat(g["average_return"].to_numpy(), g["w"].astype(int).to_numpy()))
        var = vals[int(np.ceil(0.05 * len(vals))) - 1]
        assert got[r]["var"] == var
        assert got[r].cvar == pytest.approx(vals[vals <= var].mean(), abs=1e-12)
        assert got[r]["mean"] == pytest.approx(vals.mean(), abs=1e-12)
        assert got[r].stddev == pytest.approx(vals.std(), abs=1e-12)
    # weights are Poisson(1): mean and variance near one
    allw = w.groupby("replicate")["w"].sum() / 300
    assert abs(allw.mean() - 1) < 0.05


def test_cvar_not_above_var(spark):
    t = spark.range(1000).select(F.col("id").alias("trial_id"), F.sin(F.col("id") * 1.7).alias("average_return"))
    c = risk.conditional_var(t).collect()[0]
    assert c.conditional_var <= c.value_at_risk


def test_kde_integrates_to_about_one(spark):
    df = spark.range(2000).select(F.randn(1).alias("v"))
    d = density.kde(df, "v", points=200).toPandas().sort_values("j")
    step = d["x"].iloc[1] - d["x"].iloc[0]
    assert 0.95 < d["density"].sum() * step < 1.01


def test_corr_diagonal_is_one(spark):
    wide = spark.range(100).select(F.col("id").alias("k"), F.randn(1).alias("p"), F.randn(2).alias("q"))
    c = {(r.factor_a, r.factor_b): r.corr for r in moments.factor_corr(wide, ["p", "q"]).collect()}
    assert c[("p", "p")] == pytest.approx(1.0) and c[("p", "q")] == pytest.approx(c[("q", "p")])


def test_constant_series_correlation_is_null(spark):
    wide = spark.range(10).select(F.col("id").alias("k"), F.lit(1.0).alias("p"), F.col("id").cast("double").alias("q"))
    c = {(r.factor_a, r.factor_b): r.corr for r in moments.factor_corr(wide, ["p", "q"]).collect()}
    assert c[("p", "q")] is None


def test_study_results_do_not_depend_on_shuffle_partitions(spark):
    from tests.conftest import SF_SMALL
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = pl.RiskStudy.from_tables(spark, SF_SMALL, n_trials=500).risk_report().collect()
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = pl.RiskStudy.from_tables(spark, SF_SMALL, n_trials=500).risk_report().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert a[0].trials == b[0].trials == 500
    assert a[0].value_at_risk == pytest.approx(b[0].value_at_risk, abs=1e-12)
    assert a[0].conditional_var == pytest.approx(b[0].conditional_var, abs=1e-12)


def test_one_pass_r2_equals_explicit_predictions(design):
    from montevar.operators import features
    fused = {r.symbol: r for r in regression.fit_and_score(design, FEATS, 1e-4, 0.8).collect()}
    models = regression.fit_linear(design, FEATS, 1e-4)
    explicit = regression.r2_by_symbol(regression.predict(features.split_test(design, 0.8), models, FEATS))
    rows = explicit.collect()
    assert len(rows) == len(fused)
    for r in rows:
        assert fused[r.symbol].n_test == r.n
        assert fused[r.symbol].score == pytest.approx(r.score, abs=1e-10)


@pytest.mark.parametrize("n,p", [(1, 0.05), (19, 0.05), (20, 0.05), (21, 0.05), (1000, 0.05), (20000, 0.01),
                                 (777, 0.5), (50, 0.0), (50, 1.0)])
def test_distributed_quantile_equals_percentile_disc(spark, n, p):
    rng = np.random.default_rng(n)
    vals = np.round(rng.normal(size=n), 1)          # many ties
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = risk.lower_quantile(df, "x", p).collect()[0].value
    want = df.agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)").alias("v")).collect()[0].v
    assert got == want


def test_distributed_quantile_with_a_hot_value(spark):
    # a third of all rows share one value
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(0.25))
                                   .otherwise(F.sin(F.col("id").cast("double"))).alias("x"))
    for p in (0.05, 0.5, 0.7):
        got = risk.lower_quantile(df, "x", p).collect()[0].value
        want = df.agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)").alias("v")).collect()[0].v
        assert got == want


def test_distributed_quantile_empty_input(spark):
    df = spark.createDataFrame([], "x double")
    assert risk.lower_quantile(df, "x", 0.05).collect()[0].value is None


def test_distributed_quantile_wherever_the_bracket_lies(spark, monkeypatch):
    """A bracket that misses the rank, or is a single value, costs work but never the result."""
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(997)) * F.when(F.col("id") % 2 == 0, 1e-300).otherwise(1e300)).alias("x"))
    vals = sorted(r.x for r in df.collect())
    for accuracy in (2, 10, 10**6):
        monkeypatch.setattr(risk, "BRACKET_ACCURACY", accuracy)
        for p in (0.01, 0.37, 0.999):
            assert risk.lower_quantile(df, "x", p).collect()[0].value == vals[max(int(np.ceil(p * 5000)) - 1, 0)]


def test_a_null_anywhere_leaves_the_row_out(spark):
    rng = np.random.default_rng(2)
    rows = [("S", k, float(rng.normal()), *map(float, rng.normal(size=3))) for k in range(20)]
    holes = [("S", 20, None, 1.0, 1.0, 1.0), ("S", 21, 1.0, None, 1.0, 1.0), ("S", 22, 1.0, 1.0, None, 1.0), ("S", 23, 1.0, 1.0, 1.0, None)]
    schema = "symbol string, k int, label double, a_feat double, b_feat double, c_feat double"
    clean, holed = (spark.createDataFrame(r, schema) for r in (rows, rows + holes))
    for f in (lambda d: regression.fit_linear(d, FEATS), lambda d: regression.model_moments(d, FEATS)):
        a, b = f(clean).collect()[0].asDict(), f(holed).collect()[0].asDict()
        assert a["n"] == b["n"] == 20
        assert all(a[c] == pytest.approx(b[c], abs=1e-12) for c in a if c != "symbol")


def test_a_constant_label_is_told_by_its_range(spark):
    rng = np.random.default_rng(3)
    rows = [("S", k, 0.1, *map(float, rng.normal(size=3))) for k in range(37)]
    d = spark.createDataFrame(rows, "symbol string, k int, label double, a_feat double, b_feat double, c_feat double")
    from montevar.operators import features
    assert regression.fit_and_score(d, FEATS).collect()[0].score == 1.0
    pred = regression.predict(features.split_test(d), regression.fit_linear(d, FEATS), FEATS)
    assert regression.r2_by_symbol(pred).collect()[0].score == 1.0
    off = pred.withColumn("prediction", F.col("prediction") + 0.01)
    assert regression.r2_by_symbol(off).collect()[0].score == 0.0


def test_moments_need_no_window(spark, design):
    for df in (regression.model_moments(design, FEATS), regression.fit_linear(design, FEATS)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "partial_covar_pop" in plan


def test_density_of_a_group_without_spread_is_null(spark):
    df = spark.createDataFrame([("flat", 1.0)] * 5 + [("one", 2.0)] + [("ok", float(k % 7)) for k in range(50)], "f string, v double")
    d = density.kde(df, "v", by="f", points=10).toPandas()
    assert d[d.f != "ok"].density.isna().all() and d[d.f == "ok"].density.notna().all()
    assert density.kde(df.where("f = 'flat'"), "v", points=10, log=True).toPandas().log_density.isna().all()


def test_options_are_checked(spark):
    df = spark.createDataFrame([("S", 1.0)], "symbol string, fluct double").withColumn("date", F.current_date())
    from montevar.operators import backtest, features
    with pytest.raises(ValueError):
        backtest.count_failures(df, 0.1, unit="observations")
    with pytest.raises(ValueError):
        features.feature_table(df, ["A"], align="dates")
    with pytest.raises(ValueError):
        density.kde(df, "fluct", sd="sample")
    with pytest.raises(ValueError):
        risk.bootstrap_ci(df, "median")
    with pytest.raises(ValueError):
        risk.bootstrap_ci(df, "var", probability=0.0)
    for unit in ("reference", "observation"):
        r = backtest.count_failures(df.limit(0), 0.1, unit=unit).collect()[0]
        assert (r.failures, r["size"]) == (0, 0)


def test_fit_on_train_uses_only_newest_rows(design):
    from montevar.operators import features
    fused = {r.symbol: r for r in regression.fit_and_score(design, FEATS, 1e-4, 0.8, fit_on="train").collect()}
    train_models = regression.fit_linear(features.split_train(design, 0.8), FEATS, 1e-4)
    for m in train_models.collect():
        assert fused[m.symbol].w_a == pytest.approx(m.w_a, abs=1e-10)
        assert fused[m.symbol].intercept == pytest.approx(m.intercept, abs=1e-10)
        assert fused[m.symbol].n == m.n
    explicit = regression.r2_by_symbol(regression.predict(features.split_test(design, 0.8), train_models, FEATS))
    for r in explicit.collect():
        assert fused[r.symbol].score == pytest.approx(r.score, abs=1e-10)


def test_feature_alignment_by_date(spark):
    import datetime as dt
    from montevar.operators import features
    rows = [("A", dt.date(2013, 1, d), 0.01 * d) for d in (1, 2, 3, 4)] + \
           [("B", dt.date(2013, 1, d), -0.01 * d) for d in (2, 3, 4, 5)]
    ff = features.factor_features(spark.createDataFrame(rows, "factor string, date date, fluct double"))
    by_rank = features.feature_table(ff, ["A", "B"]).count()
    by_date = {r.k: r for r in features.feature_table(ff, ["A", "B"], align="date").collect()}
    assert by_rank == 4 and len(by_date) == 3          # common dates 2, 3, 4
    fa = lambda f: f + np.sign(f) * f * f + np.sign(f) * np.sqrt(abs(f))
    assert by_date[0].A_feat == pytest.approx(fa(0.04)) and by_date[0].B_feat == pytest.approx(fa(-0.04))


def test_one_pass_fit_edge_cases(spark):
    """Tiny groups, a constant label and a constant feature agree with the explicit path."""
    from montevar.operators import features
    rows = [("ONE", 0, 0.1, 0.2, 0.3, 0.4)]
    rows += [("TWO", k, 0.1 * k, 0.2, -0.3 * k, 0.4 + k) for k in range(2)]
    rows += [("THREE", k, 0.05, 0.1 * k, 0.2, -0.1 * k) for k in range(3)]           # constant label
    rows += [("FLAT", k, 0.01 * k, 0.5, 0.5, 0.5) for k in range(12)]                  # constant features
    rows += [("MIX", k, float(np.sin(k)), float(np.cos(k)), 0.0, float(k % 3)) for k in range(15)]
    d = spark.createDataFrame(rows, "symbol string, k int, label double, a_feat double, b_feat double, c_feat double")
    fused = {r.symbol: r for r in regression.fit_and_score(d, FEATS, 1e-4, 0.8).collect()}
    explicit_models = {r.symbol: r for r in regression.fit_linear(d, FEATS, 1e-4).collect()}
    assert set(fused) == set(explicit_models) == {"ONE", "TWO", "THREE", "FLAT", "MIX"}
    for s, m in explicit_models.items():
        for c in ("intercept", "w_a", "w_b", "w_c"):
            assert fused[s][c] == pytest.approx(m[c], abs=1e-9), (s, c)
    test_rows = features.split_test(d, 0.8)
    explicit = {r.symbol: r.score for r in regression.r2_by_symbol(
        regression.predict(test_rows, regression.fit_linear(d, FEATS, 1e-4), FEATS)).collect()}
    for s, r in fused.items():
        if r.score is None:
            assert s not in explicit
        else:
            assert r.score == pytest.approx(explicit[s], abs=1e-9), s
    assert fused["ONE"].score is None and fused["TWO"].score is None
