"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (through ``sources.fixtures``) and runs over
whole tables.  Floating outputs are reported to 9 decimals with the
half-away-from-zero rule, so results do not depend on the summation order of
the engine (the oracle applies the same rule).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from montevar.functions.numeric import round_half_away
from montevar.functions.parsing import INDEX_CSV_DATE, INDEX_TSV_DATE, STOCK_DATE, parse_date_text, parse_number_text
from montevar.operators import backtest, features as feat_ops, moments as mom_ops, regression, risk, scenarios, series
from montevar.plans import pipeline as pl
from montevar.session import checkpoint_dir
from montevar.sources import files, fixtures as fx

DIGITS = 9
#: Buckets of the stored price table, and the share of rows that ``resample_rows`` draws.
STORED_BUCKETS = 16
RESAMPLE_FRACTION = 0.8


def report(df: DataFrame, places: int = DIGITS) -> DataFrame:
    """Round every DOUBLE column for reporting; other columns pass through."""
    cols = [round_half_away(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, DoubleType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


# What the query's output reads more than once: the rest of the study stays one lazy plan.
TRIALS = ("trials",)
FIGURES = ("trials", "risk_figures")
# A filter on what the solve yields would be pushed below its projections and copy the elimination.
FITTED = ("fitted",)


def _study(spark, sf, keep=(), **kw):
    return pl.study(spark, sf, keep=keep, **kw)


def _tsv_date(c):
    return parse_date_text(c, INDEX_TSV_DATE)


def q_parse_dates(spark, sf):
    t = fx.prices_text(spark, sf)
    return t.select("l_orderkey", "l_linenumber", "ship_date",
                    parse_date_text("stock_date_text", STOCK_DATE).alias("stock_date"),
                    _tsv_date("tsv_date_text").alias("tsv_date"),
                    parse_date_text("csv_date_text", INDEX_CSV_DATE).alias("csv_date"))


def q_parse_numbers(spark, sf):
    t = fx.prices_text(spark, sf)
    return t.select("l_orderkey", "l_linenumber",
                    parse_number_text("open_text").alias("open"),
                    parse_number_text("low_text").alias("low"),
                    parse_number_text("junk_text").alias("junk"),
                    parse_number_text(F.concat("open_text", F.lit(".5"))).alias("malformed"))


def q_drop_missing_dates(spark, sf):
    t = fx.prices_text(spark, sf)
    typed = t.select("symbol", parse_date_text("stock_date_text", STOCK_DATE).alias("date"),
                     parse_number_text("open_text").alias("open"))
    return series.drop_missing_dates(typed)


def q_price_lines_csv(spark, sf):
    landed = files.columns_of_lines(fx.price_lines(spark, sf), files.STOCK_COLUMNS)
    ids = ["l_orderkey", "l_linenumber"]
    typed = files.parse_prices(landed.withColumn("symbol", F.concat_ws("/", "symbol", *ids)))
    return typed.select(*[F.split("symbol", "/")[k].alias(c) for k, c in enumerate(["symbol", *ids])],
                        "date", "open", "high", "low", "close", "volume")


def _checked_lines(spark, sf):
    return files.checked_prices(files.columns_of_lines(fx.damaged_price_lines(spark, sf), files.STOCK_COLUMNS, corrupt=True))


def q_price_line_rejects(spark, sf):
    return files.rejected_rows(_checked_lines(spark, sf))


def q_price_line_good(spark, sf):
    return files.good_rows(_checked_lines(spark, sf)).select("l_orderkey", "l_linenumber", "symbol", "date", "open", "nulled")


def q_price_line_reasons(spark, sf):
    return _checked_lines(spark, sf).groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


def q_price_files(spark, sf):
    """The files of all symbols, written first, read for the listed symbols."""
    stocks, listed = fx.write_price_files(spark, sf, f"{checkpoint_dir(spark)}/price-files-{uuid.uuid4().hex}")
    return files.load_prices(spark, stocks, files.load_symbols(spark, listed), by_folder=True)


def q_stock_returns_stored(spark, sf):
    """``stock_returns`` from the stored layout."""
    name = f"montevar_prices_{uuid.uuid4().hex}"
    kept = series.store_series(fx.prices(spark, sf), name, f"{checkpoint_dir(spark)}/{name}", buckets=STORED_BUCKETS)
    st = pl.RiskStudy(kept, fx.factors(spark, sf), pl.FACTORS, keep=())
    return report(st.stock_returns)


def q_resample_rows(spark, sf):
    return risk.resample_rows(fx.line_kinds(spark, sf), RESAMPLE_FRACTION, pl.BOOT_SEED)


def _factor_lines(spark, sf, tsv, sep, date_format):
    landed = files.columns_of_lines(fx.factor_lines(spark, sf, tsv), files.FACTOR_COLUMNS, sep)
    landed = landed.withColumn("factor", F.concat_ws("/", "factor", "l_orderkey", "l_linenumber"))
    return files.parse_factor(landed, date_format)


def q_factor_lines_tsv(spark, sf):
    return _factor_lines(spark, sf, True, "\t", INDEX_TSV_DATE)


def q_factor_lines_csv(spark, sf):
    return _factor_lines(spark, sf, False, ",", INDEX_CSV_DATE)


def q_period_filter(spark, sf):
    raw = fx.raw_prices(spark, sf).drop("sym_no")
    return series.filter_period(raw, *fx.PERIOD)


def q_dedup_prices(spark, sf):
    return series.dedup_series(fx.raw_prices(spark, sf).drop("sym_no"), "symbol")


def q_factor_union(spark, sf):
    return fx.factor_series_union(spark, sf)


def q_symbol_semi_scan(spark, sf):
    syms = fx.symbols(spark, sf, region="EUROPE")
    return fx.prices(spark, sf).join(syms, "symbol", "left_semi")


def q_fill_recent(spark, sf):
    return report(series.fill_recent(fx.prices_gaps(spark, sf), "symbol"))


def q_fill_columns(spark, sf):
    return report(series.fill_recent(fx.factor_levels(spark, sf), "factor", cols=("open", "close")))


def q_stock_returns(spark, sf):
    return report(_study(spark, sf).stock_returns)


def q_factor_returns(spark, sf):
    return report(_study(spark, sf).factor_returns)


def q_portfolio_daily_return(spark, sf):
    return report(series.daily_mean_return(_study(spark, sf).stock_returns))


def q_returns_summary(spark, sf):
    return report(series.summarize(series.daily_mean_return(_study(spark, sf).stock_returns), "avg_return"))


def q_factor_summary(spark, sf):
    return report(series.summarize_columns(_study(spark, sf).factor_returns, ["open", "fluct"], by="factor"))


def q_stock_returns_period(spark, sf):
    return report(_study(spark, sf, start=fx.PERIOD[0], end=fx.PERIOD[1]).stock_returns)


def q_stock_returns_rows(spark, sf):
    return report(_study(spark, sf, horizon="rows").stock_returns)


def q_historical_var(spark, sf):
    return report(risk.historical_var(_study(spark, sf, keep=("portfolio_returns",)).portfolio_returns, pl.VAR_P))


def q_variance_covariance_var(spark, sf):
    return report(risk.variance_covariance_var(_study(spark, sf).portfolio_returns, pl.VAR_P))


def q_factor_features(spark, sf):
    return report(_study(spark, sf).feature_rows)


def q_feature_table(spark, sf):
    return report(_study(spark, sf).feature_table)


def q_min_factor_rows(spark, sf):
    return feat_ops.min_factor_rows(_study(spark, sf).factor_returns)


def q_design_rows(spark, sf):
    return report(_study(spark, sf).design_rows)


def q_split_train(spark, sf):
    return feat_ops.split_train(_study(spark, sf).design_rows, pl.TRAIN_RATIO).select("symbol", "k", "label")


def q_split_test(spark, sf):
    return feat_ops.split_test(_study(spark, sf).design_rows, pl.TRAIN_RATIO).select("symbol", "k", "label")


def q_factor_aligned(spark, sf):
    return report(_study(spark, sf).aligned_factors)


def q_factor_moments(spark, sf):
    return report(_study(spark, sf).factor_moments)


def q_factor_corr(spark, sf):
    return report(mom_ops.factor_corr(_study(spark, sf).aligned_factors, pl.FACTORS))


def q_model_moments(spark, sf):
    m = regression.model_moments(_study(spark, sf).design_rows, pl.FEATS)
    return report(m, 6)                                             # values up to 10^5: twelve digits


def q_fit_residual(spark, sf):
    """The normal equations of the fitted models, checked row by row of the design: all gradients vanish."""
    st = _study(spark, sf, keep=FITTED)
    res = regression.predict(st.design_rows, st.models, pl.FEATS)
    e = F.col("label") - F.col("prediction")
    grads = [(F.avg(e * F.col(f)) - pl.RIDGE_ALPHA * F.max(regression.weight_name(f))).alias(f"g_{f}") for f in pl.FEATS]
    out = res.groupBy("symbol").agg(F.avg(e).alias("g_intercept"), *grads)
    return report(out, 8)


def q_fit_linear(spark, sf):
    return report(_study(spark, sf).models)


def q_predict_test(spark, sf):
    return report(_study(spark, sf).predictions_test.select("symbol", "k", "label", "prediction"))


def q_r2_scores(spark, sf):
    return report(_study(spark, sf, keep=FITTED).r2_scores)


def q_r2_summary(spark, sf):
    return report(regression.r2_summary(_study(spark, sf, keep=FITTED).r2_scores))


def q_cholesky_product(spark, sf):
    """``L L'`` of the scenarios' factor, which must be the covariance matrix."""
    st = _study(spark, sf)
    row = scenarios.scenario_params(st.factor_moments, pl.FACTORS)
    cells = []
    for i, a in enumerate(pl.FACTORS):
        for j, b in enumerate(pl.FACTORS[:i + 1]):
            cov = sum((F.col(scenarios.chol_name(i, k)) * F.col(scenarios.chol_name(j, k)) for k in range(1, j + 1)),
                      F.col(scenarios.chol_name(i, 0)) * F.col(scenarios.chol_name(j, 0)))
            cells.append(F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), cov.alias("cov")))
    return report(row.select(F.inline(F.array(*cells))))


def q_rounding(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    x = F.sqrt(F.col("l_extendedprice")) * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return li.select("l_orderkey", "l_linenumber", round_half_away(x, 3).alias("rounded"))


def q_scenarios(spark, sf):
    return report(_study(spark, sf).scenario_draws)


def q_trial_returns(spark, sf):
    return report(_study(spark, sf).trials)


def q_trial_returns_cross(spark, sf):
    return report(_study(spark, sf, keep=FITTED).scenario_means)


def q_instrument_trials(spark, sf):
    return report(_study(spark, sf, keep=FITTED).instrument_trials())


def q_instrument_var(spark, sf):
    return report(_study(spark, sf).instrument_var())


def q_value_at_risk(spark, sf):
    return report(_study(spark, sf, keep=TRIALS).risk_figures.select("value_at_risk"))


def q_conditional_var(spark, sf):
    return report(_study(spark, sf, keep=TRIALS).risk_figures)


def q_trial_stats(spark, sf):
    return report(risk.trial_stats(_study(spark, sf).trials))


def q_bootstrap_var(spark, sf):
    return report(_study(spark, sf, keep=TRIALS).bootstrap("var"))


def q_bootstrap_cvar(spark, sf):
    return report(_study(spark, sf, keep=TRIALS).bootstrap("cvar"))


def q_bootstrap_mean(spark, sf):
    return report(_study(spark, sf, keep=TRIALS).bootstrap(("mean", "stddev")))


#: Two statistics that the library doesn't know: the median, and the deviation below the mean.
MEDIAN = risk.Statistic("median", lambda whole, below, cut, origin: cut, rank=0.5)


def _below_mean(whole, below, cut, origin):
    m = whole["d"] / whole["w"]
    return F.sqrt(F.greatest((below["dd"] - 2 * m * below["d"] + m * m * below["w"]) / whole["w"], F.lit(0.0)))


SEMI_DEVIATION = risk.Statistic("semi_deviation", _below_mean, {"d": lambda d: d, "dd": lambda d: d * d},
                                at=lambda whole: whole["d"] / whole["w"])


def q_bootstrap_median(spark, sf):
    return report(_study(spark, sf, keep=TRIALS).bootstrap(MEDIAN))


def q_bootstrap_semi_deviation(spark, sf):
    return report(_study(spark, sf, keep=TRIALS).bootstrap((SEMI_DEVIATION, "mean")))


def q_failures(spark, sf):
    return _study(spark, sf, keep=FIGURES).failures()


def q_kupiec(spark, sf):
    return report(backtest.kupiec(_study(spark, sf, keep=FIGURES).failures(), pl.VAR_P))


def q_chi2_density(spark, sf):
    return report(backtest.chi2_density(_study(spark, sf, keep=FIGURES).failures(), pl.VAR_P))


def q_binomial_z(spark, sf):
    return report(backtest.binomial_z(_study(spark, sf, keep=FIGURES).failures(), pl.VAR_P))


def q_factor_density(spark, sf):
    return report(_study(spark, sf).factor_density())


def q_trial_density(spark, sf):
    return report(_study(spark, sf, keep=TRIALS).trial_density())


def q_factor_fill(spark, sf):
    return report(_study(spark, sf).filled_factors)


def q_failures_observation(spark, sf):
    st = _study(spark, sf, keep=FIGURES)
    fig = st.figures(pl.VAR_P)
    return backtest.count_failures_many(st.stock_returns, {"var": fig["value_at_risk"],
                                                          "cvar": fig["conditional_var"]}, unit="observation")


def q_feature_table_by_date(spark, sf):
    return report(feat_ops.feature_table(_study(spark, sf).feature_rows, pl.FACTORS, align="date"))


def q_fit_linear_train(spark, sf):
    return report(_study(spark, sf, fit_on="train").models)


def q_r2_scores_train(spark, sf):
    return report(_study(spark, sf, keep=FITTED, fit_on="train").r2_scores)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
