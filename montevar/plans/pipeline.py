"""The end-to-end risk study as composed DataFrame plans.

    prices  -> period -> dedup -> fill -> horizon returns ----------------+--> design -> models*
    factors -> period -> dedup -> fill -> horizon returns* -> features ---+          |
                                                  \\-> aligned -> moments* -> scenarios -> trials*
    trials -> VaR* / CVaR* / bootstrap intervals;  returns x VaR -> back-tests

``RiskStudy`` takes any price and factor table and builds each stage at most once.  The stages
marked * are checkpointed into the cluster's checkpoint folder when several consumers
read them: their lineage is cut, a lost executor never forces a recomputation of the
fit, and downstream plans stay small for the optimizer.  ``keep`` names the stages to
keep; a study of one output keeps only what that output reads more than once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from montevar.operators import (backtest, density, features as feat_ops, instruments, moments as mom_ops,
                                regression, risk, scenarios, series)
from montevar.session import checkpoint_dir
from montevar.sources import fixtures as fx

FACTORS = list(fx.FACTORS)
FEATS = [feat_ops.feature_name(f) for f in FACTORS]
# Study parameters of the Monte-Carlo risk estimate.
NUM_TRIALS = 10_000
TRIAL_SEED = 1259
VAR_P = 0.05
BOOT_NUM = 100
BOOT_PROBABILITY = 0.05
BOOT_SEED = 1
RIDGE_ALPHA = 1e-4
TRAIN_RATIO = 0.8
#: Stages that several outputs of a whole report read.
KEPT = ("factor_returns", "portfolio_returns", "fitted", "factor_moments", "trials", "risk_figures")


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage of a multi-consumer stage into the session's checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


class RiskStudy:
    """One run of the study.

    ``prices`` has ``symbol, date, open`` and ``factors`` has ``factor, date, open``; other columns are
    ignored, several rows of a day are merged (``series.dedup_series``), missing opens are filled.
    ``factor_names`` are the series of the model; ``start`` and ``end`` (inclusive, ISO dates) cut
    both tables, either may be open.
    """

    def __init__(self, prices: DataFrame, factors: DataFrame, factor_names, start: str | None = None,
                 end: str | None = None, n_trials: int = NUM_TRIALS, seed: int = TRIAL_SEED,
                 keep: tuple[str, ...] = KEPT, persist_shared: bool = False, fit_on: str = "all",
                 horizon: str = "days"):
        if horizon not in ("days", "rows"):
            raise ValueError("horizon must be 'days' or 'rows'")
        self.spark = prices.sparkSession
        self.factor_names = list(factor_names)
        self.feats = [feat_ops.feature_name(f) for f in self.factor_names]
        self.prices = self._daily(prices, "symbol", start, end)
        self.factors = self._daily(factors, "factor", start, end).where(F.col("factor").isin(self.factor_names))
        self.fit_on, self.horizon = fit_on, horizon
        self.n_trials, self.seed = n_trials, seed
        self.keep, self.persist_shared = tuple(keep), persist_shared

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None,
                    **kw) -> "RiskStudy":
        """The study over the driver's tables; the period reaches their scans."""
        return cls(fx.raw_prices(spark, sf_dir, start, end), fx.factors(spark, sf_dir, start, end), FACTORS, **kw)

    @staticmethod
    def _daily(df: DataFrame, key: str, start: str | None, end: str | None) -> DataFrame:
        cut = series.filter_period(df.select(key, "date", "open"), start, end)
        return series.dedup_series(series.drop_missing_dates(cut), key)

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        return materialize(df) if name in self.keep else df

    def _shared(self, df: DataFrame) -> DataFrame:
        """Keep a large table that several outputs of this study read (memory, spilling
        to disk).  Its hash partitioning by instrument is kept, and a lost block is
        recomputed from lineage.  Off by default: a single output gains nothing."""
        return df.persist(StorageLevel.MEMORY_AND_DISK) if self.persist_shared else df

    def release(self) -> None:
        """Drop the persisted shared tables of this study (if any)."""
        for name in ("_stock_returns", "design_rows"):
            if name in self.__dict__ and self.persist_shared:
                self.__dict__[name].unpersist()

    def _returns(self, filled: DataFrame, key: str) -> DataFrame:
        if self.horizon == "rows":
            return series.horizon_rows_returns(filled, key, day_col="_day")
        return series.horizon_returns(filled, key, day_col="_day", keep_day=True)

    # --- instruments -----------------------------------------------------------
    # ``_day`` (integer day number) orders every per-instrument window, so the
    # fill, the horizon frame and the recency rank share one sort per partition.
    @cached_property
    def _filled_prices(self) -> DataFrame:
        p = self.prices.withColumn("_day", F.unix_date("date"))
        return series.fill_recent(p, "symbol", order="_day")

    @cached_property
    def filled_prices(self) -> DataFrame:
        return self._filled_prices.drop("_day")

    @cached_property
    def _stock_returns(self) -> DataFrame:
        return self._shared(self._returns(self._filled_prices, "symbol"))

    @cached_property
    def stock_returns(self) -> DataFrame:
        return self._stock_returns.drop("_day")

    # --- factors ---------------------------------------------------------------
    @cached_property
    def _filled_factors(self) -> DataFrame:
        f = self.factors.withColumn("_day", F.unix_date("date"))
        return series.fill_recent(f, "factor", order="_day")

    @cached_property
    def filled_factors(self) -> DataFrame:
        return self._filled_factors.drop("_day")

    @cached_property
    def _factor_returns(self) -> DataFrame:
        # At most one row per factor and day: small, and read by every factor output.
        return self._kept("factor_returns", self._returns(self._filled_factors, "factor"))

    @cached_property
    def factor_returns(self) -> DataFrame:
        return self._factor_returns.drop("_day")

    @cached_property
    def feature_rows(self) -> DataFrame:
        return feat_ops.factor_features(self._factor_returns, order_col="_day")

    @cached_property
    def feature_table(self) -> DataFrame:
        return feat_ops.feature_table(self.feature_rows, self.factor_names)

    # --- models ----------------------------------------------------------------
    @cached_property
    def design_rows(self) -> DataFrame:
        return self._shared(feat_ops.design(self._stock_returns, self.feature_table, order_col="_day"))

    @cached_property
    def fitted(self) -> DataFrame:
        """Models and their test-row R2 from one grouped pass over the design rows."""
        return self._kept("fitted", regression.fit_and_score(self.design_rows, self.feats, RIDGE_ALPHA, TRAIN_RATIO,
                                                             fit_on=self.fit_on))

    @cached_property
    def models(self) -> DataFrame:
        return self.fitted.select("symbol", "n", "intercept", *[regression.weight_name(f) for f in self.feats])

    @cached_property
    def predictions_test(self) -> DataFrame:
        test = feat_ops.split_test(self.design_rows, TRAIN_RATIO)
        return regression.predict(test, self.models, self.feats)

    @cached_property
    def r2_scores(self) -> DataFrame:
        s = self.fitted.select("symbol", F.col("n_test").alias("n"), "score")
        return s.where(F.col("score").isNotNull() & ~F.isnan("score"))

    # --- scenarios -------------------------------------------------------------
    @cached_property
    def aligned_factors(self) -> DataFrame:
        return mom_ops.factor_aligned(self._factor_returns, self.factor_names, order_col="_day")

    @cached_property
    def factor_moments(self) -> DataFrame:
        return self._kept("factor_moments", mom_ops.factor_moments(self.aligned_factors, self.factor_names))

    @cached_property
    def scenario_draws(self) -> DataFrame:
        return scenarios.sample_scenarios(self.spark, self.factor_moments, self.factor_names, self.n_trials, self.seed)

    @cached_property
    def trials(self) -> DataFrame:
        return self._kept("trials", scenarios.score_scenarios(self.scenario_draws, self.models, self.factor_names, self.feats))

    @cached_property
    def scenario_means(self) -> DataFrame:
        """The trials again, from every instrument's return in every scenario."""
        return instruments.scenario_means(self.models, self.scenario_draws, self.factor_names, self.n_trials, self.feats)

    def instrument_trials(self, p: float = VAR_P) -> DataFrame:
        """Simulated VaR, CVaR and spread of every instrument."""
        return instruments.instrument_trials(self.models, self.scenario_draws, self.factor_names, self.n_trials, p, self.feats)

    def instrument_var(self, p: float = VAR_P) -> DataFrame:
        """Realised VaR and CVaR of every instrument."""
        return risk.value_at_risk_by(self.stock_returns, "symbol", p)

    # --- risk figures ----------------------------------------------------------
    @cached_property
    def risk_figures(self) -> DataFrame:
        """One row ``value_at_risk, conditional_var``, computed once per study."""
        return self._kept("risk_figures", risk.conditional_var(self.trials, VAR_P))

    def figures(self, p: float = VAR_P):
        """VaR and CVaR at level ``p`` as fields of one scalar row (``fig["value_at_risk"]``)."""
        if p == VAR_P:
            return scenarios.as_scalar(self.risk_figures)
        return scenarios.as_scalar(risk.conditional_var(self.trials, p))

    def var_figure(self, p: float = VAR_P) -> Column:
        """VaR of the trial returns as a scalar Column (one scalar subquery)."""
        return self.figures(p)["value_at_risk"]

    def cvar_figure(self, p: float = VAR_P) -> Column:
        return self.figures(p)["conditional_var"]

    def failures(self, p: float = VAR_P) -> DataFrame:
        """Back-test counts against both VaR and CVaR: ``risk_measure, failures, size``."""
        fig = self.figures(p)
        return backtest.count_failures_many(self.stock_returns, {"var": fig["value_at_risk"],
                                                                 "cvar": fig["conditional_var"]})

    @cached_property
    def portfolio_returns(self) -> DataFrame:
        """Equal-weight return of each day: one row per day."""
        return self._kept("portfolio_returns", series.daily_mean_return(self.stock_returns))

    def bootstrap(self, stat="both") -> DataFrame:
        return risk.bootstrap_ci(self.trials, stat, BOOT_NUM, VAR_P, BOOT_PROBABILITY, BOOT_SEED)

    def factor_density(self) -> DataFrame:
        return density.kde(self.factor_returns, "fluct", by="factor", sd="samp", log=True)

    def trial_density(self) -> DataFrame:
        return density.kde(self.trials, "average_return", sd="pop", log=False)

    def risk_report(self) -> DataFrame:
        """Flagship: one row with VaR, CVaR and the trial statistics of the simulation."""
        fig = scenarios.as_scalar(self.risk_figures)
        agg = self.trials.agg(F.count(F.lit(1)).alias("trials"), F.min("average_return").alias("min_return"),
                              F.max("average_return").alias("max_return"))
        return agg.select(fig["value_at_risk"].alias("value_at_risk"),
                          fig["conditional_var"].alias("conditional_var"), "*")


def study(spark: SparkSession, sf_dir: str, **kw) -> RiskStudy:
    return RiskStudy.from_tables(spark, sf_dir, **kw)


def risk_report(spark: SparkSession, sf_dir: str, n: int = NUM_TRIALS) -> DataFrame:
    return study(spark, sf_dir, n_trials=n, keep=("trials", "risk_figures")).risk_report()


__all__ = ["FACTORS", "FEATS", "KEPT", "RiskStudy", "study", "risk_report", "materialize"]
