"""Sink: write every output table of one risk study as Parquet.

    python -m montevar.plans.report <tables_dir> <out_dir> [n_trials]
    python -m montevar.plans.report --files <stock_dir> <factor_dir> <out_dir> [start end]

The first form reads the driver's tables, the second a folder of ``<symbol>.csv`` price files and a
folder of factor files (``sources.files``).

Tables written (one folder each): ``returns_summary``, ``factor_summary``,
``models`` (with the test-row R2), ``r2_summary``, ``factor_corr``, ``trials``,
``risk_figures``, ``historical_var``, ``variance_covariance_var``, ``bootstrap``, ``failures`` (with Kupiec, chi-square density
and binomial z), ``factor_density``, ``trial_density``.  Each is written by the
executors; only file commit metadata passes through the driver.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame

from montevar.operators import backtest, moments, regression, risk, series
from montevar.plans.pipeline import VAR_P, RiskStudy
from montevar.sources import files


def study_outputs(study: RiskStudy) -> dict[str, DataFrame]:
    fails = backtest.binomial_z(backtest.chi2_density(study.failures(), VAR_P), VAR_P)
    return {
        "returns_summary": series.summarize(study.portfolio_returns, "avg_return"),
        "factor_summary": series.summarize_columns(study.factor_returns, ["open", "fluct"], by="factor"),
        "models": study.fitted,
        "r2_summary": regression.r2_summary(study.r2_scores),
        "factor_corr": moments.factor_corr(study.aligned_factors, study.factor_names),
        "trials": study.trials,
        "risk_figures": study.risk_figures,
        "historical_var": risk.historical_var(study.portfolio_returns, VAR_P),
        "variance_covariance_var": risk.variance_covariance_var(study.portfolio_returns, VAR_P),
        "bootstrap": study.bootstrap("both"),
        "failures": fails,
        "factor_density": study.factor_density(),
        "trial_density": study.trial_density(),
    }


def write_study(study: RiskStudy, out_dir: str, mode: str = "overwrite") -> list[str]:
    """Write all outputs under ``out_dir``; returns the folder names written."""
    written = []
    for name, df in study_outputs(study).items():
        df.write.mode(mode).parquet(f"{out_dir.rstrip('/')}/{name}")
        written.append(name)
    return written


def study_of_files(spark, stock_dir: str, factor_dir: str, start: str | None = None, end: str | None = None,
                   symbols: DataFrame | None = None, factor_specs=None, **kw) -> RiskStudy:
    """The study over raw files: price CSVs (only the listed symbols, if a list is given) and factor files."""
    specs = list(factor_specs or files.default_factor_specs(factor_dir))
    return RiskStudy(files.load_prices(spark, stock_dir, symbols), files.load_factors(spark, specs),
                     [spec[0] for spec in specs], start, end, **kw)


def main(argv: list[str]) -> None:
    from montevar.session import build_session
    spark = build_session()
    if argv[0] == "--files":
        out_dir = argv[3]
        period = dict(zip(("start", "end"), argv[4:6]))
        study = study_of_files(spark, argv[1], argv[2], persist_shared=True, **period)
    else:
        out_dir = argv[1]
        n = int(argv[2]) if len(argv) > 2 else 10_000
        study = RiskStudy.from_tables(spark, argv[0], n_trials=n, persist_shared=True)
    try:
        names = write_study(study, out_dir)
    finally:
        study.release()
    print("written:", ", ".join(names))


if __name__ == "__main__":
    main(sys.argv[1:])
