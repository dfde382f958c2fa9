"""The study sink writes every output table; VaR/CVaR read back consistently."""
import os
import tempfile

from montevar.plans.pipeline import RiskStudy
from montevar.plans.report import write_study
from tests.conftest import SF_SMALL


def test_write_study_outputs(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="montevar-report-"), "study")
    names = write_study(RiskStudy.from_tables(spark, SF_SMALL, n_trials=2000), out)
    assert set(names) == {"returns_summary", "factor_summary", "models", "r2_summary", "factor_corr", "trials",
                          "risk_figures", "historical_var", "variance_covariance_var", "bootstrap", "failures", "factor_density", "trial_density"}
    fig = spark.read.parquet(f"{out}/risk_figures").collect()[0]
    assert fig.conditional_var <= fig.value_at_risk
    assert spark.read.parquet(f"{out}/trials").count() == 2000
    assert spark.read.parquet(f"{out}/bootstrap").count() == 2
    assert {r.risk_measure for r in spark.read.parquet(f"{out}/failures").collect()} == {"var", "cvar"}


def test_study_of_raw_files(spark):
    """CSV folder and factor files to VaR, CVaR, intervals and back-test; the price table may hold anything else."""
    import datetime as dt

    import numpy as np

    from montevar.plans.report import study_of_files
    rng = np.random.default_rng(1)
    base = tempfile.mkdtemp(prefix="montevar-files-")
    stocks, factors = os.path.join(base, "stocks"), os.path.join(base, "factors")
    os.makedirs(stocks)
    os.makedirs(factors)
    days = [dt.date(2012, 1, 2) + dt.timedelta(days=k) for k in range(200)]
    for name, sep, date in (("GSPC.txt", "\t", "%b %d, %Y"), ("IXIC.csv", ",", "%Y-%m-%d"), ("FVX.csv", ",", "%Y-%m-%d"),
                            ("TYX.csv", ",", "%Y-%m-%d")):
        level = 100 * np.exp(np.cumsum(rng.normal(scale=0.02, size=200)))
        with open(os.path.join(factors, name), "w") as fh:
            fh.write(sep.join(["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"]) + "\n")
            for d, x in zip(days, level):
                fh.write(sep.join([d.strftime(date), f"{x:.2f}", *["1"] * 5]) + "\n")
    for sym in ("AAA", "BF B", "BRK^A"):
        level = 50 * np.exp(np.cumsum(rng.normal(scale=0.03, size=200)))
        with open(os.path.join(stocks, f"{sym}.csv"), "w") as fh:
            fh.write("Date,Open,High,Low,Close,Volume\n")
            for d, x in zip(days, level):
                fh.write(f"{d.strftime('%d-%b-%y')},{x:.2f},1,1,1,1\n")
    study = study_of_files(spark, stocks, factors, "2012-01-10", "2012-07-01", n_trials=500)
    fig = study.risk_report().collect()[0]
    assert fig.trials == 500 and fig.min_return <= fig.conditional_var <= fig.value_at_risk <= fig.max_return
    assert {r.symbol for r in study.models.collect()} == {"AAA", "BF B", "BRK^A"}
    assert study.stock_returns.where("date < '2012-01-10' or date > '2012-07-01'").count() == 0
    ends = {r.statistic: (r.lower, r.upper) for r in study.bootstrap("both").collect()}
    assert ends["var"][0] <= fig.value_at_risk <= ends["var"][1]
    assert {r.risk_measure for r in study.failures().collect()} == {"var", "cvar"}
