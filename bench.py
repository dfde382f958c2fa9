"""Benchmark: time the stages of one risk study on one scale factor.

Prints ONE JSON line: {"metric", "value", "unit", "queries": {...}, "sf", ...}.
Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).

``queries`` times each stage of a single study in pipeline order; stages that
later stages reuse (factor returns, models, factor moments, trials) are built once and
checkpointed, as a production run would.  ``value`` is the whole study.  ``build`` is the part of each
stage spent before its output runs: composing the plan and, for kept stages, writing them.
``standalone`` times a few registered queries from scratch (each rebuilds its
inputs).  Outputs are forced with the ``noop`` sink: the full result is computed
and nothing but timings reaches the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from montevar.operators import backtest  # noqa: E402
from montevar.plans import catalog, pipeline as pl  # noqa: E402
from montevar.session import build_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(build) -> tuple[float, float]:
    """Seconds to build the frames that ``build`` returns, and to run them."""
    t = time.time()
    frames = build()
    built = time.time()
    for df in frames:
        run(df)
    return round(built - t, 3), round(time.time() - built, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", app="montevar-bench", shuffle_partitions=2 * cpus)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    warm = pl.study(spark, "/root/testdata/sf0.001", n_trials=1000)
    warmup = sum(timed(lambda: [warm.risk_report(), warm.bootstrap(), warm.failures(), warm.r2_scores,
                                warm.trial_density()]))

    st = pl.study(spark, sf_dir, persist_shared=os.environ.get("BENCH_PERSIST", "0") == "1")
    stages = {
        # scan + join + dedup + fill + 14-day horizon frame, per instrument
        "returns": lambda: [st.stock_returns],
        # per-instrument penalised fit (moment aggregate + unrolled solve) with R2 on the test rows
        "fit": lambda: [st.r2_scores],
        # factor moments -> 10 000 multivariate-normal scenarios -> portfolio trial returns
        "trials": lambda: [st.trials],
        # VaR, CVaR and trial statistics
        "var_cvar": lambda: [st.risk_report()],
        # 100 bootstrap replicates; intervals of VaR and CVaR from one pass
        "bootstrap": lambda: [st.bootstrap("both")],
        # failures against VaR and CVaR, Kupiec, chi-square density, binomial z
        "backtest": lambda: [backtest.binomial_z(backtest.chi2_density(st.failures()))],
        # kernel densities of factor returns and of trial returns
        "density": lambda: [st.factor_density(), st.trial_density()],
    }
    both = {name: timed(fn) for name, fn in stages.items()}
    times = {name: round(sum(t), 3) for name, t in both.items()}
    total = round(sum(times.values()), 3)

    standalone = {}
    for name in ("stock_returns", "fit_linear", "trial_returns", "bootstrap_var"):
        fn = catalog.queries()[name]
        standalone[name] = round(sum(timed(lambda: [fn(spark, sf_dir)])), 3)

    print(json.dumps({"metric": "risk_study_seconds", "value": total, "unit": "sec",
                      "queries": times, "build": {name: t[0] for name, t in both.items()}, "standalone": standalone, "sf": sf, "cpus": cpus,
                      "warmup_sec": warmup, "trials": pl.NUM_TRIALS,
                      "bootstrap_replicates": pl.BOOT_NUM}))
    spark.stop()


if __name__ == "__main__":
    main()
