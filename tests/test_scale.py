"""What a row costs: text is parsed once, constants are folded, and odd rows keep their results."""
import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from montevar.functions import matrix
from montevar.functions.exprs import computed_once
from montevar.functions.parsing import nan_to_null, parse_number_text
from montevar.operators import instruments
from montevar.sources import files


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def parsed_once(df):
    """Each line is split once, and no filter parses it again."""
    plan = optimized(df)
    assert len(re.findall(r"from_csv\(", plan)) == 1
    assert not [line for line in plan.splitlines() if "Filter" in line and "gettimestamp" in line]


@pytest.mark.parametrize("name", ["price_line_good", "price_line_rejects"])
def test_checked_lines_are_parsed_once(built_queries, name):
    parsed_once(built_queries(name))


@pytest.mark.parametrize("name", ["factor_lines_tsv", "factor_lines_csv"])
def test_factor_lines_are_parsed_once(built_queries, name):
    parsed_once(built_queries(name))


def test_price_lines_are_parsed_once(built_queries):
    parsed_once(built_queries("price_lines_csv"))


def test_a_number_is_matched_once(spark):
    """The optimized plan of one parsed number holds its pattern once, without a regular expression for the commas."""
    plan = optimized(spark.range(1).select(F.col("id").cast("string").alias("s")).select(nan_to_null(parse_number_text("s")).alias("v")))
    assert plan.count("RLIKE") == 1 and "regexp_replace" not in plan


def test_computed_once_keeps_rows_order_of_columns_and_pushdown(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, None, 2.0)], "k int, `t.x` string, v double")
    out = computed_once(df, ["t.x", "v"])
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
    lines = optimized(computed_once(spark.range(9).select("id", (F.col("id") * 2).alias("v")), ["v"]).where("id = 3")).splitlines()
    assert next(i for i, x in enumerate(lines) if "Filter" in x) > next(i for i, x in enumerate(lines) if "Generate" in x)


def test_checked_rows_of_odd_lines(spark):
    """Null lines, empty dates, short and long lines, numbers with damage; repeated rows stay."""
    lines = ['31-Dec-13,"1,200.50",2,3,4,5', "31-Dec-13,none,nan,,4,5", "n/a,1,2,3,4,5", ",1,2,3,4,5", "31-Dec-13,1,2", None]
    df = spark.createDataFrame([(i, "S", x) for i, x in enumerate(lines + lines)], "no int, symbol string, line string")
    checked = files.checked_prices(files.columns_of_lines(df, files.STOCK_COLUMNS, corrupt=True))
    good = files.good_rows(checked).orderBy("no").collect()
    day = dt.date(2013, 12, 31)
    assert [(r.no, r.date, r.open, r.high, r.low, r.nulled) for r in good] == [
        (0, day, 1200.5, 2.0, 3.0, ""), (1, day, None, None, None, "Open"), (6, day, 1200.5, 2.0, 3.0, ""), (7, day, None, None, None, "Open")]
    bad = {r.no: (r.reason, r.record) for r in files.rejected_rows(checked).collect()}
    assert bad[2] == ("date", "n/a,1,2,3,4,5") and bad[3] == ("no date", ",1,2,3,4,5") and bad[4] == ("columns", "31-Dec-13,1,2")
    assert bad[5][0] == "no date" and bad[11] == bad[5]


def test_pairs_are_a_constant(spark):
    """The pairs of a matrix are folded before any row is read."""
    rows = spark.range(4).select((F.col("id") % 2).alias("k"), F.array(F.col("id").cast("double"), F.lit(1.0), F.lit(None).cast("double")).alias("z"))
    moments = matrix.pair_moments(rows, "k", "z", 3, {"": None})
    line = next(x for x in optimized(moments).splitlines() if "Generate" in x)
    assert "lambda" not in line and "from_json" not in line
    got = {r.k: r for r in moments.collect()}
    assert got[0].n == 2 and got[0]["mean"] == [1.0, 1.0, None] and got[0]["cov"] == [1.0, 0.0, None, 0.0, None, None]


def test_models_meet_scenarios_as_numbers_in_many_tasks(spark, monkeypatch):
    """The lambda of the returns reads no array element, and models that lie in one partition are spread."""
    monkeypatch.setattr(instruments, "TASKS_PER_SLOT", 5)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 2))
    draws = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "trial_id bigint, x_p double, x_q double")
    rows = [("a", 1.0, 2.0, -1.0), ("flat", 0.5, 0.0, 0.0), (None, 0.1, 0.2, 0.3), ("void", None, 1.0, 1.0)]
    models = spark.createDataFrame(rows, "symbol string, intercept double, w_p double, w_q double").coalesce(1)
    out = instruments.instrument_trials(models, draws, ["p", "q"], 40, 0.1)
    plan = optimized(out)
    line = next(x for x in plan.splitlines() if "sort_array(transform(cells" in x)
    assert "model" not in line
    assert "RepartitionByExpression [symbol" in plan and f", {5 * spark.sparkContext.defaultParallelism}" in plan
    f = x + np.sign(x) * x * x + np.sign(x) * np.sqrt(np.abs(x))
    got = {r.symbol: r for r in out.collect()}
    assert set(got) == {"a", "flat", None}
    for name, b, p, q in rows[:3]:
        v = np.sort(b + f @ np.array([p, q]))
        r = got[name]
        # Equal returns beyond the rank belong to the tail.
        tail = v[v <= v[3]]
        assert (r.trials, r.min, r.max) == (40, pytest.approx(v[0]), pytest.approx(v[-1]))
        assert r.value_at_risk == pytest.approx(v[3]) and r.conditional_var == pytest.approx(tail.mean())
        assert r.mean == pytest.approx(v.mean()) and r.stddev == pytest.approx(v.std(), abs=1e-12)
