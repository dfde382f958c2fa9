"""Hand-worked goldens, one per operator and decided quirk."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from montevar.functions.numeric import round3
from montevar.functions.parsing import (INDEX_CSV_DATE, INDEX_TSV_DATE, STOCK_DATE, parse_date_text,
                                        parse_number_text)
from montevar.operators import backtest, features, risk, series

D = dt.date


def test_horizon_frame_keeps_only_wide_gaps(spark):
    rows = [("X", D(2013, 1, 31), 10.0), ("X", D(2013, 1, 20), 9.0), ("X", D(2013, 1, 17), 8.0),
            ("X", D(2013, 1, 16), 7.0), ("X", D(2013, 1, 10), 6.0), ("X", D(2013, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, open double")
    out = series.horizon_returns(df, "symbol").collect()
    assert [(r.date, r.fluct) for r in out] == [(D(2013, 1, 31), 0.25)]


def test_zero_old_price_uses_epsilon(spark):
    df = spark.createDataFrame([("X", D(2013, 1, 1), 0.0), ("X", D(2013, 1, 13), 1.0)],
                               "symbol string, date date, open double")
    out = series.horizon_returns(df, "symbol").collect()
    assert out[0].fluct == pytest.approx((1.0 - 1e-8) / 1e-8)


def test_fill_recent_carries_forward_then_mean(spark):
    rows = [("X", D(2013, 1, 4), 4.0), ("X", D(2013, 1, 3), None), ("X", D(2013, 1, 2), 2.0),
            ("X", D(2013, 1, 1), None)]
    df = spark.createDataFrame(rows, "symbol string, date date, open double")
    got = {r.date: r.open for r in series.fill_recent(df, "symbol").collect()}
    assert got[D(2013, 1, 4)] == 4.0 and got[D(2013, 1, 3)] == 2.0 and got[D(2013, 1, 2)] == 2.0
    assert got[D(2013, 1, 1)] == pytest.approx(8.0 / 3)


def test_dedup_keeps_one_row_per_day(spark):
    df = spark.createDataFrame([("X", D(2013, 1, 1), 1.0), ("X", D(2013, 1, 1), 3.0), ("X", D(2013, 1, 1), None)],
                               "symbol string, date date, open double")
    assert series.dedup_series(df, "symbol").collect()[0].open == 3.0


def test_period_filter_is_inclusive(spark):
    df = spark.createDataFrame([(D(2013, 1, 1),), (D(2013, 12, 31),), (D(2014, 1, 1),), (D(2012, 12, 31),)], "date date")
    assert series.filter_period(df, "2013-01-01", "2013-12-31").count() == 2


def test_number_parser(spark):
    df = spark.createDataFrame([("1,200.00",), ("-1.5",), ("abc",), (None,), ("1.2.3",), ("1e5",)], "s string")
    got = [r.v for r in df.select(parse_number_text("s").alias("v")).collect()]
    assert got == [1200.0, None, None, None, None, None]
    neg = [r.v for r in df.select(parse_number_text("s", allow_negative=True).alias("v")).collect()]
    assert neg[1] == -1.5


@pytest.mark.parametrize("text,fmt,want", [
    ("31-Dec-13", STOCK_DATE, D(2013, 12, 31)), ("Dec 31, 2013", INDEX_TSV_DATE, D(2013, 12, 31)),
    ("2013-12-31", INDEX_CSV_DATE, D(2013, 12, 31)), ("31-Dec-70", STOCK_DATE, D(1970, 12, 31)),
    ("01-Jan-68", STOCK_DATE, D(2068, 1, 1)), ("junk", STOCK_DATE, None)])
def test_date_parser(spark, text, fmt, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(parse_date_text("s", fmt).alias("d")).collect()[0].d == want


def test_feature_transform(spark):
    df = spark.createDataFrame([(0.04,), (-0.04,), (0.0,)], "f double")
    got = [r.x for r in df.select(features.feature_of(F.col("f")).alias("x")).collect()]
    assert got[0] == pytest.approx(0.2416) and got[1] == pytest.approx(-0.2416) and got[2] == 0.0


def test_round3_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.0625,), (-0.0625,), (-0.0004,), (1.23449,)], "x double")
    got = [r.y for r in df.select(round3(F.col("x")).alias("y")).collect()]
    assert got == [0.063, -0.063, 0.0, 1.234]
    assert math.copysign(1.0, got[2]) == 1.0


def test_var_and_cvar_on_1_to_100(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("average_return"))
    assert risk.value_at_risk(df).collect()[0].value_at_risk == 5.0
    c = risk.conditional_var(df).collect()[0]
    assert (c.value_at_risk, c.conditional_var) == (5.0, 3.0)


def test_bootstrap_interval_positions():
    assert risk.ci_indices(100, 0.05) == (1, 97)


def test_backtest_statistics_at_expected_rate(spark):
    df = spark.createDataFrame([(5, 100)], "failures bigint, size bigint")
    b = backtest.binomial_z(df, 0.05).collect()[0].binomial_z
    k = backtest.kupiec(df, 0.05).collect()[0].kupiec_pof
    assert b == pytest.approx(0.0) and k == pytest.approx(0.0, abs=1e-12)
    z = spark.createDataFrame([(0, 100), (100, 100)], "failures bigint, size bigint")
    ks = [r.kupiec_pof for r in backtest.kupiec(z, 0.05).collect()]
    assert ks[0] == pytest.approx(-2 * 100 * math.log(0.95)) and ks[1] == pytest.approx(-2 * 100 * math.log(0.05))


def test_chi2_density_and_rejection(spark):
    df = spark.createDataFrame([(5, 100), (20, 100)], "failures bigint, size bigint")
    rows = backtest.chi2_density(df, 0.05).collect()
    assert rows[0].reject is False
    s = rows[1].kupiec_pof
    assert rows[1].chi2_pdf == pytest.approx(math.exp(-s / 2) / math.sqrt(2 * math.pi * s))
    assert rows[1].reject is True


def test_failure_count_units(spark):
    rows = [("A", D(2013, 1, 1), -0.2), ("A", D(2013, 1, 2), -0.1), ("B", D(2013, 1, 1), 0.3),
            ("C", D(2013, 1, 1), -0.01)]
    df = spark.createDataFrame(rows, "symbol string, date date, fluct double")
    ref = backtest.count_failures(df, -0.05).collect()[0]
    assert (ref.failures, ref.size) == (1, 4)
    obs = backtest.count_failures(df, -0.05, unit="observation").collect()[0]
    assert (obs.failures, obs.size) == (2, 4)


def test_split_by_rank_is_exact(spark):
    df = spark.createDataFrame([("X", k, 0.0) for k in range(11)], "symbol string, k int, label double")
    train = sorted(r.k for r in features.split_train(df).collect())
    test = sorted(r.k for r in features.split_test(df).collect())
    assert train == list(range(9)) and test == [9, 10]


def test_cluster_by_key_layout(spark):
    df = spark.createDataFrame([("A", D(2013, 1, d)) for d in (1, 5, 3)] + [("B", D(2013, 1, 2))],
                               "symbol string, date date")
    out = series.cluster_by_key(df, "symbol")
    parts = out.rdd.glom().collect()
    for part in parts:
        syms = [r.symbol for r in part]
        assert syms == sorted(syms)
        for s in set(syms):
            ds = [r.date for r in part if r.symbol == s]
            assert ds == sorted(ds, reverse=True)
    assert out.count() == 4


def test_rounding_leaves_huge_values_alone(spark):
    from montevar.functions.numeric import round_half_away
    df = spark.createDataFrame([(1.23456789012e12,), (-3.5e300,), (2.0000000004,), (None,)], "x double")
    got = [r.y for r in df.select(round_half_away(F.col("x"), 9).alias("y")).collect()]
    assert got == [1.23456789012e12, -3.5e300, 2.0, None]
