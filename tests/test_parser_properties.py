"""Property tests of the text parsers against a plain-Python statement of their rules."""
import datetime as dt
import re

from hypothesis import HealthCheck, given, settings, strategies as st

from montevar.functions.parsing import STOCK_DATE, parse_date_text, parse_number_text

NUMBERISH = st.one_of(
    st.from_regex(r"\A-?[0-9]{0,7}(,[0-9]{3})*(\.[0-9]{0,3})?(\.[0-9])?\Z"),
    st.text(alphabet="0123456789.,-eE +", max_size=10),
    st.none(),
)


def expected_number(x):
    """Commas removed; only digits and dots accepted; malformed numbers are NULL."""
    if x is None:
        return None
    s = x.replace(",", "")
    if not re.fullmatch(r"[0-9.]+", s):
        return None
    try:
        return float(s)
    except ValueError:
        return None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(NUMBERISH, min_size=1, max_size=60))
def test_number_parser_matches_rule(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "s string")
    got = [r.v for r in df.select(parse_number_text("s").alias("v")).collect()]
    assert got == [expected_number(x) for x in xs]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dates(min_value=dt.date(1969, 1, 1), max_value=dt.date(2068, 12, 31)), min_size=1, max_size=60))
def test_two_digit_years_round_trip(spark, ds):
    texts = [d.strftime("%d-%b-%y") for d in ds]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.d for r in df.select(parse_date_text("s", STOCK_DATE).alias("d")).collect()]
    assert got == [dt.datetime.strptime(t, "%d-%b-%y").date() for t in texts]
