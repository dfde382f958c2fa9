"""Daily series operators: period filter, dedup, gap fill, horizon returns, summaries.

Scale note.  Every per-key window here runs *after* ``dedup_series``, which
leaves at most one row per (key, date).  A window partition therefore holds at
most the number of calendar days in the period, whatever the data volume or the
key skew of the raw feed; the raw duplicates are collapsed by a hash aggregate
with map-side partial aggregation before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from montevar.functions.numeric import round3

# Floor of an old price in the return's denominator, the horizon
# of a return in calendar days, and the minimum span a return must cover.
EPS_PRICE = 1e-8
HORIZON_DAYS = 14
MIN_GAP_DAYS = 10
# Fixed value: the same horizon in trading days (two weeks).
HORIZON_ROWS = 10


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def filter_period(df: DataFrame, start: str | None, end: str | None, date_col: str = "date") -> DataFrame:
    """Rows with ``start <= date <= end`` (both inclusive; either end may be open)."""
    c = F.col(date_col)
    if start:
        df = df.where(c >= F.lit(start).cast("date"))
    if end:
        df = df.where(c <= F.lit(end).cast("date"))
    return df


def drop_missing_dates(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.na.drop(subset=[date_col])


def dedup_series(df: DataFrame, key, date_col: str = "date", value_cols=("open",)) -> DataFrame:
    """Exactly one row per (key, date): the largest non-NULL value of each column.

    Deterministic, unlike a full-row ``dropDuplicates`` that keeps two rows for a
    day with two different prices.
    """
    keys = _keys(key) + [date_col]
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in value_cols])


def fill_recent(df: DataFrame, key, order: str = "date", cols=("open",)) -> DataFrame:
    """Fill NULLs with the latest earlier value of the same key; leading gaps with
    the key's mean of the carried-forward series."""
    keys = _keys(key)
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    out = df
    for c in cols:
        carried = F.last(c, ignorenulls=True).over(run)
        out = out.withColumn(c, carried)
        out = out.withColumn(c, F.coalesce(F.col(c), F.avg(c).over(whole)))
    return out


def horizon_return(open_now: Column, open_then: Column, gap_days: Column, min_gap_days: int) -> Column:
    """Relative change over the horizon, rounded to 3 places; NULL if the frame is
    not wider than ``min_gap_days`` or a price is missing."""
    base = F.greatest(open_then, F.lit(EPS_PRICE))
    ok = (gap_days > min_gap_days) & open_now.isNotNull() & open_then.isNotNull()
    return F.when(ok, round3((open_now - base) / base))


def horizon_returns(df: DataFrame, key, value: str = "open", date_col: str = "date",
                    horizon_days: int = HORIZON_DAYS, min_gap_days: int = MIN_GAP_DAYS, day_col: str | None = None,
                    keep_day: bool = False) -> DataFrame:
    """One return per row: current value against the oldest value within
    ``horizon_days`` calendar days before it (inclusive).  Rows whose oldest
    in-frame day is not more than ``min_gap_days`` back are dropped.

    ``day_col`` names an existing integer day number (``unix_date``) to order by;
    reusing the ordering column of ``fill_recent`` lets both windows share one
    sort.  Output: key columns, ``date``, ``open``, ``fluct`` (and the day column
    when ``keep_day``).
    """
    keys = _keys(key)
    day = day_col or "_day"
    framed = df if day_col else df.withColumn(day, F.unix_date(F.col(date_col)))
    framed = framed.select(*keys, date_col, value, day)
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-horizon_days, 0)
    framed = framed.select(*keys, date_col, value, day,
                           (F.col(day) - F.first(day).over(w)).alias("_gap"),
                           F.first(value).over(w).alias("_open0"))
    fluct = horizon_return(F.col(value), F.col("_open0"), F.col("_gap"), min_gap_days)
    extra = [day] if keep_day else []
    out = framed.select(*keys, date_col, value, fluct.alias("fluct"), *extra)
    return out.where(F.col("fluct").isNotNull())


def horizon_rows_returns(df: DataFrame, key, value: str = "open", date_col: str = "date", horizon_rows: int = HORIZON_ROWS,
                         day_col: str | None = None) -> DataFrame:
    """One return per row over ``horizon_rows`` trading days: current value against that many rows before.

    Rows without so long a history are dropped.  Output: key columns, ``date``, ``open``, ``fluct`` (and the day
    column when one is given).
    """
    keys = _keys(key)
    order = day_col or date_col
    w = Window.partitionBy(*keys).orderBy(order)
    extra = [day_col] if day_col else []
    framed = df.select(*keys, date_col, value, *extra, F.lag(value, horizon_rows).over(w).alias("_open0"),
                       F.row_number().over(w).alias("_rn"))
    fluct = horizon_return(F.col(value), F.col("_open0"), F.col("_rn") - 1, horizon_rows - 1)
    return framed.select(*keys, date_col, value, fluct.alias("fluct"), *extra).where(F.col("fluct").isNotNull())


def cluster_by_key(df: DataFrame, key, date_col: str = "date") -> DataFrame:
    """Layout helper: hash-partition by key, newest first within each partition.

    Only worth it when the layout is written out (e.g. before ``write.parquet``);
    within one plan the per-key windows already request this partitioning and
    Catalyst plans a single exchange for all of them.
    """
    keys = _keys(key)
    return df.repartition(*keys).sortWithinPartitions(*keys, F.desc(date_col))


def store_series(df: DataFrame, table: str, path: str | None = None, key: str = "symbol", buckets: int = 64,
                 date_col: str = "date") -> DataFrame:
    """Write a series table partitioned by year, bucketed by key and sorted by date; give it back as ``stored_series`` does.

    Everything per key (dedup, fill, frame, rank, fit) reads it without an exchange, and a period opens the
    folders of its years only.  Rows meet by key once, here: each task writes whole buckets.  ``table`` is the name in the
    catalog, replaced if it exists; ``path`` the folder of an external table.
    """
    dated = df.withColumn("year", F.year(date_col)).repartition(buckets, key)
    writer = (dated.write.mode("overwrite").format("parquet").partitionBy("year").bucketBy(buckets, key).sortBy(key, date_col))
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return stored_series(df.sparkSession, table, date_col=date_col)


def stored_series(spark, table: str, start: str | None = None, end: str | None = None, date_col: str = "date") -> DataFrame:
    """The stored table within a period (inclusive): only the folders of its years are opened."""
    df = spark.table(table)
    if start:
        df = df.where(F.col("year") >= int(start[:4]))
    if end:
        df = df.where(F.col("year") <= int(end[:4]))
    return filter_period(df, start, end, date_col).drop("year")


def daily_mean_return(returns: DataFrame, date_col: str = "date", value: str = "fluct") -> DataFrame:
    """Equal-weight portfolio return per day: ``date, avg_return``."""
    return returns.groupBy(date_col).agg(F.avg(value).alias("avg_return"))


def summarize(df: DataFrame, col: str, by=None) -> DataFrame:
    """count, mean, sample stddev, min, max of one column (optionally per group)."""
    aggs = [F.count(col).alias("count"), F.avg(col).alias("mean"),
            F.stddev_samp(col).alias("stddev"), F.min(col).alias("min"), F.max(col).alias("max")]
    if by is None:
        return df.agg(*aggs)
    return df.groupBy(*_keys(by)).agg(*aggs)


def summarize_columns(df: DataFrame, cols, by=None) -> DataFrame:
    """``summarize`` of several columns in one pass: a row per column (and group), named in ``column``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in cols])
    keys = _keys(by) if by else []
    return summarize(df.select(*keys, F.inline(cells)), "_v", by=[*keys, "column"])
