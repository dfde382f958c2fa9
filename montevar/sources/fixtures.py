"""Price and factor series derived from the driver's TPC-H-style tables.

These views stand in for the raw market files (FIXTURES.md §3).  They are plain
scans, joins and aggregates over ``lineitem``/``part``/``supplier``, so their
work grows with the tables.  The identical definitions in SQL live in
``montevar.plans.oracle``.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from montevar.operators.series import dedup_series

# The factor series of the fixtures, and the period of the queries that cut one.
FACTORS = ["AF", "AO", "NF", "NO", "RF", "RO"]
PERIOD = ("1997-01-01", "1998-12-31")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table ``name``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ship_window(li: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Period predicate on the raw ship timestamp, so it reaches the Parquet scan."""
    ts_type = li.schema["l_shipdate"].dataType.simpleString()
    if start:
        li = li.where(F.col("l_shipdate") >= F.lit(start).cast(ts_type))
    if end:
        nxt = (date.fromisoformat(end) + timedelta(days=1)).isoformat()
        li = li.where(F.col("l_shipdate") < F.lit(nxt).cast(ts_type))
    return li


def raw_prices(spark: SparkSession, sf_dir: str, start: str | None = None,
               end: str | None = None) -> DataFrame:
    """One price observation per line item: ``symbol, sym_no, date, open`` (duplicates kept)."""
    li = _ship_window(table(spark, sf_dir, "lineitem")
                      .select("l_suppkey", "l_partkey", "l_discount", "l_shipdate"), start, end)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return j.select(F.col("l_suppkey").cast("string").alias("symbol"),
                    F.col("l_suppkey").alias("sym_no"),
                    F.col("l_shipdate").cast("date").alias("date"),
                    (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("open"))


def prices(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily price per symbol: ``symbol, date, open`` (max over the day's rows)."""
    return dedup_series(raw_prices(spark, sf_dir, start, end).drop("sym_no"), "symbol")


def prices_gaps(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """``prices`` with ``open`` NULL where ``(symbol + day number) % 7 = 0``."""
    p = dedup_series(raw_prices(spark, sf_dir, start, end), ["symbol", "sym_no"])
    gap = ((F.col("sym_no") + F.unix_date("date")) % 7) == 0
    return p.select("symbol", "date", F.when(~gap, F.col("open")).alias("open"))


def _daily_level(rows: DataFrame) -> DataFrame:
    """Exact mean of the decimal ``px`` by ``factor`` and ``date``."""
    return rows.groupBy("factor", "date").agg((F.sum("px").cast("double") / F.count(F.lit(1))).alias("open"))


def factors(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily factor level: ``factor, date, open`` = exact mean extended price of the day, one scan for all series."""
    li = _ship_window(table(spark, sf_dir, "lineitem")
                      .select("l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate"), start, end)
    return _daily_level(li.select(F.concat("l_returnflag", "l_linestatus").alias("factor"),
                                  F.col("l_shipdate").cast("date").alias("date"),
                                  F.col("l_extendedprice").cast("decimal(18,2)").alias("px")))


def order_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order level by order status, in the layout of ``factors``: another source of series."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", "o_totalprice")
    return _daily_level(o.select(F.concat(F.lit("order-"), "o_orderstatus").alias("factor"),
                                 F.col("o_orderdate").cast("date").alias("date"),
                                 F.col("o_totalprice").cast("decimal(18,2)").alias("px")))


def factor_series_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of both sources in one long table; each source is scanned once."""
    return factors(spark, sf_dir).unionByName(order_factors(spark, sf_dir))


def factor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors with two value columns and gaps: ``factor, date, open, close`` (gaps fall on different days)."""
    f = factors(spark, sf_dir)
    day = F.unix_date("date")
    return f.select("factor", "date", F.when(day % 5 != 0, F.col("open")).alias("open"),
                    F.when(day % 3 != 0, F.col("open") / 2).alias("close"))


def symbols(spark: SparkSession, sf_dir: str, region: str | None = None) -> DataFrame:
    """Symbol list ``symbol`` from ``supplier``; optionally only one region's suppliers."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    if region is not None:
        n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        r = table(spark, sf_dir, "region").select("r_regionkey", "r_name").where(F.col("r_name") == region)
        keys = n.join(r, n.n_regionkey == r.r_regionkey, "left_semi")
        s = s.join(keys, s.s_nationkey == keys.n_nationkey, "left_semi")
    return s.select(F.col("s_suppkey").cast("string").alias("symbol"))


def prices_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-text rows in the layouts of the market files, one per line item.

    Dates are printed as ``dd-MMM-yy``, ``MMM dd, yyyy`` and ``yyyy-MM-dd``; the
    price carries thousands commas.  Rows with return flag ``R`` carry the junk
    date ``n/a`` and a negative low price, which the parsers must turn into NULL.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate", "l_discount", "l_quantity")
    d = F.col("l_shipdate").cast("date")
    bad = F.col("l_returnflag") == "R"
    px = F.format_number("l_extendedprice", 2)
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_suppkey").cast("string").alias("symbol"),
        d.alias("ship_date"),
        F.when(bad, F.lit("n/a")).otherwise(F.date_format(d, "dd-MMM-yy")).alias("stock_date_text"),
        F.date_format(d, "MMM dd, yyyy").alias("tsv_date_text"),
        F.date_format(d, "yyyy-MM-dd").alias("csv_date_text"),
        px.alias("open_text"),
        F.when(bad, F.concat(F.lit("-"), px)).otherwise(px).alias("low_text"),
        F.concat("l_returnflag", "l_linestatus").alias("junk_text"), "l_discount", "l_quantity",
    )


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without an id: ``l_returnflag, l_linestatus, l_linenumber, l_shipmonth`` of every line item, many rows equal."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_returnflag", F.when(F.col("l_returnflag") != "A", F.col("l_linestatus")).alias("l_linestatus"), "l_linenumber",
                     F.date_format(F.col("l_shipdate").cast("date"), "yyyy-MM").alias("l_shipmonth"))


def price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the stock files, one per line item: ``l_orderkey, l_linenumber, symbol, line``."""
    t = prices_text(spark, sf_dir)
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    return t.select("l_orderkey", "l_linenumber", "symbol", F.concat_ws(
        ",", "stock_date_text", quoted("open_text"), quoted("open_text"), quoted("low_text"), quoted("open_text"),
        F.lit("100")).alias("line"))


def write_price_files(spark: SparkSession, sf_dir: str, path: str) -> tuple[str, str]:
    """Stock files by symbol and the list of Europe's symbols, written below ``path``; their two folders."""
    t = prices_text(spark, sf_dir)
    columns = zip(("Date", "Open", "High", "Low", "Close"), ("stock_date_text", "open_text", "open_text", "low_text", "open_text"))
    rows = t.select("symbol", *[F.col(c).alias(n) for n, c in columns], F.lit("100").alias("Volume"))
    rows.repartition("symbol").write.partitionBy("symbol").option("header", True).csv(f"{path}/stocks")
    symbols(spark, sf_dir, region="EUROPE").select(F.concat(F.lit(" "), "symbol").alias("value")).write.text(f"{path}/symbols")
    return f"{path}/stocks", f"{path}/symbols"


def damaged_price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``price_lines`` with damage by line number: 4 lacks its date, 5 has text for the open, 6 lacks a field, 7 has one too many."""
    lines, no = price_lines(spark, sf_dir), F.col("l_linenumber")
    line = (F.when(no == 4, F.regexp_replace("line", "^[^,]*", "")).when(no == 5, F.regexp_replace("line", '^([^,]*),"[^"]*"', "$1,none"))
            .when(no == 6, F.regexp_replace("line", ",100$", "")).when(no == 7, F.concat("line", F.lit(",x"))).otherwise(F.col("line")))
    return lines.withColumn("line", line)


def factor_lines(spark: SparkSession, sf_dir: str, tsv: bool) -> DataFrame:
    """Lines of the factor files, one per line item: ``l_orderkey, l_linenumber, factor, line``.

    The TSV layout has thousands commas; the CSV layout negative rates, exponents and NaN.
    """
    t = prices_text(spark, sf_dir)
    rate = F.format_number(F.col("l_discount") - 0.05, 2)
    volume = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("e3"))
    if tsv:
        values = ["tsv_date_text", *["open_text"] * 5, F.substring_index("open_text", ".", 1)]
    else:
        missing = F.when(F.col("l_linenumber") == 1, F.lit("NaN")).otherwise(rate)
        values = ["csv_date_text", rate, F.concat(F.lit("+"), F.col("l_linenumber").cast("string")), missing, rate, F.lit("null"),
                  volume]
    return t.select("l_orderkey", "l_linenumber", F.col("junk_text").alias("factor"),
                    F.concat_ws("\t" if tsv else ",", *values).alias("line"))
