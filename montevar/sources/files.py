"""Readers for the raw inputs: symbol list, per-symbol price CSVs, factor files.

Each reader is one ``spark.read`` over a whole folder (files split across tasks),
an all-STRING landing schema, then native parse expressions.  No file is opened
on the driver and no Python runs per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from montevar.functions.exprs import computed_once
from montevar.functions.parsing import (INDEX_CSV_DATE, INDEX_TSV_DATE, STOCK_DATE,
                                        nan_to_null, parse_date_text, parse_number_text)

# Column layouts of the raw files.
STOCK_COLUMNS = ["Date", "Open", "High", "Low", "Close", "Volume"]
FACTOR_COLUMNS = ["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"]


def _string_schema(names) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names])


def load_symbols(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line, trimmed; blank lines dropped.  Column ``symbol``."""
    sym = F.trim(F.col("value"))
    return spark.read.text(path).select(sym.alias("symbol")).where(F.length("symbol") > 0)


def symbol_of_file() -> Column:
    """The scanned file's name without ``.csv``.  File metadata is URL-encoded; a plus sign stays one."""
    name = F.try_url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(name, r"^(.*)\.csv$", 1)


def _holds_csv(spark: SparkSession, directory: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(directory.rstrip("/") + "/*.csv")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_price_text(spark: SparkSession, directory: str) -> DataFrame:
    """All ``<symbol>.csv`` files of a folder as STRING columns plus ``symbol``.

    Missing, zero-byte and header-only files contribute no rows, nor does a folder
    without files.  The symbol is the file name without ``.csv``, read from the scan's file metadata.
    """
    if not _holds_csv(spark, directory):
        return spark.createDataFrame([], _string_schema([*STOCK_COLUMNS, "symbol"]))
    raw = (spark.read.schema(_string_schema(STOCK_COLUMNS))
           .option("header", True).option("mode", "PERMISSIVE")
           .csv(directory.rstrip("/") + "/*.csv"))
    return raw.select(*STOCK_COLUMNS, symbol_of_file().alias("symbol"))


def read_price_folders(spark: SparkSession, directory: str) -> DataFrame:
    """The same of a folder with one ``symbol=<symbol>`` folder for each symbol, as Spark writes a table by symbol.

    A symbol is what its folder is named, whatever it looks like: ``007`` stays text.
    """
    return (spark.read.schema(_string_schema([*STOCK_COLUMNS, "symbol"])).option("header", True).option("mode", "PERMISSIVE")
            .csv(directory).select(*STOCK_COLUMNS, "symbol"))


def parse_prices(raw: DataFrame, date_format: str = STOCK_DATE,
                 numeric=("Open", "High", "Low")) -> DataFrame:
    """Typed price rows ``symbol, date, open, high, low, close, volume``.

    Columns named in ``numeric`` are parsed with the thousands-comma rule; the
    others stay text as landed.  Rows whose date does not parse are dropped.
    """
    out = []
    for c in STOCK_COLUMNS[1:]:
        expr = nan_to_null(parse_number_text(c)) if c in numeric else F.col(c)
        out.append(expr.alias(c.lower()))
    df = raw.select("symbol", parse_date_text("Date", date_format).alias("date"), *out)
    return computed_once(df, df.columns[1:]).where(F.col("date").isNotNull())


#: Column of a damaged line, and what its rows are refused for.
CORRUPT = "_corrupt_record"
REASONS = ("columns", "no date", "date")


def read_price_records(spark: SparkSession, directory: str) -> DataFrame:
    """``read_price_text`` with ``file`` and, of lines without exactly the stock columns, the line itself in ``CORRUPT``."""
    if not _holds_csv(spark, directory):
        return spark.createDataFrame([], _string_schema([*STOCK_COLUMNS, CORRUPT, "symbol", "file"]))
    raw = (spark.read.schema(_string_schema([*STOCK_COLUMNS, CORRUPT])).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).csv(directory.rstrip("/") + "/*.csv"))
    return raw.select(*STOCK_COLUMNS, CORRUPT, symbol_of_file().alias("symbol"), F.col("_metadata.file_name").alias("file"))


def checked_prices(raw: DataFrame, date_format: str = STOCK_DATE, numeric=("Open", "High", "Low")) -> DataFrame:
    """Every landed row, typed, with ``reason``, ``nulled`` and ``record`` beside the columns of ``parse_prices``.

    ``reason`` is NULL for a good row, else what refuses it: ``columns`` (a line with too few or too many fields),
    ``no date`` (empty) or ``date`` (not one).  ``nulled`` names the numeric columns whose text is no number (comma between
    them, empty if none); such a row is good, its value NULL.  ``record`` is the refused row as text.  Other columns
    (file, line keys) pass through.
    """
    others = [c for c in raw.columns if c not in (*STOCK_COLUMNS, CORRUPT, "symbol")]
    texts = [*STOCK_COLUMNS, *([CORRUPT] if CORRUPT in raw.columns else [])]
    value = lambda c: nan_to_null(parse_number_text(c)) if c in numeric else F.col(c)
    parsed = raw.select(*others, "symbol", *texts, parse_date_text("Date", date_format).alias("_date"),
                        *[value(c).alias(f"_{c.lower()}") for c in STOCK_COLUMNS[1:]])
    parsed = computed_once(parsed, parsed.columns[len(others) + 1:])
    damaged = F.col(CORRUPT).isNotNull() if CORRUPT in texts else F.lit(False)
    reason = (F.when(damaged, REASONS[0]).when(F.coalesce(F.trim("Date"), F.lit("")) == "", REASONS[1])
              .when(F.col("_date").isNull(), REASONS[2]))
    bad = []
    for c in numeric:
        text = F.lower(F.trim(F.col(c)))
        bad.append(F.when(F.col(f"_{c.lower()}").isNull() & (text != "") & (text != "nan"), F.lit(c)))
    whole = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in STOCK_COLUMNS])
    record = F.coalesce(F.col(CORRUPT), whole) if CORRUPT in texts else whole
    return parsed.select(*others, "symbol", F.col("_date").alias("date"), *[F.col(f"_{c.lower()}").alias(c.lower()) for c in STOCK_COLUMNS[1:]],
                         reason.alias("reason"), F.concat_ws(",", *bad).alias("nulled"), F.when(reason.isNotNull(), record).alias("record"))


def good_rows(checked: DataFrame) -> DataFrame:
    """The typed rows of ``checked_prices``."""
    return checked.where(F.col("reason").isNull()).drop("reason", "record")


def rejected_rows(checked: DataFrame) -> DataFrame:
    """Its refused rows: file and line keys, if any, ``symbol, reason, record``."""
    typed = ["date", *[c.lower() for c in STOCK_COLUMNS[1:]], "nulled"]
    return checked.where(F.col("reason").isNotNull()).drop(*typed)


def load_prices(spark: SparkSession, directory: str, symbols: DataFrame | None = None,
                date_format: str = STOCK_DATE, by_folder: bool = False) -> DataFrame:
    """Scan a folder of per-symbol CSVs (``by_folder``: per-symbol folders); keep only listed symbols (left-semi join)."""
    read = read_price_folders if by_folder else read_price_text
    df = parse_prices(read(spark, directory), date_format)
    if symbols is not None:
        df = df.join(symbols.select("symbol"), "symbol", "left_semi")
    return df


def load_factor_file(spark: SparkSession, path: str, factor: str, sep: str = ",",
                     date_format: str = INDEX_CSV_DATE) -> DataFrame:
    """One factor file (header row; columns taken by position) as the long factor layout.

    Values are numbers with optional thousands commas, sign and exponent: rates may be negative.
    """
    raw = spark.read.option("header", True).option("sep", sep).schema(
        _string_schema(FACTOR_COLUMNS)).csv(path)
    return parse_factor(raw.withColumn("factor", F.lit(factor)), date_format)


def parse_factor(raw: DataFrame, date_format: str = INDEX_CSV_DATE) -> DataFrame:
    """Typed factor rows ``factor, date, open, ...`` of landed text columns."""
    cols = [nan_to_null(parse_number_text(c, allow_negative=True)).alias(c.lower().replace(" ", "_"))
            for c in FACTOR_COLUMNS[1:]]
    df = raw.select("factor", parse_date_text("Date", date_format).alias("date"), *cols)
    return computed_once(df, df.columns[1:]).where(F.col("date").isNotNull())


def load_factors(spark: SparkSession, specs) -> DataFrame:
    """Union of factor files into one long ``factor, date, open, ...`` table.

    ``specs``: iterable of ``(factor, path, sep, date_format)``; e.g. a TSV index
    file with ``INDEX_TSV_DATE`` and CSV files with ``INDEX_CSV_DATE``.
    """
    frames = [load_factor_file(spark, path, name, sep, fmt) for name, path, sep, fmt in specs]
    return reduce(lambda a, b: a.unionByName(b), frames)


def default_factor_specs(directory: str):
    """The four market factors: one TSV index file and three CSV files."""
    d = directory.rstrip("/")
    return [("GSPC", f"{d}/GSPC.txt", "\t", INDEX_TSV_DATE),
            ("IXIC", f"{d}/IXIC.csv", ",", INDEX_CSV_DATE),
            ("FVX", f"{d}/FVX.csv", ",", INDEX_CSV_DATE),
            ("TYX", f"{d}/TYX.csv", ",", INDEX_CSV_DATE)]


def columns_of_lines(lines: DataFrame, columns, sep: str = ",", corrupt: bool = False) -> DataFrame:
    """Text columns of file lines that are rows of a table already (column ``line``); with ``corrupt`` also ``CORRUPT``."""
    names = [*columns, CORRUPT] if corrupt else columns
    schema = ", ".join(f"`{c}` string" for c in names)
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT} if corrupt else {"sep": sep}
    others = [c for c in lines.columns if c != "line"]
    return lines.select(*others, F.from_csv("line", schema, options).alias("_c")).select(*others, "_c.*")
