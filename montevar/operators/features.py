"""Factor features, recency alignment, design rows and the rank split.

The feature table has one row per recency rank ``k``; ``k`` is below the number
of dated rows of the shortest factor series, so its size is bounded by the
number of days in the period.  That bound is what allows broadcasting it into
the (large) per-instrument design join.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def recency_rank(df: DataFrame, key, date_col: str = "date", name: str = "k",
                 ascending_order: str | None = None) -> DataFrame:
    """``k`` = 0 for the newest row of each key, 1 for the next older, ...

    With ``ascending_order`` (a column that increases with the date, unique per
    key) the rank is ``count - row_number`` over that ascending order, so it
    reuses the sort of the fill and horizon windows instead of adding a
    descending one.
    """
    keys = _keys(key)
    if ascending_order:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        rn = F.row_number().over(Window.partitionBy(*keys).orderBy(ascending_order))
        return df.withColumn(name, (n - rn).cast("int"))
    w = Window.partitionBy(*keys).orderBy(F.desc(date_col))
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("int"))


def feature_of(f: Column) -> Column:
    """``f + sign(f) f^2 + sign(f) sqrt(|f|)``."""
    s = F.signum(f)
    return f + s * f * f + s * F.sqrt(F.abs(f))


def factor_features(factor_returns: DataFrame, key: str = "factor", order_col: str | None = None) -> DataFrame:
    """Per factor row: ``factor, date, k, fluct, feat``."""
    extra = [order_col] if order_col else []
    ranked = recency_rank(factor_returns.select(key, "date", "fluct", *extra), key, ascending_order=order_col)
    return ranked.select(key, "date", "k", "fluct", feature_of(F.col("fluct")).alias("feat"))


def feature_name(factor: str) -> str:
    return f"{factor}_feat"


def feature_table(ff: DataFrame, factors, value: str = "feat", align: str = "rank",
                  key: str = "factor") -> DataFrame:
    """Wide table ``k, <factor>_feat ...``: the k-th newest value of every factor.

    Only ranks present in *every* factor are kept (the shortest series decides).
    ``align='date'`` aligns equal dates instead and re-ranks the common dates.
    """
    if align not in ("rank", "date"):
        raise ValueError("align must be 'rank' or 'date'")
    on = "k" if align == "rank" else "date"
    cols = [F.max(F.when(F.col(key) == f, F.col(value))).alias(feature_name(f)) for f in factors]
    wide = ff.groupBy(on).agg(*cols).na.drop()
    if align == "rank":
        return wide
    # Dates common to all factors: at most the days of the period, one partition is fine.
    w = Window.orderBy(F.desc("date"))
    return wide.withColumn("k", (F.row_number().over(w) - 1).cast("int")).drop("date")


def min_factor_rows(factor_returns: DataFrame, key: str = "factor") -> DataFrame:
    """Length of the shortest factor series: ``min_rows``."""
    return factor_returns.groupBy(key).count().agg(F.min("count").alias("min_rows"))


def design(returns: DataFrame, features: DataFrame, key: str = "symbol",
           order_col: str | None = None) -> DataFrame:
    """Per instrument row with recency rank ``k``: ``symbol, k, label, <features>``.

    The feature table has one row per rank, at most as many as there are calendar days in the
    study (a century has 36 525), whatever the data volume; it is broadcast, so the returns keep their
    partitioning by instrument.
    """
    extra = [order_col] if order_col else []
    ranked = recency_rank(returns.select(key, "date", "fluct", *extra), key, ascending_order=order_col)
    j = ranked.join(F.broadcast(features), "k")
    fcols = [c for c in features.columns if c != "k"]
    return j.select(key, "k", F.col("fluct").alias("label"), *fcols)


def split_by_rank(design_rows: DataFrame, ratio: float = 0.8, key: str = "symbol") -> DataFrame:
    """Adds ``is_train``: newest rows ``k <= ratio * max(k)`` train, the oldest rest test.

    The comparison is exact decimal arithmetic, so no row flips side by rounding.
    """
    w = Window.partitionBy(*_keys(key))
    limit = F.lit(Decimal(str(ratio))).cast("decimal(10,6)") * F.max("k").over(w)
    return design_rows.withColumn("is_train", F.col("k") <= limit)


def split_train(design_rows: DataFrame, ratio: float = 0.8, key: str = "symbol") -> DataFrame:
    return split_by_rank(design_rows, ratio, key).where("is_train").drop("is_train")


def split_test(design_rows: DataFrame, ratio: float = 0.8, key: str = "symbol") -> DataFrame:
    return split_by_rank(design_rows, ratio, key).where(~F.col("is_train")).drop("is_train")
