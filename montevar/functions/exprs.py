"""Two renderings of the same arithmetic: Spark Columns and SQL text.

The numeric builders (rounding, keyed uniforms, normals, elimination, Cholesky)
are written once against the small ``Ops`` interface below.  ``SPARK`` yields
``pyspark.sql.Column`` objects used by the engine; ``SQL`` yields plain SQL text
used only for the independent DuckDB oracle in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _num(v: float) -> str:
    return repr(float(v))


class SparkOps:
    """Column-producing operations (JVM side, code-generated)."""

    def col(self, name: str) -> Column:
        return F.col(name)

    def lit(self, v: float) -> Column:
        return F.lit(float(v))

    def add(self, a, b):
        return a + b

    def sub(self, a, b):
        return a - b

    def mul(self, a, b):
        return a * b

    def div(self, a, b):
        # ANSI mode raises on x / 0; a NULL coefficient is the wanted outcome.
        return F.try_divide(a, b)

    def sqrt(self, a):
        return F.sqrt(a)

    def ln(self, a):
        return F.log(a)

    def cos(self, a):
        return F.cos(a)

    def abs(self, a):
        return F.abs(a)

    def sign(self, a):
        return F.signum(a)

    def floor(self, a):
        return F.floor(a).cast("double")

    def greatest(self, a, b):
        return F.greatest(a, b)

    def if_pos(self, cond, then, other):
        """``then`` where ``cond > 0`` else ``other``."""
        return F.when(cond > 0, then).otherwise(other)

    def gt(self, a, b):
        return F.when(a > b, F.lit(1.0)).otherwise(F.lit(0.0))

    def md5_u52(self, key):
        """First 52 bits of md5(key) as a non-negative double (exact)."""
        return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")

    def concat_key(self, prefix: str, id_col: str):
        return F.concat(F.lit(prefix), F.col(id_col).cast("string"))

    def sum(self, items):
        items = list(items)
        out = items[0]
        for it in items[1:]:
            out = out + it
        return out


class SqlOps:
    """SQL-text producing operations (DuckDB dialect, oracle only)."""

    def col(self, name: str) -> str:
        return f'"{name}"'

    def lit(self, v: float) -> str:
        return f"CAST({_num(v)} AS DOUBLE)"

    def add(self, a, b):
        return f"({a} + {b})"

    def sub(self, a, b):
        return f"({a} - {b})"

    def mul(self, a, b):
        return f"({a} * {b})"

    def div(self, a, b):
        return f"({a} / NULLIF({b}, CAST(0 AS DOUBLE)))"

    def sqrt(self, a):
        return f"sqrt({a})"

    def ln(self, a):
        return f"ln({a})"

    def cos(self, a):
        return f"cos({a})"

    def abs(self, a):
        return f"abs({a})"

    def sign(self, a):
        return f"CAST(sign({a}) AS DOUBLE)"

    def floor(self, a):
        return f"floor({a})"

    def greatest(self, a, b):
        return f"greatest({a}, {b})"

    def if_pos(self, cond, then, other):
        return f"(CASE WHEN {cond} > 0 THEN {then} ELSE {other} END)"

    def gt(self, a, b):
        return f"(CASE WHEN {a} > {b} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"

    def md5_u52(self, key):
        return f"CAST(CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) AS DOUBLE)"

    def concat_key(self, prefix: str, id_col: str):
        return f"('{prefix}' || CAST({id_col} AS VARCHAR))"

    def sum(self, items):
        items = list(items)
        return "(" + " + ".join(items) + ")"


SPARK = SparkOps()
SQL = SqlOps()


def apply_stages(df: DataFrame, stages) -> DataFrame:
    """Append each stage's ``(name, Column)`` list as new columns, one projection per stage."""
    for stage in stages:
        df = df.select("*", *[expr.alias(name) for name, expr in stage])
    return df


def sql_stages(source: str, stages, prefix: str) -> tuple[list[str], str]:
    """Render stages as chained CTEs; returns (cte definitions, last cte name)."""
    ctes, prev = [], source
    for i, stage in enumerate(stages):
        name = f"{prefix}{i}"
        cols = ", ".join(f'{expr} AS "{n}"' for n, expr in stage)
        ctes.append(f"{name} AS (SELECT *, {cols} FROM {prev})")
        prev = name
    return ctes, prev


def computed_once(df: DataFrame, names) -> DataFrame:
    """The same rows and columns; the columns ``names`` are computed once a row, whatever is filtered or projected later.

    A filter on a computed column is pushed to the scan with all that the column is computed from, and an alias read often
    is copied into each of its readers: text is then parsed several times a row.  Neither passes the generator,
    which hands on one row for each row; filters on the other columns do.
    """
    held = set(names)
    passing = [F.col(f"`{c}`") for c in df.columns if c not in held]
    cells = F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns if c in held]))
    return df.select(*passing, F.inline(cells)).select(*[F.col(f"`{c}`") for c in df.columns])
