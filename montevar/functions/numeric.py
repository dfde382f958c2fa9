"""Numeric helpers shared by operators and oracle: rounding, keyed random numbers.

Random numbers are *keyed*: a draw is a pure function of (tag, row id), computed
with md5 inside the plan.  Results therefore never depend on partitioning,
retries or executor loss, and the same numbers can be produced in SQL.
"""

from __future__ import annotations

import math

from montevar.functions.exprs import SPARK, SQL

TWO_PI = 2.0 * math.pi
TWO_POW_52 = 4503599627370496.0


# Beyond 2^52 a double has no fractional digits left to round.
ROUND_LIMIT = 2.0 ** 52


def round_half_away(x, places: int, ops=SPARK):
    """``sign(x) * floor(|x| * 10^p + 0.5) / 10^p`` (+0.0 folds a signed zero).

    Values whose scaled magnitude reaches 2^52 are already coarser than 10^-p
    and pass through unchanged (this also keeps the floor inside 64 bits).
    """
    scale = ops.lit(10.0 ** places)
    scaled = ops.mul(ops.abs(x), scale)
    r = ops.div(ops.mul(ops.sign(x), ops.floor(ops.add(scaled, ops.lit(0.5)))), scale)
    return ops.add(ops.if_pos(ops.sub(ops.lit(ROUND_LIMIT), scaled), r, x), ops.lit(0.0))


def round3(x, ops=SPARK):
    return round_half_away(x, 3, ops)


def uniform_of(key, ops=SPARK):
    """Uniform on (0, 1) of a text key: ``(first 52 bits of md5(key) + 0.5) / 2^52``."""
    return ops.div(ops.add(ops.md5_u52(key), ops.lit(0.5)), ops.lit(TWO_POW_52))


def keyed_uniform(tag: str, id_col: str, ops=SPARK):
    """Uniform on (0, 1), a pure function of the tag and the row id."""
    return uniform_of(ops.concat_key(tag, id_col), ops)


def keyed_normal(tag: str, id_col: str, ops=SPARK):
    """Standard normal by Box-Muller from two keyed uniforms."""
    return normal_of(keyed_uniform(f"{tag}:a:", id_col, ops), keyed_uniform(f"{tag}:b:", id_col, ops), ops)


def normal_of(u1, u2, ops=SPARK):
    """Standard normal of two uniforms by Box-Muller."""
    return ops.mul(ops.sqrt(ops.mul(ops.lit(-2.0), ops.ln(u1))), ops.cos(ops.mul(ops.lit(TWO_PI), u2)))


def poisson_thresholds(mean: float, tail: float = 1e-12) -> list[float]:
    """Cumulative probabilities of a Poisson distribution at 0, 1, 2, ... up to 1 - tail."""
    out, term, acc, k = [], math.exp(-mean), 0.0, 0
    while True:
        acc += term
        out.append(acc)
        k += 1
        term *= mean / k
        if 1.0 - acc < tail:
            return out


def poisson_from_uniform(u, mean: float, ops=SPARK):
    """Inverse-CDF Poisson draw: the number of cumulative thresholds below ``u``."""
    return ops.sum(ops.gt(u, ops.lit(c)) for c in poisson_thresholds(mean))


def poisson1_thresholds(tail: float = 1e-12) -> list[float]:
    """Cumulative probabilities of Poisson(1) at 0, 1, 2, ... up to 1 - tail."""
    out, term, acc, k = [], math.exp(-1.0), 0.0, 0
    while True:
        acc += term
        out.append(acc)
        k += 1
        term /= k
        if 1.0 - acc < tail:
            return out


def poisson1_from_uniform(u, ops=SPARK):
    """Inverse-CDF Poisson(1) draw: the number of cumulative thresholds below ``u``."""
    return ops.sum(ops.gt(u, ops.lit(c)) for c in poisson1_thresholds())
