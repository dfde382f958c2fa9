"""Small dense linear algebra unrolled into per-row column expressions.

A d x d system per row (one row per instrument, or the single moments row) is
solved with a fixed sequence of projections, so thousands or millions of
instruments are solved in parallel inside ordinary Spark stages, with no Python
and no collect.  Each function returns *stages*: lists of ``(name, expr)`` pairs;
a stage only refers to input columns and to names defined in earlier stages.
"""

from __future__ import annotations

from montevar.functions.exprs import SPARK


def spd_solve_stages(a_name, b_name, d: int, out_names: list[str], tag: str = "s", ops=SPARK):
    """Solve ``A w = b`` for symmetric positive definite ``A`` by Gaussian elimination.

    ``a_name(i, j)`` / ``b_name(i)`` give the input column names.  No pivoting is
    needed for SPD matrices; a non-positive pivot yields NULL via the division.
    """
    col = ops.col
    a = {(i, j): col(a_name(i, j)) for i in range(d) for j in range(d)}
    b = {i: col(b_name(i)) for i in range(d)}
    stages = []
    for p in range(d - 1):
        stage = []
        new_a, new_b = {}, {}
        for i in range(p + 1, d):
            f = ops.div(a[(i, p)], a[(p, p)])
            for j in range(p + 1, d):
                name = f"_{tag}a{p}_{i}_{j}"
                stage.append((name, ops.sub(a[(i, j)], ops.mul(f, a[(p, j)]))))
                new_a[(i, j)] = col(name)
            name = f"_{tag}b{p}_{i}"
            stage.append((name, ops.sub(b[i], ops.mul(f, b[p]))))
            new_b[i] = col(name)
        stages.append(stage)
        a.update(new_a)
        b.update(new_b)
    w = {}
    for i in reversed(range(d)):
        acc = b[i]
        for j in range(i + 1, d):
            acc = ops.sub(acc, ops.mul(a[(i, j)], w[j]))
        stages.append([(out_names[i], ops.div(acc, a[(i, i)]))])
        w[i] = col(out_names[i])
    return stages


def cholesky_stages(cov_name, d: int, l_name, ops=SPARK):
    """Lower Cholesky factor ``L`` of a covariance matrix, ``L L^T = S``.

    A non-positive pivot (a factor that is a linear combination of earlier ones)
    is clamped to zero and its column set to zero, so the draw stays defined.
    """
    col = ops.col
    stages = []
    zero = ops.lit(0.0)
    for j in range(d):
        s = col(cov_name(j, j))
        for k in range(j):
            s = ops.sub(s, ops.mul(col(l_name(j, k)), col(l_name(j, k))))
        diag = ops.if_pos(s, ops.sqrt(ops.greatest(s, zero)), zero)
        stages.append([(l_name(j, j), diag)])
        below = []
        for i in range(j + 1, d):
            s = col(cov_name(i, j))
            for k in range(j):
                s = ops.sub(s, ops.mul(col(l_name(i, k)), col(l_name(j, k))))
            below.append((l_name(i, j), ops.if_pos(col(l_name(j, j)), ops.div(s, col(l_name(j, j))), zero)))
        if below:
            stages.append(below)
    return stages
