"""montevar: portfolio market-risk analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame.  All work is
expressed with built-in Spark SQL expressions, windows, aggregates and joins so
that Catalyst can prune, push down and code-generate the whole plan.
"""

from montevar.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
