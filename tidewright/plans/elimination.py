"""SQL that solves linear systems by elimination, for the twins of fitted models."""

from __future__ import annotations


def solve_sql(system: str, keys: str, size: int) -> str:
    """Tables ``steps`` and ``solved`` (``keys, i, w``) of a WITH RECURSIVE list.

    ``system`` has ``keys, i, j, v`` for every i below ``size`` and j up to ``size``; column ``size`` is the right side.
    Matrices must be positive definite: pivots are taken in order.
    """
    return f"""steps AS (SELECT {keys}, 0 AS step, i, j, v FROM {system} UNION ALL
  SELECT {keys}, step + 1, i, j, CASE WHEN i = step THEN in_row / head ELSE v - in_column * in_row / head END FROM (
    SELECT *, max(v) FILTER (WHERE i = step) OVER (PARTITION BY {keys}, j) AS in_row, max(v) FILTER (WHERE j = step) OVER (PARTITION BY {keys}, i) AS in_column,
           max(v) FILTER (WHERE i = step AND j = step) OVER (PARTITION BY {keys}) AS head FROM steps WHERE step < {size}) WHERE j > step),
solved AS (SELECT {keys}, i, v AS w FROM steps WHERE step = {size} AND j = {size})"""
