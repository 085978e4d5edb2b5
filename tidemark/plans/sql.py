"""Text pieces shared by the checking SQL."""

from __future__ import annotations

BARS = """
bars AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date,
    arg_min(l_extendedprice / l_quantity,
            row(l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS open,
    max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity,
            row(l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS close,
    CAST(sum(l_quantity) AS BIGINT) AS volume,
    sum(l_extendedprice) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2)
"""

WS = "PARTITION BY symbol ORDER BY date"


def snap(x: str, places: int = 6) -> str:
    scale = "1" + "0" * places
    return f"(floor(({x}) * {scale}.0::DOUBLE + 0.4871::DOUBLE) / {scale}.0::DOUBLE)"


def roll(fn: str, x: str, n: int, ws: str = WS) -> str:
    """Rolling aggregate that is null until n values are in."""
    frame = f"({ws} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {frame} >= {n} THEN {fn}({x}) OVER {frame} END)"


def lag(x: str, n: int = 1, ws: str = WS) -> str:
    return f"lag({x}, {n}) OVER ({ws})"


def div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def avg_rank(x: str, part: str) -> str:
    """Average-tie rank of x among the non-null rows of the partition."""
    return (
        f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {x} ASC NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0 END)"
    )


def ewm(x: str, span: int, ws: str = WS) -> str:
    """Adjusted exponential mean by its definition: a weighted fold of all rows so far."""
    keep = 1.0 - 2.0 / (span + 1.0)
    rows = f"list({x}) OVER ({ws} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    weighted = f"list_transform({rows}, lambda v, i: v * pow({keep!r}::DOUBLE, len({rows}) - i))"
    weights = f"list_transform({rows}, lambda v, i: pow({keep!r}::DOUBLE, len({rows}) - i))"
    return f"(list_sum({weighted}) / list_sum({weights}))"
