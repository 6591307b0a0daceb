"""The table of queries and the decorator that fills it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def normal_p(table: str, z: str) -> str:
    """SQL of a table p: all columns of the table and p, the two-sided normal tail of z."""
    t = f"(1 / (1 + abs({z}) / sqrt(8)))"
    fit = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    poly = str(fit[0])
    for c in fit[1:]:
        poly = f"({poly} * t + {c})"
    return f"p AS (SELECT * EXCLUDE (t), CASE WHEN {z} IS NOT NULL THEN least(1.0, t * exp(-{z} * {z} / 2 + {poly})) END AS p FROM (SELECT *, {t} AS t FROM {table}))"
