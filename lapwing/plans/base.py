"""Registration of queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import bindings as B

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _ties_up(sql: str) -> str:
    """Sums that differ in their last bit must not fall on two sides of a tie: both engines round values that
    are nudged away from zero, round(x, n) as round(x + sign(x) * 1e-9, n)."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end, comma = 1, start + 6, 0
        while depth:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            end += 1
        inner = _ties_up(sql[start + 6 : comma])
        out += f"{sql[at:start]}round(({inner}) + sign({inner}) * 1e-9{sql[comma:end]}"
        at = end
    return out + sql[at:]


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir); ``sql`` is the same for DuckDB."""

    def add(work: Callable) -> Callable:
        QUERIES[name] = work
        if sql:
            ORACLES[name] = _ties_up(sql)
        return work

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All doubles rounded, minus zero made zero, integers widened to long: what an oracle can match."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = c.cast("double")
            c = F.round(c + F.signum(c) * 1e-9, digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def events_of(work: Callable) -> Callable:
    """For queries that only need the events binding: the function gets that frame."""

    def run(spark, sf_dir):
        return work(B.events(spark, sf_dir))

    run.__name__, run.__doc__ = work.__name__, work.__doc__
    return run
