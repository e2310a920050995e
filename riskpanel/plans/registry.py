"""Helpers to state a query next to the ANSI SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Added before rounding so that exact decimal ties fall the same way in both engines.
NUDGE = 1.7e-9
Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None = None
    covers: str = ""


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: doubles rounded (no negative zero), integers as BIGINT."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c), F.round(c.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0))
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def rounded(sql: str, doubles: str = "", longs: str = "", digits: int = 6) -> str:
    """The same normalisation on the SQL side; column lists are blank-separated."""
    parts = [f'round("{c}"::DOUBLE + {NUDGE}, {digits}) + 0.0 AS "{c}"' for c in doubles.split()]
    parts += [f'"{c}"::BIGINT AS "{c}"' for c in longs.split()]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})" if parts else sql


def query(build: Builder, sql: str | None = None, covers: str = "", digits: int = 6) -> Query:
    return Query(lambda spark, sf: tidy(build(spark, sf), digits), sql, covers)


def merged(groups: Iterable[dict[str, Query]]) -> dict[str, Query]:
    out: dict[str, Query] = {}
    for g in groups:
        for name, q in g.items():
            if name in out:
                raise ValueError(f"query name used twice: {name}")
            out[name] = q
    return out
