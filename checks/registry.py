"""Registry of checked queries and the composition of their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.sql_views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` may use any view of `sql_views` as if it were a table."""
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def with_views(sql: str) -> str:
    """Prepend the views the text names, each after those it needs itself."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\bv_\w+\b", text)):
            if word not in seen:
                seen.add(word)
                visit(VIEWS[word])
                order.append(word)

    visit(sql)
    if not order:
        return sql

    def cte(v: str) -> str:
        recursive = re.search(rf"\b{v}\b", VIEWS[v])
        return f"{v} AS {'' if recursive else 'MATERIALIZED '}({VIEWS[v]})"

    ctes = ",\n".join(cte(v) for v in order)
    return f"WITH RECURSIVE {ctes}\n{sql}"


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounding that both engines do alike: a sum's last bits cannot flip it at a decimal tie."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5001) / scale


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in columns})
