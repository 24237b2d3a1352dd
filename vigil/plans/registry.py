"""Registry of named queries: a Spark builder plus its DuckDB oracle text.

Every entry reads the driver's tables (or views Spark derives from them) in
full; computed doubles are rounded to 6 decimals on both sides so that
last-bit differences between engines do not decide the comparison.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6
SCALE = float(10**DIGITS)
# the same IEEE double arithmetic on both sides: sign(x) * floor(|x| * 1e6 + 0.5) / 1e6
ROUND_SQL = "(sign({c}) * floor(abs({c}) * 1000000.0 + 0.5) / 1000000.0)"


def round_half_away(c):
    """Round to DIGITS decimals in plain double arithmetic (no BigDecimal per value)."""
    return F.signum(c) * F.floor(F.abs(c) * F.lit(SCALE) + F.lit(0.5)) / F.lit(SCALE)


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    rounded: tuple[str, ...] = field(default_factory=tuple)
    doc: str = ""

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        if not self.rounded:
            return df
        r = set(self.rounded)
        return df.select(*[round_half_away(F.col(c)).alias(c) if c in r else F.col(c) for c in df.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        sql = bigint_counts(self.sql)
        if not self.rounded:
            return sql
        rep = ", ".join(f'{ROUND_SQL.format(c=chr(34) + c + chr(34))} AS "{c}"' for c in self.rounded)
        return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


def bigint_counts(sql: str) -> str:
    """DuckDB types count_if as HUGEINT; Spark's count_if is BIGINT: cast each call."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k] + " AS BIGINT)")
        i = k


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, rounded=(), doc: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, tuple(rounded), doc or (fn.__doc__ or "").strip())
        return fn

    return deco
