"""Queries of this subpackage: name -> (Spark builder, DuckDB SQL or None)."""

from __future__ import annotations

from vigil.llm.common import ready

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            ready(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco
