"""Registering queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: Character-class bodies as in strataloom.functions.text, for SQL.
SP = r"\s\x0B\x1c-\x1f\x85\p{Z}"
WD = r"\p{L}\p{N}_"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def esc_sql(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def xesc_sql(x: str) -> str:
    return f"replace({esc_sql(x)}, '\"', '&quot;')"


def slug_sql(x: str) -> str:
    s = f"regexp_replace({strip_sql(f'lower({x})')}, '[^a-z0-9{SP}_-]', '', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '[{SP}-]+', '_', 'g'), '_+', '_', 'g')"
    return f"substring(regexp_replace({s}, '^_+|_+$', '', 'g'), 1, 60)"


def name_sql(title: str, kind: str) -> str:
    return f"case {kind} when 'task' then 't' when 'reference' then 'r' else 'c' end || '_' || {slug_sql(title)} || '.dita'"


BLOCKS = "b as (select distinct doc_id, pos, type, text, page, level from block)"
