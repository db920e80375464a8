"""All core queries and their SQL."""

from __future__ import annotations

from strataloom.queries import evaluation, layout, runs, scalars, topics  # noqa: F401
from strataloom.queries.registry import QUERIES, SQL, Query


FLAGSHIP = topics.flagship_topics


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
