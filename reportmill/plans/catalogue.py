"""The registered queries of the library."""

from __future__ import annotations

from reportmill.plans import activity, ingest, querylog, querypairs, reportpairs, reports, rules, streams, vectors  # noqa: F401  they register their queries
from reportmill.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "rank_pairs"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
