"""Every registered query of the library and its SQL."""

from __future__ import annotations

from . import base, q_complexity, q_more, q_prepare, q_scalars, q_statistics, q_tables, q_text  # noqa: F401  registration

QUERIES, ORACLES = base.QUERIES, base.ORACLES
FLAGSHIP = "proximity_edges"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
