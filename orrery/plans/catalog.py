"""All registered queries of the engine, without those of the training-data subpackage."""

from __future__ import annotations

from orrery.plans import learning, products, series, streams, validation  # noqa: F401  (register their queries)
from orrery.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
