"""All queries of the library's own operators, by name."""

from __future__ import annotations

from lodestrata.plans import archives, census, codecs, fields, layout, media, naming  # noqa: F401  they register their queries
from lodestrata.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
