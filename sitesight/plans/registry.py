"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from sitesight.plans import (
    draw_oracles,
    draw_queries,
    model_queries,
    oracles,
    site_queries,
    storage_queries,
)

QUERIES = {
    **site_queries.QUERIES,
    **draw_queries.QUERIES,
    **model_queries.QUERIES,
    **storage_queries.QUERIES,
}
ORACLES = {
    **oracles.SITE_SQL,
    **draw_oracles.DRAW_SQL,
    **model_queries.ORACLES,
    **storage_queries.ORACLES,
}
