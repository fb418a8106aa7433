"""The registered queries over the supplied tables and their SQL."""

from __future__ import annotations

from wattline.plans import catalog_queries, learning_queries, pattern_queries, phase_queries, profile_queries, series_queries

QUERIES: dict = {**series_queries.QUERIES, **pattern_queries.QUERIES, **profile_queries.QUERIES, **phase_queries.QUERIES, **catalog_queries.QUERIES, **learning_queries.QUERIES}
ORACLES: dict[str, str] = {**series_queries.ORACLES, **pattern_queries.ORACLES, **profile_queries.ORACLES, **phase_queries.ORACLES, **catalog_queries.ORACLES, **learning_queries.ORACLES}
