"""Every registered query and its SQL twin."""

from __future__ import annotations

from inkplane.plans import box_queries, charset_queries, file_queries, glyph_queries, layout_queries, live_queries, raster_queries, synthesis_queries

_MODULES = (box_queries, charset_queries, layout_queries, raster_queries, glyph_queries, synthesis_queries, live_queries, file_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
