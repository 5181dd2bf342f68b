"""Registered queries of the relational and media operators, with their SQL."""

from __future__ import annotations

from . import chain_queries, io_queries, media_queries, text_queries

MODULES = (text_queries, media_queries, io_queries, chain_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
