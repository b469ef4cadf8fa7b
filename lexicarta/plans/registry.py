"""Registered queries of the library and the DuckDB SQL they are held against."""

from lexicarta.plans import detection_queries, entry_queries, lexicon_queries, stream_queries, text_queries

MODULES = (text_queries, entry_queries, detection_queries, lexicon_queries, stream_queries)
QUERIES: dict = {name: made for m in MODULES for name, made in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
