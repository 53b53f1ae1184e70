"""Operators over DataFrames: search, retrieval, turns, condensing, curation, graph."""
