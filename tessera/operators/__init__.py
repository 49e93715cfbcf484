"""Operators over triples: graph construction, statistics, centrality, paths, clustering, placement, pattern joins."""
