"""Queries by theme; importing this package registers them."""

from folioforge.catalog import directories, entities, graphs, matches, merges, names, people, plans, proofs, registries, requests, reviews, search, segments, selection, surfaces, text, work  # noqa: F401
