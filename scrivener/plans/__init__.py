"""Registered queries, by family."""

from scrivener.plans import adapters, cards, catalog, evidence, functions, graphs, jobs, knowledge, library, readers, search, stores, streams, texts, topics, trees  # noqa: F401
