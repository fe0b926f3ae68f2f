"""Importing this package registers every query in `catalogue.QUERIES` and `catalogue.SQL`."""

from tidemark.plans import (  # noqa: F401
    analytics, catalogue, documents, gates, lifecycle, models, pages, reader, relational, searching, sources, streams, textual, topics, trends, upkeep, vocabulary, writes,
)
