"""Queries over the given tables, one or more per operator."""

from lookout.catalog import histories, learning, records, signals, streams, tables  # noqa: F401
from lookout.catalog.registry import QUERIES, SQL  # noqa: F401
