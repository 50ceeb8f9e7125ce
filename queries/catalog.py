"""Importing this module registers every query."""

from queries import features, flows, models, relations, series, tables  # noqa: F401
