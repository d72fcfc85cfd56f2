"""Runnable queries, one per operator, each beside the SQL that states the same result."""

from tallyloom.catalog import log, profiling, splitting, evaluation, learning  # noqa: F401
from tallyloom.catalog.base import ORACLES, QUERIES  # noqa: F401
