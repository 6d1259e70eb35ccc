"""Scans and sinks."""

from churnkit.sources.tables import accounts_raw, read_table  # noqa: F401
