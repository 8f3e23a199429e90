"""Readers and writers."""

from skein.sources.tables import read_table

__all__ = ["read_table"]
