"""Inputs and outputs: reference-shaped tables and where they come from."""

from ledgerlens.sources.catalog import read_catalog, save_bucketed
from ledgerlens.sources.sinks import checkpoint_root, materialize
from ledgerlens.sources.standin import standin_tables
from ledgerlens.sources.tables import Tables, read_reference

__all__ = [
    "Tables",
    "checkpoint_root",
    "materialize",
    "read_catalog",
    "read_reference",
    "save_bucketed",
    "standin_tables",
]
