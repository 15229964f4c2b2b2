"""Every registered query.  Importing the modules fills the tables."""

from __future__ import annotations

import importlib

from .registry.core import COVERS, ORACLES, QUERIES

for _module in (
    "source_queries",
    "cleaning_queries",
    "filter_queries",
    "join_queries",
    "metric_queries",
    "voyage_queries",
    "report_queries",
    "report_table_queries",
    "change_queries",
    "model_queries",
    "stream_queries",
):
    importlib.import_module(f"freightlens.registry.{_module}")

__all__ = ["COVERS", "ORACLES", "QUERIES"]
