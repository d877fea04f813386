"""Writing result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from skimlark.functions.exprs import json_safe

FORMATS = ("json", "parquet", "orc")


def write_results(tables: Mapping[str, DataFrame], path: str, *, format: str = "json",
                  mode: str = "errorifexists") -> dict[str, str]:
    """Every table to its own folder below ``path``; returns the folders.

    Values are made JSON-safe first: no NaN or infinity, moments as ISO text.
    """
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {format!r}")
    folders = {}
    for name, table in tables.items():
        folders[name] = f"{path.rstrip('/')}/{name}"
        json_safe(table).write.mode(mode).format(format).save(folders[name])
    return folders
