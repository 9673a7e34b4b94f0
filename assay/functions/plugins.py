"""Row plugins pinned to a version and to the SHA-256 of their code.

A plugin is a module with PLUGIN_ID, PLUGIN_VERSION and `evaluate(**columns) -> dict`. Its source is
read once on the driver, held against the pin before anything is planned, and sent with the query;
a worker holds what it got against the pin again before it runs any of it, so an executor that
comes later runs the same code.
"""

from __future__ import annotations

import hashlib
import types
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOADED: dict[str, types.ModuleType] = {}


class PluginError(ValueError):
    """A plugin that is not the one that was pinned."""


@dataclass(frozen=True)
class Plugin:
    """What was pinned, and the source that fits it. `schema`: DDL of what `evaluate` returns."""

    plugin_id: str
    version: str
    sha256: str
    schema: str
    source: bytes


def _module(plugin_id: str, version: str, sha256: str, source: bytes) -> types.ModuleType:
    """The plugin's module, checked before it is run; one for each worker and digest."""
    if (found := hashlib.sha256(source).hexdigest()) != sha256:
        raise PluginError(f"plugin {plugin_id}: the code's SHA-256 is {found}, pinned was {sha256}")
    if sha256 not in _LOADED:
        module = types.ModuleType(f"plugin_{sha256[:16]}")
        exec(compile(source, f"<plugin {plugin_id}>", "exec"), module.__dict__)  # noqa: S102  (pinned code)
        _LOADED[sha256] = module
    module = _LOADED[sha256]
    said = (getattr(module, "PLUGIN_ID", None), getattr(module, "PLUGIN_VERSION", None))
    if said != (plugin_id, version) or not callable(getattr(module, "evaluate", None)):
        raise PluginError(f"plugin {plugin_id} {version}: the code says {said}, or has no evaluate")
    return module


def load(spark: SparkSession, path: str, plugin_id: str, version: str, sha256: str, schema: str) -> Plugin:
    """Read a plugin's file and check it: another digest, id or version, or no `evaluate`, raises
    PluginError; so does a path that is not one file. A path without a scheme is the driver's own, any
    other is read by Spark."""
    if "://" in path:
        files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).select("content").limit(2).collect()]
    else:
        files = [Path(path).read_bytes()] if Path(path).is_file() else []
    if len(files) != 1:
        raise PluginError(f"plugin {plugin_id}: {path} is not one file")
    (source,) = files
    _module(plugin_id, version, sha256, source)
    return Plugin(plugin_id, version, sha256, schema, source)


def evaluate(plugin: Plugin, **columns: Column) -> Column:
    """struct<status, error, value>: value is what the plugin returns for a row's columns. An exception, or
    a result that is no dict, makes the row FAILED, with the exception's name and text; other rows go on.
    Rows go to Python as Arrow batches; a null, and a NaN, is None."""
    names = list(columns)
    value = StructType.fromDDL(plugin.schema)
    result = StructType.fromDDL("status string, error string").add("value", value)
    pin = (plugin.plugin_id, plugin.version, plugin.sha256, plugin.source)

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        call = _module(*pin).evaluate
        none = dict.fromkeys(value.names)
        for batch in batches:
            rows: list[tuple[str, str | None, dict[str, Any]]] = []
            for cells in zip(*batch):
                try:
                    got = call(**{n: None if c is None or c is pd.NaT or isinstance(c, float) and c != c else c for n, c in zip(names, cells)})
                    if not isinstance(got, dict):
                        raise TypeError(f"evaluate returned {type(got).__name__}")
                    rows.append(("COMPLETED", None, {n: got.get(n) for n in value.names}))
                except Exception as e:  # noqa: BLE001  (a row's failure is its result)
                    rows.append(("FAILED", f"{type(e).__name__}: {e}", none))
            yield pd.DataFrame({"status": [r[0] for r in rows], "error": [r[1] for r in rows], "value": [r[2] for r in rows]}, columns=["status", "error", "value"])

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run((b,) for b in batches)

    return F.pandas_udf(one if len(names) == 1 else run, result)(*columns.values())


def failures(df: DataFrame, result: str, keys: list[str]) -> DataFrame:
    """Failed rows by kind of exception, for each of `keys`."""
    kind = F.substring_index(F.col(f"{result}.error"), ":", 1)
    return df.where(F.col(f"{result}.status") == "FAILED").groupBy(*keys, kind.alias("error")).agg(F.count(F.lit(1)).alias("n"))
