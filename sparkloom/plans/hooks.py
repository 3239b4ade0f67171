"""Named hooks: functions of DataFrames or Columns, found by name or dotted path."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame

HOOKS: dict[str, Callable] = {}


def hook(name: str):
    def keep(f: Callable) -> Callable:
        HOOKS[name] = f
        return f

    return keep


def load(path: str | Callable | None) -> Callable | None:
    """A function by registered name or ``package.module.function``; None stays None."""
    if path is None or callable(path):
        return path
    if path in HOOKS:
        return HOOKS[path]
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


def apply_filter(df: DataFrame, path: str | Callable | None) -> DataFrame:
    """df with columns keep and reason. A filter gives one boolean column, or a pair of (keep, reason); none keeps all."""
    from pyspark.sql import functions as F

    f = load(path)
    result = f(df) if f else F.lit(True)
    keep, reason = result if isinstance(result, tuple) else (result, F.lit(None).cast("string"))
    return df.withColumn("keep", F.coalesce(keep, F.lit(False))).withColumn("reason", F.when(~F.col("keep"), reason))


def chain(df: DataFrame, *paths: str | Callable | None) -> DataFrame:
    """df sent through transforms in turn."""
    for f in map(load, paths):
        df = f(df) if f else df
    return df
