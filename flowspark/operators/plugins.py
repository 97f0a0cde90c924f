"""Feature plug-ins: named DataFrame -> DataFrame functions applied in order of registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_PLUGINS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_feature(name: str):
    """Decorator that adds a feature function."""
    def add(fn: Callable[[DataFrame], DataFrame]):
        _PLUGINS[name] = fn
        return fn
    return add


def loaded_features() -> list[str]:
    return list(_PLUGINS)


def apply_features(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    for name in names if names is not None else _PLUGINS:
        df = df.transform(_PLUGINS[name])
    return df
