"""Collects the query catalogues of the library; the llm catalogue is added only where it can be imported."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def optional_catalogue(module: str) -> tuple[dict[str, Query], dict[str, str]]:
    """``QUERIES`` and ``ORACLE`` of a module, or two empty dicts where the module is absent."""
    try:
        found = import_module(module)
    except ModuleNotFoundError as error:
        if error.name and module.startswith(error.name):
            return {}, {}
        raise
    return dict(found.QUERIES), dict(found.ORACLE)
