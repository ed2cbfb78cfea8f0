"""Every operator as a query over the benchmark tables, with SQL that must agree where SQL can say it."""

from sheafwork.catalog import composing, describing, editing, extraction, ingesting, reading, recognition, searching  # noqa: F401
from sheafwork.catalog.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
