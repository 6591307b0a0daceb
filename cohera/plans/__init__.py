"""The registered queries, each with its DuckDB twin where SQL can say it."""

from . import annotation, batteries, catalogue, evidence, fits, modelling, selection, statistics, transfer
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "annotation", "batteries", "catalogue", "evidence", "fits", "modelling", "selection", "statistics", "transfer"]
