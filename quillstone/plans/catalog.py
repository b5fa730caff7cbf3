"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import audit, coverage, evaluation, lexical, research, retrieval, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval.Q, **research.Q, **audit.Q, **evaluation.Q, **lexical.Q, **vectors.Q, **coverage.Q}
ORACLES: dict[str, str] = {**retrieval.O, **research.O, **audit.O, **evaluation.O, **lexical.O, **vectors.O, **coverage.O}
