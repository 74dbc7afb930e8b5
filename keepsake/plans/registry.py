"""Registered queries: a Spark job and, where SQL can say the same, its SQL text."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepsake.plans.inputs import Tables, sql

Job = Callable[[Tables], DataFrame]
_JOBS: dict[str, Job] = {}
_SQL: dict[str, str] = {}
_MODULES = (
    "q_activity", "q_corpus", "q_voice", "q_sessions", "q_contacts",
    "q_retrieval", "q_questions", "q_evidence", "q_knowledge", "q_insights", "q_maintained",
    "q_sources", "q_archives", "q_training", "q_responses", "q_streams",
)


def query(name: str, text: str | None = None) -> Callable[[Job], Job]:
    def keep(job: Job) -> Job:
        if name in _JOBS:
            raise ValueError(f"query {name} is registered twice")
        _JOBS[name] = job
        if text is not None:
            _SQL[name] = sql(text)
        return job
    return keep


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"keepsake.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(job: Job) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: job(Tables(spark, folder))

    return {name: bind(job) for name, job in _JOBS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
