"""Source registry (I11): name -> ingest function; tables of all sources unite."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from . import claude, codex, documents, events
from .ingest import Ingested, union_all
from .writers import write_table

# The ten sources in their order.
INGEST: dict[str, Callable[..., Ingested]] = {
    "claude": claude.ingest_claude,
    "codex": codex.ingest_codex,
    "gemini": documents.ingest_gemini,
    "copilot": events.ingest_copilot,
    "cursor-agent": events.ingest_cursor,
    "commandcode": claude.ingest_commandcode,
    "goose": events.ingest_goose,
    "opencode": documents.ingest_opencode,
    "kiro": documents.ingest_kiro,
    "zed": documents.ingest_zed,
}


def register(name: str, ingest: Callable[..., Ingested]) -> None:
    INGEST[name] = ingest


def ingest_all(inputs: dict[str, dict]) -> Ingested:
    """Ingest each named source with its arguments and unite the tables."""
    return union_all([INGEST[name](**arguments) for name, arguments in inputs.items()])


def reason(error: Exception) -> str:
    """The innermost cause in one line."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    causes = [x.removeprefix("Caused by: ") for x in lines if x.startswith("Caused by: ")]
    return f"{type(error).__name__}: {(causes or lines or [''])[-1 if causes else 0]}"


def store_all(spark: SparkSession, inputs: dict[str, dict], path: str) -> tuple[Ingested, DataFrame]:
    """Ingest and store each source by itself below ``path``; the united tables of those that succeed, and (source, reason) of the others.

    A source's tables are read only when all of them are written, so one that fails midway leaves no rows.
    """
    stored, failed = [], []
    for name, arguments in inputs.items():
        try:
            got = INGEST[name](**arguments)
            kept = {}
            for f in fields(Ingested):
                table = getattr(got, f.name)
                if table is not None:
                    write_table(table, f"{path}/{name}/{f.name}")
                    kept[f.name] = spark.read.schema(table.schema).parquet(f"{path}/{name}/{f.name}")
            stored.append(Ingested(**kept))
        except Exception as error:  # noqa: BLE001  whatever a source fails with, the others go on
            failed.append((name, reason(error)))
    return union_all(stored), spark.createDataFrame(failed, "source string, reason string")
