"""What the ingest jobs share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schemas


@dataclass
class Ingested:
    """Normalised tables of one source. ``durations`` and ``files`` are given where messages don't tell them."""

    messages: DataFrame
    sessions: DataFrame
    usage: DataFrame | None = None
    durations: DataFrame | None = None
    files: DataFrame | None = None


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a normalised table, in order and type; absent ones are null."""
    out = []
    for part in _columns(schema):
        name, kind = part
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def _columns(schema: str) -> list[tuple[str, str]]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = schema[at:i].strip().split(" ", 1)
            parts.append((name, kind))
            at = i + 1
    return parts


def session_table(df: DataFrame) -> DataFrame:
    return shaped(df, schemas.SESSIONS)


def usage_table(df: DataFrame) -> DataFrame:
    return shaped(df, schemas.USAGE)


def index_table(df: DataFrame) -> DataFrame:
    return shaped(df, schemas.INDEX)


def union_all(parts: list[Ingested]) -> Ingested:
    """The tables of all sources together."""
    def both(name: str) -> DataFrame | None:
        frames = [getattr(p, name) for p in parts if getattr(p, name) is not None]
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f)
        return out
    return Ingested(both("messages"), both("sessions"), both("usage"), both("durations"), both("files"))


