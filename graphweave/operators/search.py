"""Vector search over nodes, notes and other rows with embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from .graph import PropertyGraph, beam


def vector_search(rows: DataFrame, query: list[float], limit: int, keep=None, multiplier: int = 10, least: float = 0.3, id_col: str = "id", vector_col: str = "embedding", scale: str = "unit") -> DataFrame:
    """``rows`` with ``score``: the ``limit * multiplier`` nearest of all, of these the ones that ``keep`` (a condition) and ``least`` let through.

    The filter comes after the nearest are taken, as with an index over all
    projects, so fewer than ``limit`` rows may come back.  Ties go to smaller ids.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(F.col(vector_col).isNotNull()).withColumn("score", vectors.similarity(F.col(vector_col), q, scale))
    near = scored.where("score is not null").orderBy(F.col("score").desc(), id_col).limit(limit * multiplier)
    kept = near.where((keep if keep is not None else F.lit(True)) & (F.col("score") >= least))
    return kept.orderBy(F.col("score").desc(), id_col).limit(limit)


def search_code(g: PropertyGraph, query: list[float], limit: int = 3, least: float = 0.65, depth: int = 3, per_chain: int = 5, project: str | None = None, scale: str = "unit"):
    """(hits, around): the best matches, and the weighted traversal around the first one; depth is held at 10, limit at 10."""
    keep = F.col("projectId") == project if project else None
    hits = vector_search(g.nodes, query, min(limit, 10), keep, least=least, scale=scale)
    first = hits.select("id").first()
    around = beam(g, first.id, min(depth, 10), "BOTH", per_chain, query, scale=scale) if first else None
    return hits, around
