"""Hooks for models: text and image embedders, rerankers. The models themselves are the caller's.

A provider is made once a task, by a function that is sent to it, and is called with batches; Spark deals
the rows. What it returns is checked: as many rows as it was given, vectors of the length that its name in
the registry of vector spaces says (S4), finite numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (texts or images, role) to one vector each.
Embedder = Callable[[Sequence, str], Sequence]
#: (query, text) pairs to one score each.
Scorer = Callable[[Sequence[tuple[str, str]]], Sequence[float]]

ROLES = ("document", "query")


@dataclass(frozen=True)
class Provider:
    """``make`` runs once a task and gives an Embedder (or a Scorer, with dims 0); ``batch`` rows go into a call."""

    provider: str
    model: str
    dims: int
    make: Callable[[], Callable]
    batch: int = 16

    def namespace(self, view: str) -> str:
        if ":" in view + self.provider + self.model or self.dims <= 0:
            raise ValueError("a part holds a colon, or dims are not positive")
        return f"{view}:{self.provider}:{self.model}:{self.dims}"


def check_namespaces(stored: DataFrame, provider: Provider, view: str) -> None:
    """Raises if vectors of the view are stored that this provider can't be compared with. ``stored``: namespace."""
    own = provider.namespace(view)
    other = stored.filter(F.col("namespace").startswith(f"{view}:") & (F.col("namespace") != own)).select("namespace").limit(1).collect()
    if other:
        raise ValueError(f"{other[0][0]} is stored, and the provider gives {own}")


def _checked(vectors: Sequence, n: int, dims: int, name: str) -> np.ndarray:
    got = np.asarray(vectors, dtype=np.float64)
    if got.shape != (n, dims):
        raise ValueError(f"{name} gave {got.shape} for {n} rows of {dims} dimensions")
    if not np.isfinite(got).all():
        raise ValueError(f"{name} gave numbers that are not finite")
    return got


def embed(rows: DataFrame, provider: Provider, view: str, *, id_col: str = "id", value: str = "text", role: str = "document") -> DataFrame:
    """id, namespace, v of each row's ``value`` (text or bytes); a null one has no vector and is left out."""
    if role not in ROLES:
        raise ValueError(f"no role {role}")
    name, kind = provider.namespace(view), rows.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for frame in frames:
            call = call or provider.make()  # where there are rows
            for at in range(0, len(frame), provider.batch):
                part = frame.iloc[at : at + provider.batch]
                got = _checked(call(part["value"].tolist(), role), len(part), provider.dims, name)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "namespace": name, "v": list(got)})

    asked = rows.select(F.col(id_col).alias("id"), F.col(value).alias("value")).filter("value is not null")
    return asked.mapInPandas(run, f"id {kind}, namespace string, v array<double>")


def rerank(hits: DataFrame, scorer: Provider) -> DataFrame:
    """query_id, id, score, rank: hits (query_id, id, query, text) in the scorer's order, ties to the smaller id; null texts count as empty."""
    q, i = (hits.schema[c].dataType.simpleString() for c in ("query_id", "id"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for frame in frames:
            call = call or scorer.make()
            for at in range(0, len(frame), scorer.batch):
                part = frame.iloc[at : at + scorer.batch]
                got = _checked([[s] for s in call(list(zip(part["query"], part["text"], strict=True)))], len(part), 1, f"{scorer.provider}:{scorer.model}")
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy(), "id": part["id"].to_numpy(), "score": got[:, 0]})

    asked = hits.select("query_id", "id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("text", F.lit("")).alias("text"))
    scored = asked.mapInPandas(run, f"query_id {q}, id {i}, score double")
    from sessionloom.operators.vectors import top

    return top(scored, 2**31 - 1, F.desc("score"), F.asc("id"))


def visual_match(queries: DataFrame, candidates: DataFrame, provider: Provider, *, least: float = 0.92, margin: float = 0.03) -> DataFrame:
    """M10 over a provider's vectors: query_id, match, verdict. Both sides have id and image (bytes)."""
    from sessionloom.operators import traces, vectors

    a = embed(queries, provider, "visual", value="image", role="query").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    b = embed(candidates, provider, "visual", value="image").select("id", "v").checkpoint()
    pairs = vectors.against_all(a, b)
    return traces.near_match(pairs.select("query_id", "id", F.round(vectors.cosine("qv", "v"), 6).alias("score")), least=least, margin=margin)
