"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits. One binary classifier a bit, on hashed counts of
character n-grams (n = 1 to 3) of the whole text, says which side of the code a text is on; a
text's language is the one whose codeword loses least, weighted by how far each bit can be trusted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.common import free_name, give_back, small_batches

BUCKET_BITS = 13
#: Steepness of the bits' votes, and the least lead of the best language over the next.
SLOPE, LEAD = 4.0, 0.2
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts, or None for a text without letters. Case and non-letters don't count."""
    if not text:
        return None
    a = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[a]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of what separates words, one
    a = np.concatenate([[np.uint32(32)], np.where(letter, a, np.uint32(32))[keep], [np.uint32(32)]]).astype(np.uint32)
    one = a * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(0x85EBCA77) + one[1:]
    three = two[:-1] * np.uint32(0xC2B2AE3D) + one[2:]
    shift = np.uint32(32 - BUCKET_BITS)
    return np.bincount(np.concatenate([(x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift for x in (one, two, three)]), minlength=1 << BUCKET_BITS)


def _features(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32, copy=False))
    x /= np.linalg.norm(x, axis=-1, keepdims=True)
    return x


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1: all ways to divide up to seven languages in two, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        rest = np.array(list(itertools.product((1, -1), repeat=n - 1))[1:])
        return np.hstack([np.ones((len(rest), 1)), rest]).T
    bits, rng, best = int(10 * np.log2(n)) + 1, np.random.default_rng(7), (-1, None)
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * bits).min()
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the vote, and its lead over the next."""
        margin = _features(counts) @ self.weights + self.bias
        lost = np.logaddexp(0, -SLOPE * margin[:, None, :] * self.codes[None]) @ self.trust
        share = np.exp(-(lost - lost.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        top = np.sort(share, axis=1)
        return best, share.max(1), top[:, -1] - (top[:, -2] if share.shape[1] > 1 else 0)


def _ridge(x: np.ndarray, y: np.ndarray, some: np.ndarray | slice = slice(None), strength: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares classifiers for all bits at once, fitted on ``some`` rows and solved in the rows' own space.

    Features are taken a piece at a time, so that no second copy of ``x`` is made on the driver.
    """
    y = y[some]
    bias = y.mean(0)
    pieces = [slice(a, a + 1024) for a in range(0, x.shape[1], 1024)]
    k = sum(part @ part.T for part in (x[some, p] for p in pieces))
    k.flat[:: len(k) + 1] += strength
    solved = np.linalg.solve(k, y - bias)
    return np.concatenate([x[some, p].T @ solved for p in pieces]), bias


def fit(docs: DataFrame, learnable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 2400) -> LanguageModel:
    """Fits on at most about ``sample_rows`` labelled rows, the same number of each language.

    Which rows: those ``learnable`` with the least hashes of id. Rows without text, letters or label
    teach nothing; without any labelled row the model knows no language.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not totals:
        return LanguageModel([], np.ones((0, 1)), np.zeros((1 << BUCKET_BITS, 1)), np.zeros(1), np.ones(1))
    each = max(8, sample_rows // len(totals))
    span = 1 << 30
    drawn = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(span))
    share = F.create_map(*[F.lit(v) for lang, n in totals.items() for v in (lang, min(span, int(span * each / n) + 1))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, ngram_counts(text)) for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            found = [(lang, c) for lang, c in found if c is not None]
            at = [np.nonzero(c)[0] for _, c in found]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([i.astype("<i4").tobytes() for i in at], pa.binary()), pa.array([c[i].astype("<f4").tobytes() for i, (_, c) in zip(at, found, strict=True)], pa.binary())], ["lang", "at", "n"])

    sample = rows.filter(drawn < share[F.col("lang")]).select("lang", "text").mapInArrow(task, "lang string, at binary, n binary").collect()
    sample.sort(key=lambda r: (r["lang"], r["at"], r["n"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return LanguageModel([], np.ones((0, 1)), np.zeros((1 << BUCKET_BITS, 1)), np.zeros(1), np.ones(1))
    x = np.zeros((len(sample), 1 << BUCKET_BITS), np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["n"], "<f4")
    x = _features(x)
    codes = codewords(len(languages))
    y = codes[[languages.index(r["lang"]) for r in sample]]
    held = np.arange(len(sample)) % 5 == 0
    trust = np.ones(codes.shape[1])
    if len(sample) >= 50:
        w, b = _ridge(x, y, np.flatnonzero(~held))
        right = ((x[held] @ w + b) * y[held] > 0).mean(0)
        trust = np.log((right + 0.01) / (1.01 - right)).clip(0.05) / np.log(101)
    w, b = _ridge(x, y)
    del x, sample
    give_back()
    return LanguageModel(languages, codes, w.astype(np.float32), b.astype(np.float32), trust)


FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous as further columns; ``predict`` with plain columns.

    Columns of those names are replaced.
    """
    kept = [c for c in docs.columns if c not in FOUND.names]
    into = free_name(docs)
    return predict(docs.select(*[F.col(f"`{c}`") for c in kept]), model, into, text_col=text_col).select(*[F.col(f"`{c}`") for c in kept], f"{into}.*")


def predict(docs: DataFrame, model: LanguageModel, into: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``into`` of lang_pred, score and ambiguous; all its rows and columns stay.

    A null text or one without letters is ``und`` with score 0, not ambiguous. ``into`` must be no
    column of ``docs``. The model (a few hundred KB) goes to the tasks with their code.
    """
    if into in docs.columns:
        raise ValueError(f"{into} is a column already")
    small_batches(docs.sparkSession)
    kept = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(into, FOUND)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 128):
                batch = whole.slice(start, 128)
                names, scores, unsure = [UNKNOWN] * len(batch), np.zeros(len(batch)), np.zeros(len(batch), bool)
                counts = [ngram_counts(t.as_py()) for t in batch.column(kept.index(text_col))] if model.languages else []
                at = [i for i, c in enumerate(counts) if c is not None]
                if at:
                    best, share, lead = model.predict(np.stack([counts[i] for i in at]))
                    for i, b, s, d in zip(at, best, share, lead, strict=True):
                        names[i], scores[i], unsure[i] = model.languages[b], s, d < LEAD
                found = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(unsure)], FOUND.names)
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*kept, into])
        give_back()

    return docs.mapInArrow(task, schema)


def fold(id_col: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
