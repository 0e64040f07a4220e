"""Helpers shared by the text operators: row keys, column names, Arrow batches, hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize  # noqa: F401

#: Fixed value: words are parted by ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the corpus: it is shuffled at every size, so the plan of a small table is that of a large one."""
    return df.hint("merge")


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table hasn't."""
    return next(n for n in (f"{name}_{i}" for i in range(len(df.columns) + 1)) if n.lower() not in {c.lower() for c in df.columns})


def row_key(text: str = "text") -> Column:
    """One key for all rows of the same doc_id and text; with doc_id beside it, it joins back to the rows."""
    return F.xxhash64(F.col("doc_id"), F.col(text))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k and the whole text as UTF-8 bytes (null: empty)."""
    return docs.select("doc_id", row_key().alias("k"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("b"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["k"] == b["k"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def slices(batches, column: str, most: int = 4 << 20):
    """Runs of rows whose `column` holds about `most` bytes, so that memory follows neither batch nor partition."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).to_pylist()
        start, size = 0, 0
        for i, v in enumerate(values):
            size += len(v or b"")
            if size >= most:
                yield batch.slice(start, i + 1 - start), values[start : i + 1]
                start, size = i + 1, 0
        if start < len(values):
            yield batch.slice(start), values[start:]


def fmix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer that spreads every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of a set of half-open spans."""
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return [(s, e) for s, e in runs]


def word_hashes(words: list[bytes], memo: dict) -> np.ndarray:
    """64-bit hashes of words; memo only saves time, and is bounded: 200,000 words of at most 64 bytes."""
    import xxhash

    if len(memo) > 200_000:
        memo.clear()
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        v = memo.get(w)
        if v is None:
            v = xxhash.xxh3_64_intdigest(w)
            if len(w) <= 64:
                memo[w] = v
        h[i] = v
    return h
