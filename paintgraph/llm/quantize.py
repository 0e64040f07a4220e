"""Vector code compression: integer product codes, with segment-mean lower bounds.

Components become integers floor(scale * x), vectors are cut into `parts` equal parts, and each part position has a
codebook of `entries` integer vectors, fitted by rounds of Lloyd's steps over all vectors. A code is the index of the
nearest entry for each part; decoding puts the entries together again.

Nearest entries are found coarse to fine. A part and an entry are cut into 1, then 2, then 4 blocks of size b; with block
sums s, t and residual norms R, S their squared distance is at least the sum over blocks of (s - t)^2 / b + (R - S)^2.
The entry with the least coarse bound is measured exactly first, so each part has a distance that some entry reaches.
An entry whose bound, lowered by a margin for rounding, passes it at any level can't be nearest nor tie, and goes.
The survivors receive exact integer distances; ties go to the lower index.

Scale. Integers are written once and read by each round. A round is one job without a shuffle of vectors: a task gives at
most parts x entries rows of sums, and the driver holds the codebooks alone (parts x entries vectors).

Contract. Rows whose vector is null, empty, or holds null or non-finite components are left out. So are rows whose length
differs from that of the smallest vec_id's vector, or if that can't be cut, all rows: ValueError. Integers are held to
+-2^28 (|x| up to 65536), so that squared distances fit a long. Repeated vec_ids are coded row by row; for the first
entries the least of their vectors stands. A null vec_id is coded, and is no first entry. Fewer than `entries` vec_ids:
codebooks as long as there are. Null labels are one label. Empty table: empty result. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Table
from .common import materialize, shuffled

SCALE, PARTS, ENTRIES, ROUNDS, LIMIT, ROWS = 4096, 8, 16, 6, 1 << 28, 1 << 13


@dataclass(frozen=True)
class Codebooks:
    """entries: integers of shape (parts, entries, length of a part)."""

    entries: np.ndarray
    scale: int = SCALE

    def text(self) -> str:
        return ",".join(map(str, self.entries.reshape(-1).tolist()))

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    def table(self, spark) -> DataFrame:
        """part, entry, v."""
        rows = [(p, e, v) for p, book in enumerate(self.entries.tolist()) for e, v in enumerate(book)]
        return spark.createDataFrame(rows, "part int, entry int, v array<long>")


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (array of int) of the rows that count."""
    finite = F.forall("embedding", lambda x: F.coalesce(x > float("-inf"), F.lit(False)) & F.coalesce(x < float("inf"), F.lit(False)))  # NaN is above all
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite)
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))).cast("int"))
    return kept.select("vec_id", "label", whole.alias("v"))


def blocks(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and residual norms of `count` blocks of the last axis."""
    b = x.shape[-1] // count
    x = x.reshape(*x.shape[:-1], count, b).astype(np.float64)
    sums = x.sum(-1)
    return sums, np.sqrt(np.maximum((x - sums[..., None] / b) ** 2, 0).sum(-1))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of one codebook for each row, and its squared distance; exact, ties to the lower index."""
    n, d = x.shape
    exact = lambda i, e: ((x[i] - book[e]) ** 2).sum(1)
    levels = [c for c in (1, 2, 4) if d % c == 0 and d // c > 1] or [1]
    row = entry = best = None
    for c in levels:
        (s, r), (t, q), b = blocks(x, c), blocks(book, c), d // c
        if row is None:
            bound = ((s[:, None] - t) ** 2 / b + (r[:, None] - q) ** 2).sum(2)
            best = exact(np.arange(n), bound.argmin(1)).astype(np.float64)
            row, entry = np.nonzero(bound * (1 - 1e-9) - 1e-3 <= best[:, None])
            continue
        bound = ((s[row] - t[entry]) ** 2 / b + (r[row] - q[entry]) ** 2).sum(1)
        left = bound * (1 - 1e-9) - 1e-3 <= best[row]
        row, entry = row[left], entry[left]
    found = np.full((n, len(book)), np.iinfo(np.int64).max)
    found[row, entry] = exact(row, entry)
    index = found.argmin(1)  # the first of equals
    return index, found[np.arange(n), index]


def _matrices(batches):
    """Runs of rows with their integers as (rows, parts x length) matrices; rows of one length alone come here."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            own = batch.slice(at, ROWS)
            v = own.column(own.schema.get_field_index("v"))
            yield own, v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), -1)


def sums(whole: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and sum of the parts that each entry is nearest to."""
    parts, entries, d = books.shape

    def run(batches):
        total, count = np.zeros((parts, entries, d), np.int64), np.zeros((parts, entries), np.int64)
        for _, x in _matrices(batches):
            for p in range(parts):
                own = x[:, p * d : (p + 1) * d]
                index = nearest(own, books[p])[0]
                np.add.at(total[p], index, own)
                count[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["p", "e", "n", "s"])

    each = [F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(d)]
    rows = whole.mapInArrow(run, "p long, e long, n long, s array<long>").groupBy("p", "e").agg(F.sum("n").alias("n"), *each).collect()  # parts x entries rows
    return {(r.p, r.e): (r.n, [r[f"s{j}"] for j in range(d)]) for r in rows}


def first_entries(whole: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Parts of the smallest vec_ids' vectors, ascending."""
    rows = whole.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    if not rows:
        return None
    if len(rows[0].v) % parts:
        raise ValueError(f"vectors of {len(rows[0].v)} components can't be cut into {parts} equal parts")
    rows = [r.v for r in rows if len(r.v) == len(rows[0].v)]
    return np.array(rows, np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def fit(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of a written table of integers; None if no row with a vec_id is left."""
    books = first_entries(whole, parts, entries)
    if books is None:
        return None
    of_length = whole.where(F.size("v") == books.shape[0] * books.shape[2])
    for _ in range(rounds):
        new = books.copy()
        for (p, e), (n, s) in sums(of_length, books).items():
            new[p, e] = [x // n for x in s]  # floors go down
        books = new
    return Codebooks(books, scale)


def encode(whole: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distance of integers); no shuffle."""
    b = books.entries
    parts, _, d = b.shape

    def run(batches):
        for own, x in _matrices(batches):
            index, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                index[:, p], dist = nearest(x[:, p * d : (p + 1) * d], b[p])
                error += dist
            yield pa.RecordBatch.from_arrays([*own.columns[:2], pa.array([r.tobytes().hex() for r in index], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = [whole.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return whole.where(F.size("v") == parts * d).select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """Adds `vector`, what the code stands for: its entries in a row, over the scale. Columns only; the codebooks are a literal."""
    book = F.lit(books.entries.tolist()) if books.entries.size else F.array()
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)), lambda p: F.get(F.get(book, p), F.conv(F.substr("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int"))))
    return coded.withColumn("vector", F.transform(whole, lambda x: x / books.scale))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """Codes (vec_id, label, code, error) of all rows that count, and the codebooks."""
    whole = Table(integers(vectors, scale), "integers")
    books = fit(whole.df, parts, entries, rounds, scale)
    if books is None:  # rows without any vec_id have no codebooks
        return whole.df.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), None
    coded = materialize(encode(whole.df, books), "coded")
    whole.free()
    return coded, books


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = compress(vectors)
    total = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", "of")
    done = coded.join(shuffled(total), F.col("label").eqNullSafe(F.col("of")))
    return done.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
