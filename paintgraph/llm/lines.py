"""Line dedup with content-defined chunks of lines.

A rolling hash over the hashes of the last three lines ends a chunk where it falls under a bound, so chunk borders
follow content and survive insertions. Chunks of two lines or more that occur again anywhere are removed but for
their first occurrence (by doc_id, then place); equality is settled by bytes, not by hashes.

Chunks alone miss passages inside which no two borders fall. With `runs`, every pair of successive lines with words
(and the blank lines between) is looked up like a chunk, so that all lines in later occurrences of repeated runs of two
lines or more go, wherever they stand. Each line removed still stands at an earlier place.

Contract. Lines are split at \\n alone. Null texts have no lines and stay null; an empty text is one empty line.
Single lines are never removed. Repeated rows are occurrences like others: the first keeps the chunk (rows that
agree in doc_id and text keep or lose it together). Texts of any length are handled whole. Empty table: empty
result. Other columns stay as they are.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Table
from .common import keyed, materialize, row_key, same_row, shuffled, slices, unused

#: A chunk ends after a line where (h0 + 3 h1 + 5 h2) mod MODULUS < BOUND; h: first 32 bits of a line's md5.
MODULUS, BOUND, MIN_LINES = 97, 24, 2
#: Pairs of lines are numbered from here on, by their first line.
PAIRS = 1 << 30


def chunk_lines(lines: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of lines; they cover the text."""
    out, start, h1, h2 = [], 0, 0, 0
    for i, line in enumerate(lines):
        h0 = int.from_bytes(hashlib.md5(line, usedforsecurity=False).digest()[:4], "big")
        if (h0 + 3 * h1 + 5 * h2) % MODULUS < BOUND or i + 1 == len(lines):
            out.append((start, i + 1))
            start = i + 1
        h1, h2 = h0, h1
    return out


def parts_of(lines: list[bytes], runs: bool) -> list[tuple[int, int, int]]:
    """Number, start and stop of each chunk of MIN_LINES lines or more; with `runs` also of each pair of successive lines with words, from number PAIRS on."""
    out = [(i, s, e) for i, (s, e) in enumerate(chunk_lines(lines)) if e - s >= MIN_LINES]
    if runs:
        at = [i for i, line in enumerate(lines) if line.strip()]  # bytes.strip() takes ASCII white space alone
        out += [(PAIRS + a, a, b + 1) for a, b in zip(at, at[1:])]
    return out


def _chunks(rows: DataFrame, wanted: bool = False, runs: bool = False) -> DataFrame:
    """doc_id, k, i, h (hash, its last bit tells pairs from chunks) of each part; with `wanted` only those whose number is in it, and their bytes."""
    import xxhash

    def run(batches):
        for batch, values in slices(batches, "b"):
            at, number, h, body = [], [], [], []
            picks = batch.column(batch.schema.get_field_index("wanted")).to_pylist() if wanted else None
            for n, b in enumerate(values):
                lines = b.split(b"\n")
                own = set(picks[n]) if picks else None
                for i, s, e in parts_of(lines, runs):
                    if own is None or i in own:
                        text = b"\n".join(lines[s:e])
                        at.append(n)
                        number.append(i)
                        h.append((xxhash.xxh3_64_intdigest(text) - (1 << 63)) >> 1 << 1 | (i >= PAIRS))
                        body.append(text)
            take = pa.array(at, pa.int64())
            cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(number, pa.int32()), pa.array(h, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(body, pa.binary())] * wanted, names=["doc_id", "k", "i", "h", "body"][: 4 + wanted])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, k long, i int, h long" + ", body binary" * wanted)


def doomed(docs: DataFrame, runs: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows that hold recurring chunks (doc_id, k, b, wanted), and doc_id, k, gone (numbers of the chunks to remove) of those that lose some.

    Whole texts are shuffled once, to meet the numbers of their recurring chunks; what follows reads only those rows.
    """
    rows = keyed(docs.where(F.col("text").isNotNull()))
    chunks = Table(_chunks(rows, runs=runs), "chunks")
    again = Table(chunks.df.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "again")
    some = Table(chunks.df.join(shuffled(again.df), "h"), "candidates")  # between written tables, a hot chunk's partition can be split
    chunks.free()
    again.free()
    wanted = some.df.groupBy("doc_id", "k").agg(F.collect_set("i").alias("wanted"))
    texts = materialize(rows.join(shuffled(wanted), same_row(rows, wanted)).select(rows["doc_id"], rows["k"], "b", "wanted"), "texts")
    bodies = Table(_chunks(texts, wanted=True, runs=runs), "bodies")
    place = F.struct("doc_id", "k", "i")
    classes = bodies.df.groupBy("h").agg(F.min("body").alias("low"), F.max("body").alias("high"), F.min(place).alias("first")).select("h", "first", (F.col("low") == F.col("high")).alias("same"))
    classes = Table(classes, "classes")
    verdict = some.df.join(shuffled(classes.df.where("same").select("h", "first")), "h").where(place != F.col("first")).select("doc_id", "k", "i")
    # chunks that share a hash but not their bytes: compared as they are
    apart = bodies.df.join(classes.df.where("NOT same").select("h"), "h")
    firsts = apart.groupBy("h", "body").agg(F.min(place).alias("first"))
    verdict = verdict.union(apart.join(firsts, ["h", "body"]).where(place != F.col("first")).select("doc_id", "k", "i"))
    gone = materialize(verdict.groupBy("doc_id", "k").agg(F.collect_set("i").alias("gone")), "gone")
    for t in (some, bodies, classes):
        t.free()
    return texts, gone


def cut(rows: DataFrame, runs: bool = False) -> DataFrame:
    """doc_id, k, b, gone to doc_id, k, kept, n_lines, n_removed, n_chunks."""

    def run(batches):
        for batch, values in slices(batches, "b"):
            out = []
            for b, gone in zip(values, batch.column(batch.schema.get_field_index("gone")).to_pylist(), strict=True):
                lines, own = b.split(b"\n"), set(gone or ())
                lost = {j for i, s, e in parts_of(lines, runs) if i in own for j in range(s, e)}
                left = [x for j, x in enumerate(lines) if j not in lost]
                out.append((b"\n".join(left), len(lines), len(lines) - len(left), len(own)))
            kept, lines, removed, chunks = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (lines, removed, chunks))], names=["doc_id", "k", "kept", "n_lines", "n_removed", "n_chunks"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, k long, kept binary, n_lines long, n_removed long, n_chunks long")


def changed(docs: DataFrame, runs: bool = False) -> DataFrame:
    """doc_id, k, kept and counts of the rows that lose lines; rows alike in doc_id and text come once."""
    texts, gone = doomed(docs, runs)
    hit = texts.join(shuffled(gone), same_row(texts, gone)).select(texts["doc_id"], texts["k"], "b", "gone")
    return materialize(cut(hit, runs), "cut").dropDuplicates(["doc_id", "k"])


def dedup_documents(docs: DataFrame, runs: bool = False) -> DataFrame:
    """All columns of docs with the remaining text; documents that lose their last word this way are dropped."""
    row, key, i, kept = (unused(docs, n) for n in ("row", "key", "id", "kept"))
    new = changed(docs, runs).select(F.col("doc_id").alias(i), F.col("k").alias(key), F.col("kept").cast("string").alias(kept))
    d = docs.withColumn(row, row_key())
    j = d.join(shuffled(new), (F.col(row) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(i)), "left")
    j = j.where(F.col(key).isNull() | F.col(kept).rlike(r"[^\x20\x09-\x0D]"))
    return j.select(*[F.coalesce(kept, "text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of each row."""
    base = docs.select("doc_id", row_key().alias("k"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"))
    base = base.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    new = changed(docs).select("doc_id", "k", "n_removed", F.sha2("kept", 256).alias("part"))
    return base.join(shuffled(new), same_row(base, new), "left").select(base["doc_id"], "n_lines", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("part", "whole").alias("kept_sha256"))
