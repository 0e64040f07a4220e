"""Exact repeated windows over a whole corpus, from anchors.

A window is `length` elements (bytes or words) of one document. Each window's anchor is the k-gram of least hash in
it, so equal windows have equal anchors at the same place. Consecutive windows with one anchor are a segment; a few
numbers stand for it. Anchors seen once can't belong to a repeated window. Segments of one anchor and equal content
are a class with a weight (partial sums first, so thousands of copies cost one row a task), and one representative
context of each class goes to a resolver (suffix arrays or suffix automata) with that weight. The resolver alone says
which windows recur; its spans go back to all segments of the class.

A resolver takes at most MOST contexts of a key. Keys with more are split by longer keys: windows that reach far to
the left of the key take the elements before it into the key, the others those after it. Equal windows stay together,
contexts that now agree become one class, and after log2(length) splits a key is a whole window, so every group gets
small enough, whatever the number of contexts.

Contents of one anchor are told apart by 64-bit hashes: two of m different ones collide with odds of about m^2 / 2^65.
Anchors whose hashes collide do no harm, for resolvers compare elements.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Table
from .common import covered, fmix, keyed, same_row, shuffled, slices

#: Contexts of one key that a resolver takes at most.
MOST = 500
_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_state: dict = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, kept by each worker."""
    if "p" not in _state or len(_state["p"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _state["p"], _state["i"] = _powers(size, int(_B)), _powers(size, pow(int(_B), -1, 1 << 64))
    return _state["p"], _state["i"]


class Rolling:
    """Polynomial hashes modulo 2^64 of every slice of a sequence of 64-bit elements."""

    def __init__(self, x: np.ndarray):
        powers, self.inverse = _tables(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * powers[: len(x)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return fmix((self.sums[stop] - self.sums[start]) * self.inverse[start])


@dataclass(frozen=True)
class Kind:
    """Elements of a text: how many make a window, how many an anchor, and their 64-bit values."""

    length: int
    k: int
    split: Callable  # bytes -> sequence of elements
    values: Callable  # (elements of all texts, memo) -> uint64 array
    pack: Callable  # slice of elements -> bytes
    shard: int = 1 << 20  # bytes of contexts that a resolver takes at once, about


_byte_values = fmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_kind(length: int = 400, k: int = 128) -> Kind:
    return Kind(length, k, lambda b: b, lambda parts, memo: _byte_values[np.frombuffer(b"".join(parts), np.uint8)], bytes)


def _hash_words(parts, memo):
    from .common import word_hashes

    return np.concatenate([word_hashes(p, memo) for p in parts]) if parts else np.zeros(0, np.uint64)


def word_kind(length: int = 35, k: int = 6) -> Kind:
    return Kind(length, k, bytes.split, _hash_words, b" ".join, 1 << 18)  # bytes.split() splits at ASCII white space alone


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    size = 1
    while 2 * size <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if w > size else v


def segments_of(kind: Kind, parts: list, memo: dict):
    """Segments of several texts: text, anchor hash, content hash, first and last window, anchor place."""
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    empty = np.zeros(0, np.int64)
    if n < kind.length:
        return (empty,) * 6
    rolling = Rolling(kind.values(parts, memo))
    at = np.arange(n - kind.k + 1)
    grams = rolling.of(at, at + kind.k)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    least = sliding_least((grams >> bits << bits) | at.astype(np.uint64), kind.length - kind.k + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    counts = np.maximum(0, sizes - kind.length + 1)
    starts = np.repeat(ends - sizes, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(starts):
        return (empty,) * 6
    own, place = np.repeat(np.arange(len(parts)), counts), anchor[starts]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (own[1:] != own[:-1]))))
    last = np.concatenate((new[1:], [len(starts)])) - 1
    s1, s2, p, text = starts[new], starts[last], place[new], own[new]
    shape = (p - s1).astype(np.uint64) * np.uint64(1 << 20) + (s2 - s1).astype(np.uint64)
    content = rolling.of(s1, s2 + kind.length) ^ fmix(shape + np.uint64(1))
    base = (ends - sizes)[text]
    return text, grams[p].view(np.int64), content.view(np.int64), s1 - base, s2 - base, p - base


def segments(docs: DataFrame, kind: Kind) -> DataFrame:
    """k, doc_id, a, c, s1, s2, p for every segment of every text."""

    def run(batches):
        memo: dict = {}
        for batch, texts in slices(batches, "b", 1 << 20):
            text, a, c, s1, s2, p = segments_of(kind, [kind.split(t) for t in texts], memo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), *(pa.array(x) for x in (a, c)), *(pa.array(x.astype(np.int32)) for x in (s1, s2, p))], names=["doc_id", "k", "a", "c", "s1", "s2", "p"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k long, a long, c long, s1 int, s2 int, p int")


def _batch(rows: list, types: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)


def contexts(rows: DataFrame, picks: DataFrame, kind: Kind) -> DataFrame:
    """a, c, n, off, size, ctx: of each class one context (elements, packed), where its key begins and how long it is."""
    by_text = picks.groupBy("doc_id", "k").agg(F.collect_list(F.struct("a", "c", "n", "s1", "s2", "p")).alias("segs"))
    once = rows.join(shuffled(by_text), same_row(rows, by_text)).select(rows["k"], "b", "segs")

    def run(batches):
        for batch, values in slices(batches, "b", 2 << 20):
            out = []
            for b, own in zip(values, batch.column(batch.schema.get_field_index("segs")).to_pylist(), strict=True):
                parts = kind.split(b)
                out += [(s["a"], s["c"], s["n"], s["p"] - s["s1"], kind.k, kind.pack(parts[s["s1"] : s["s2"] + kind.length])) for s in own]
            yield _batch(out, [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()], ["a", "c", "n", "off", "size", "ctx"])

    # rows repeated with doc_id and text give one context each; one of them stays
    return once.mapInArrow(run, "a long, c long, n long, off int, size int, ctx binary").dropDuplicates(["a", "c"])


def halves(work: DataFrame, kind: Kind) -> DataFrame:
    """Contexts under longer keys: a, c, shift, a2, c2, n, off, size, ctx; a context gives one row or two.

    The windows that begin `left` elements or more before the key hold those elements too; the others hold the
    elements that follow it.
    """
    import xxhash

    def run(batches):
        for batch, values in slices(batches, "ctx", 1 << 20):
            col = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name)).to_pylist()
            out = []
            for a, c, n, off, size, ctx in zip(col("a"), col("c"), col("n"), col("off"), col("size"), values, strict=True):
                parts = kind.split(ctx)
                last, spare = len(parts) - kind.length, kind.length - size
                left = (spare + 1) // 2
                ways = [(0, min(off - left, last), off - left, size + left), (max(0, off - left + 1), last, off, size + spare - left + 1)]
                for side, (first, end, at, new) in enumerate(ways):
                    if first <= end:
                        part = kind.pack(parts[first : end + kind.length])
                        key = xxhash.xxh3_64_intdigest(kind.pack(parts[at : at + new]), (a * 2 + side) & (2**64 - 1))
                        content = xxhash.xxh3_64_intdigest(part, at - first)
                        out.append((a, c, first, key - (1 << 63), content - (1 << 63), n, at - first, new, part))
            yield _batch(out, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], ["a", "c", "shift", "a2", "c2", "n", "off", "size", "ctx"])

    return work.mapInArrow(run, "a long, c long, shift int, a2 long, c2 long, n long, off int, size int, ctx binary")


def _resolve(work: DataFrame, kind: Kind, resolve: Callable) -> DataFrame:
    """a, c, start, stop: spans of elements of the contexts, from whole groups of a key; a task holds a shard of them."""

    def groups(batches):
        held: list = []
        size = 0
        close = lambda: _batch(resolve(held), [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["a", "c", "start", "stop"])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > kind.shard and row[0] != held[-1][0]:
                    yield close()
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield close()

    cols = ["a", "c", "n", "off", "size", "ctx"]
    return work.select(*cols).repartition("a").sortWithinPartitions("a", "c").mapInArrow(groups, "a long, c long, start int, stop int")


def resolved(first: Table, kind: Kind, resolve: Callable) -> Table:
    """a, c, start, stop for the contexts of `first`, which is freed."""
    levels, done, work = [], [], first
    while True:
        crowded = Table(work.df.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MOST).select("a"), "crowded")
        some = crowded.df.limit(1).count()
        usual = work.df.join(crowded.df, "a", "left_anti") if some else work.df
        done.append(Table(_resolve(usual, kind, resolve), "spans"))
        if not some:
            break
        subs = Table(halves(work.df.join(crowded.df, "a", "left_semi"), kind), "halves")
        again = subs.df.groupBy(F.col("a2").alias("a"), F.col("c2").alias("c")).agg(F.sum("n").alias("n"), *[F.first(x).alias(x) for x in ("off", "size", "ctx")])
        work.free()
        crowded.free()
        work = Table(again, "contexts")
        levels.append(Table(subs.df.select("a", "c", "shift", "a2", "c2"), "levels"))
        subs.free()
    work.free()
    crowded.free()
    below = done.pop()
    for level in reversed(levels):  # spans of the longer keys belong to the contexts that they were cut from
        deep = below.df.withColumnsRenamed({"a": "a2", "c": "c2"})
        own = done.pop()
        up = level.df.join(shuffled(deep), ["a2", "c2"]).select("a", "c", (F.col("start") + F.col("shift")).alias("start"), (F.col("stop") + F.col("shift")).alias("stop"))
        new = Table(own.df.union(up), "spans")
        for t in (below, level, own):
            t.free()
        below = new
    return below


def spans(docs: DataFrame, kind: Kind, resolve: Callable) -> DataFrame:
    """doc_id, k, b, spans (element ranges) of the rows with repeated windows."""
    rows = keyed(docs)
    segs = Table(segments(rows, kind), "segments")
    seen = Table(segs.df.groupBy("a").agg(F.count(F.lit(1)).alias("t")).where("t > 1").select("a"), "seen")
    some = Table(segs.df.join(shuffled(seen.df), "a"), "repeated")  # between written tables, a hot anchor's partition can be split
    segs.free()
    seen.free()
    # min of a struct picks one representative place for each content
    classes = some.df.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "s1", "s2", "p", "doc_id")).alias("at"))
    ctx = Table(contexts(rows, classes.select("a", "c", "n", "at.*"), kind), "contexts")
    found = resolved(ctx, kind, resolve)
    runs = found.df.groupBy("a", "c").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    place = F.transform("runs", lambda r: F.struct((r["start"] + F.col("s1")).alias("start"), (r["stop"] + F.col("s1")).alias("stop")))
    runs = Table(runs, "runs")
    own = some.df.join(shuffled(runs.df), ["a", "c"]).select("doc_id", "k", place.alias("runs"))
    own = Table(own.groupBy("doc_id", "k").agg(F.flatten(F.collect_set("runs")).alias("spans")), "runs")
    for t in (some, found, runs):
        t.free()
    return rows.join(shuffled(own.df), same_row(rows, own.df)).select(rows["doc_id"], rows["k"], "b", "spans")


def cut(found: DataFrame, kind: Kind, glue: bytes) -> DataFrame:
    """Adds to rows of `spans`: kept (bytes), n_removed, n_spans."""

    def run(batches):
        for batch, values in slices(batches, "b", 4 << 20):
            kept, removed, runs = [], [], []
            for b, own in zip(values, batch.column(batch.schema.get_field_index("spans")).to_pylist(), strict=True):
                parts, gone = kind.split(b), covered([(s["start"], s["stop"]) for s in own])
                at, pieces = 0, []
                for start, stop in gone:
                    pieces.append(parts[at:start])
                    at = stop
                pieces.append(parts[at:])
                kept.append(glue.join(kind.pack(x) for x in pieces if len(x)))
                removed.append(sum(e - s for s, e in gone))
                runs.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=["doc_id", "k", "kept", "n_removed", "n_spans"])

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, k long, kept binary, n_removed long, n_spans long")
