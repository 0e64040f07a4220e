"""MinHash near-dedup with fast similarity sketching.

A document is the set of its distinct `words`-word shingles. Its sketch has T coordinates: in round i each element
falls into a hashed bin with a hashed value, later rounds only fill bins that are still empty, and rounds T and on
are bound to one bin each, so every coordinate fills; a large set takes a round or two. Documents with equal sets
are one vertex. Vertices that share a band of the sketch are a bucket, and only pairs of a bucket are candidates.

Candidates are compared on full sets in two steps. First each bucket's smallest member is held against the others,
whose number is linear in the bucket: groups of near copies are mostly one component after it. Then the buckets that
still hold more than one component, each set of members once, have their pairs of different components compared:
buckets beyond BLOCK members by classes of like set size (a pair above the threshold lies in one class or in two
neighbouring ones) and in pairs of blocks, bounded by members and by shingles, so no task holds a large bucket. Components of the confirmed links are the
result.

Bands: BANDS of ROWS coordinates; two sets at similarity 0.85 share none with probability 2.4e-7, at 0.8 3.3e-5.
Sets are sets of 64-bit hashes; two of m different shingles of a pair of documents collide with odds of m^2 / 2^65.

Contract. Null texts and texts without words have empty sets: linked with nothing. Fewer words than a shingle: the
whole sequence is one shingle. Rows with the same doc_id are one node. A null doc_id can't be named: such a row is
linked with nothing and kept. Repeated texts link. Texts of any length are handled whole. Empty table: empty result.
Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Table, components
from .common import fmix, materialize, shuffled, slices, unused, word_hashes

ROWS, BANDS, BLOCK = 5, 26, 256
#: Shingles that a share or block of members holds on average at most, for sets of long texts are large (8 bytes each).
BLOCK_SHINGLES = 1 << 22
T = ROWS * BANDS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x2545F4914F6CDD1D, 0x27D4EB2F165667C5, 0x94D049BB133111EB], np.uint64)


def shingle_sets(texts: list[bytes], words: int, memo: dict) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    split = [b.lower().split() for b in texts]  # bytes.lower() changes A-Z alone
    sets = []
    for own in split:
        h = word_hashes(own, memo)
        size = min(words, len(own))
        if not size:
            sets.append(np.zeros(0, np.uint64))
            continue
        total = np.full(len(h) - size + 1, size, np.uint64)
        for j in range(size):
            total += fmix(h[j : len(h) - size + 1 + j] * _MULTIPLIERS[j % 8] + np.uint64(j))
        sets.append(np.unique(fmix(total)))
    return sets


def sketches(x: np.ndarray, owner: np.ndarray, n: int, t: int = T) -> np.ndarray:
    """Fast similarity sketches (n, t) of non-empty sets given as elements and their owners."""
    out = np.full(n * t, _EMPTY, np.uint64)
    for i in range(2 * t):
        h = fmix(x + np.uint64((i + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        place = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + place, (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32))
        short = (out.reshape(n, t) == _EMPTY).any(1)
        if not short.any():
            break
        left = short[owner]
        x, owner = x[left], owner[left]
    return out.reshape(n, t)


def band_hashes(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sketch.reshape(len(sketch), -1, rows)
    total = np.zeros(parts.shape[:2], np.uint64)
    for j in range(rows):
        total = fmix(total * _MULTIPLIERS[1] + parts[:, :, j])
    return total.view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), e1, e2 (sums that name the set), bands."""

    def run(batches):
        memo: dict = {}
        for batch, values in slices(batches, "b", 1 << 20):
            sets = shingle_sets(values, words, memo)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            e = np.zeros((2, len(sets)), np.int64)
            bands: list = [None] * len(sets)
            if len(full):
                x = np.concatenate([sets[i] for i in full])
                own = np.repeat(np.arange(len(full)), sizes[full])
                starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                for j in (0, 1):
                    e[j, full] = np.add.reduceat(fmix(x ^ _MULTIPLIERS[j + 3]), starts).view(np.int64)
                for i, b in zip(full, band_hashes(sketches(x, own, len(full))), strict=True):
                    bands[i] = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(e[0]), pa.array(e[1]), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "e1", "e2", "bands"])

    return _rows(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, e1 long, e2 long, bands array<bigint>")


def links(sets: list[np.ndarray], first: int, percent: int, labels: list) -> list[tuple[int, int]]:
    """Spanning links of the pairs with 100 * common >= percent * union and different labels; first: pairs have one side below it (0: any)."""
    m = len(sets)
    place: dict = {}
    group = [place.setdefault(x, i) for i, x in enumerate(labels)]  # members of one component are joined already

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    out = []

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            group[a] = b
            out.append((i, j))

    sizes = np.array([len(s) for s in sets])
    if m <= 4:
        for i in range(m):
            for j in range(i):
                if (first and (i < first) == (j < first)) or root(i) == root(j):
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                    join(i, j)
        return out
    tokens, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(m), sizes)
    useful = count[inverse] > 1  # a shingle of one set is in no intersection
    number = np.cumsum(count > 1) - 1
    col, doc = number[inverse[useful]], doc[useful]
    width = int((count > 1).sum())
    rows_at = np.searchsorted(doc, np.arange(m + 1))
    by_col = np.argsort(col, kind="stable")
    col_at = np.searchsorted(col[by_col], np.arange(width + 1))
    dense = m * width <= 24_000_000
    if dense:
        matrix = np.zeros((m, width), np.float32)
        matrix[doc, col] = 1
    for top in range(first or 1, m, 128):
        product = matrix[top : top + 128] @ matrix[: first or min(m, top + 128)].T if dense else None
        for i in range(top, min(m, top + 128)):
            to = first or i
            if dense:
                common = product[i - top, :to].astype(np.int64)
            else:
                posts = [by_col[col_at[c] : col_at[c + 1]] for c in col[rows_at[i] : rows_at[i + 1]]]
                common = np.bincount(doc[np.concatenate(posts)], minlength=m)[:to] if posts else np.zeros(to, np.int64)
            for j in np.flatnonzero(100 * common >= percent * (sizes[i] + sizes[:to] - common)).tolist():
                join(i, j)
    return out


def compared(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """u, v: links inside items. members: doc_id, item, side (0, or 1 for the other side of an item whose pairs are across), across, label.

    Texts become sets once a document, which then goes to all its items.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = members.groupBy("doc_id").agg(F.collect_set(F.struct("item", "side", "across", "label")).alias("items"))
    rows = _rows(docs).join(shuffled(wanted), "doc_id").select("doc_id", "items", "b")

    def to_sets(batches):
        memo: dict = {}
        for batch, values in slices(batches, "b", 1 << 20):
            sets = pa.array([s.tobytes() for s in shingle_sets(values, words, memo)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], sets], names=["doc_id", "items", "s"])

    sets = rows.mapInArrow(to_sets, f"doc_id {kind}, items {wanted.schema['items'].dataType.simpleString()}, s binary")
    item = sets.select("doc_id", "s", F.explode("items").alias("i")).select("i.item", "i.side", "doc_id", "i.across", "i.label", "s")

    def compare(batches):
        held: list = []

        def close():
            low = sum(r[1] == 0 for r in held) if held[0][3] else 0  # they come first
            found = [] if held[0][3] and low in (0, len(held)) else links([np.frombuffer(r[5], np.uint64) for r in held], low, percent, [r[4] for r in held])
            return pa.RecordBatch.from_arrays([pa.array([held[p[k]][2] for p in found], id_type) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            id_type = batch.schema.field(2).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    return item.repartition("item").sortWithinPartitions("item", "side", "doc_id").mapInArrow(compare, f"u {kind}, v {kind}")


def shares() -> Column:
    """Parts of a group of members, by their number and by the sum of their set sizes n."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")


def alike(a: str, b: str, percent: int):
    """Set sizes that allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def star_members(buckets: DataFrame, percent: int) -> DataFrame:
    """Members of comparisons with a bucket's first document: shares of about BLOCK others (fewer where sets are large), each with it on the other side."""
    edges = buckets.where("doc_id <> first.doc_id").where(alike("n", "first.n", percent)).select(F.col("first.doc_id").alias("u"), "doc_id", "n").distinct()
    size = edges.groupBy("u").agg(shares().alias("shares"))
    many = edges.join(shuffled(size), "u").withColumn("share", F.pmod(F.xxhash64("doc_id"), "shares"))
    key = F.xxhash64("u", "share", F.lit("star"))
    others = many.select("doc_id", key.alias("item"), F.lit(1).alias("side"), "u")
    own = many.select("u", "share").distinct().select(F.col("u").alias("doc_id"), key.alias("item"), F.lit(0).alias("side"), "u")
    both = own.union(others)
    return both.select("doc_id", "item", "side", F.lit(True).alias("across"), F.col("doc_id").alias("label"))


def open_members(buckets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Members of the comparisons inside buckets that hold several components."""
    lab = buckets.join(shuffled(labels.select(F.col("node").alias("doc_id"), "label")), "doc_id", "left").select("band", "h", "doc_id", "n", F.coalesce("label", "doc_id").alias("label"))
    lab = Table(lab, "labelled").df
    total = lambda seed: F.sum(F.xxhash64("doc_id", F.lit(seed)).cast("decimal(38,0)"))
    each = lab.groupBy("band", "h").agg(F.count(F.lit(1)).alias("m"), total(1).alias("sum1"), total(2).alias("sum2"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2")
    # one bucket for each set of members, told by two sums of 64-bit hashes
    each = each.groupBy("m", "sum1", "sum2").agg(F.min(F.struct("band", "h")).alias("k")).select("k.band", "k.h", "m")
    rows = lab.join(shuffled(each), ["band", "h"]).withColumn("g", F.xxhash64("band", "h"))
    # sizes of one class differ by less than the threshold's ratio, so pairs above it are of one class or of neighbours
    rows = rows.withColumn("class", F.when(F.col("m") > BLOCK, F.floor(F.log("n") / F.log(F.lit(100.0 / percent)))).otherwise(F.lit(0)).cast("int"))
    rows = Table(rows, "open").df
    blocks = Table(rows.groupBy("g", "class").agg(shares().alias("blocks")), "blocks").df  # a large bucket's partition can be split
    near = lambda k: blocks.select("g", (F.col("class") - k).alias("class"), F.col("blocks").alias(f"next{k}".replace("-", "_")))
    r = rows.join(shuffled(blocks), ["g", "class"]).join(shuffled(near(1)), ["g", "class"], "left").join(shuffled(near(-1)), ["g", "class"], "left")
    r = r.withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    c, own = F.col("class"), F.col("own")
    item = lambda c1, b1, c2, b2: F.xxhash64("g", c1, b1, c2, b2)
    some = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    entry = lambda key, side, across: F.struct(key.alias("item"), side.cast("int").alias("side"), across.alias("across"))
    same = F.transform(some("blocks"), lambda o: entry(item(c, F.least(own, o), c, F.greatest(own, o)), F.when(own <= o, 0).otherwise(1), own != o))
    above = F.transform(some("next1"), lambda o: entry(item(c, own, c + 1, o), F.lit(0), F.lit(True)))
    below = F.transform(some("next_1"), lambda o: entry(item(c - 1, o, c, own), F.lit(1), F.lit(True)))
    return r.select("doc_id", "label", F.explode(F.concat(same, above, below)).alias("i")).select("doc_id", "i.item", "i.side", "i.across", "label")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    base = materialize(sketched(docs, words), "sketched")
    filled = base.where("n > 0 AND doc_id IS NOT NULL")
    reps = materialize(filled.groupBy("e1", "e2", "n").agg(F.min("doc_id").alias("rep")), "reps")
    vertex = filled.join(shuffled(reps.select(F.col("rep").alias("doc_id"), "e1", "e2").distinct()), ["doc_id", "e1", "e2"], "left_semi")
    banded = vertex.select("doc_id", "n", F.posexplode("bands").alias("band", "h"))
    leaders = banded.groupBy("band", "h").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.max("doc_id").alias("x")).where("first.doc_id <> x").drop("x")
    buckets = Table(banded.join(shuffled(leaders), ["band", "h"]), "buckets")
    stars = Table(star_members(buckets.df, percent), "stars")
    near = Table(compared(docs, stars.df, words, percent), "links")
    stars.free()
    labels = components(near.df)
    more = Table(open_members(buckets.df, labels.df, percent), "open")
    buckets.free()
    rest = Table(compared(docs, more.df, words, percent), "links")
    for t in (more, labels):
        t.free()
    # texts of one doc_id are one node, whatever other documents stand for their sets
    ids = filled.join(shuffled(reps), ["e1", "e2", "n"]).groupBy("doc_id").agg(F.min("rep").alias("u"), F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    same = ids.select("u", F.explode("reps").alias("v"))
    linked = components(near.df.union(rest.df).union(same)).df
    near.free()
    rest.free()
    own = base.join(shuffled(reps), ["e1", "e2", "n"], "left")
    done = own.join(shuffled(linked.select(F.col("node").alias("rep"), "label")), "rep", "left")
    done = done.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "doc_id").alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component, with all their columns; rows that share a doc_id stay or go together.

    Documents without words stay. Texts aren't shuffled for it but by the join with the ids that go.
    """
    key = unused(docs, "key")
    gone = materialize(near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(shuffled(gone), F.col("doc_id") == F.col(key), "left_anti")
