"""SimHash near-dedup with deletion-variant signatures.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 hashes of the document's word shingles,
repeats included. Two fingerprints link at 3 or fewer differing bits. Cut into two segments, a linked pair differs by at
most one bit in one of them, so it shares a signature of that segment with one bit deleted: 2 x 32 signatures a
fingerprint. They are joined on equality and verified by a count of bits, all in Spark's own columns.

Copies cost nothing: distinct fingerprints are the vertices. Signatures shared by few hold random meetings and are joined
as they are; those of a family hold thousands. So each signature's members are first held against its smallest one,
which is linear and makes most families one component. Only signatures that still hold several components stay open.
An open signature of over MOST members is cut again: what its key leaves open is parted in two pieces, of which a linked
pair again differs by at most one bit in one, and so on. After four cuts a key fixes all but 8 bits, so at most 256
distinct fingerprints share it: no group grows with the corpus, no pair is lost, and no bucket is capped.

Contract. Null texts and texts without words have fingerprint 0, linked like any other; fewer words than a shingle are
one shingle. Rows of one doc_id are one node, whatever their texts. A null doc_id can't be named: its row keeps its
fingerprint and is linked with nothing (component_id null). Repeated rows and texts link. Texts of any length are read
whole, in bounded blocks. Empty table: empty result. Other columns take no part; `dedup_documents` returns them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Table, components
from .common import materialize, shuffled, slices, unused

WORDS, SEED, DISTANCE, MOST, BLOCK = 3, 42, 3, 256, 1 << 16
#: Bits that each cut halves: 64 into 2 x 32, the other 32 into 2 x 16 and so on.
CUTS = (32, 16, 8, 4)


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED):
    """XXH64 of each shingle of a text, in blocks of at most BLOCK."""
    import xxhash

    own = text.lower().split()  # of bytes: A-Z alone, and the six white spaces of ASCII
    size = min(words, len(own))
    if not size:
        return
    joined, digest = b" ".join(own), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    for at in range(0, len(own) - size + 1, BLOCK):
        to = min(at + BLOCK, len(own) - size + 1)
        yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)), np.uint64, to - at)


def fingerprints(texts: list[bytes], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Signed 64-bit fingerprints of texts."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, owners, count = [], [], 0

    def add():
        h, owner = np.concatenate(held), np.concatenate(owners)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        ones[owner[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)

    for i, text in enumerate(texts):
        for h in shingle_hashes(text, words, seed):
            total[i] += len(h)
            held.append(h)
            owners.append(np.full(len(h), i))
            count += len(h)
            if count >= BLOCK:
                add()
                held, owners, count = [], [], 0
    if held:
        add()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<i8")[:, 0]


def signed(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, f (fingerprint as a signed long); no shuffle."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))

    def run(batches):
        for batch, values in slices(batches, "b", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(values, words, seed), pa.int64())], names=["doc_id", "f"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f long")


def cut(members: DataFrame, width: int) -> DataFrame:
    """f, fixed, low, k: each member once for each signature of a cut. Its open bits are the 2 * width ones from `low` on (and
    single bits left free before); one half of them is fixed but for one bit, and the other half stays open."""
    ways = []
    for half in (0, width):
        for free in range(half, half + width):
            bits = ((1 << width) - 1 << half) & ~(1 << free)
            ways.append(F.struct(F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long").alias("bits"), F.lit(width - half).alias("on")))
    kept = [c for c in members.columns if c not in ("fixed", "low", "k")]
    m = members.select("*", F.explode(F.array(*ways)).alias("way"))
    m = m.select(*kept, F.col("fixed").bitwiseOR(F.call_function("shiftleft", F.col("way.bits"), F.col("low"))).alias("fixed"), (F.col("low") + F.col("way.on")).alias("low"))
    # a signature is named by a hash: a clash adds candidates, which are verified, and loses none
    return m.withColumn("k", F.xxhash64("fixed", F.col("fixed").bitwiseAND(F.col("f"))))


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def paired(members: DataFrame) -> DataFrame:
    """u, v: verified pairs of one signature and different components; k is shared by at most MOST."""
    a, b = (members.select("k", F.col("f").alias(x), F.col("label").alias(f"of_{x}")) for x in "uv")
    return a.join(shuffled(b), (a["k"] == b["k"]) & (F.col("u") < F.col("v")) & (F.col("of_u") != F.col("of_v")) & near(F.col("u"), F.col("v"))).select("u", "v").distinct()


def open_links(members: DataFrame) -> list[Table]:
    """Links u, v between the components that signatures still hold apart. members: f, label, fixed, low, k of the first cut."""
    found: list[Table] = []
    for width in CUTS[1:] + (0,):
        size = members.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("k", "m")
        sizes = Table(size, "sizes")
        here = Table(members.join(shuffled(sizes.df), "k"), "open")
        sizes.free()
        if width:
            found.append(Table(paired(here.df.where(F.col("m") <= MOST)), "pairs"))
            rest = here.df.where(F.col("m") > MOST).drop("m")
        else:  # all bits but 8 are fixed, so at most 256 members are left
            found.append(Table(paired(here.df), "pairs"))
            break
        if rest.isEmpty():
            break
        members = cut(rest, width)
    return found


def links(prints: DataFrame) -> list[Table]:
    """Written tables of links u, v that join all fingerprints (f, distinct) which a chain of near ones joins."""
    first = lambda: cut(prints.select("f", F.lit(0).cast("long").alias("fixed"), F.lit(0).alias("low")), CUTS[0])
    leaders = Table(first().groupBy("k").agg(F.min("f").alias("first"), F.max("f").alias("last")).where("first <> last").select("k", "first"), "leaders")
    shared = Table(first().join(shuffled(leaders.df), "k"), "shared")
    leaders.free()
    stars = Table(shared.df.where(near(F.col("f"), F.col("first")) & (F.col("f") != F.col("first"))).select(F.col("first").alias("u"), F.col("f").alias("v")).distinct(), "stars")
    labels = components(stars.df)
    lab = shared.df.drop("first").join(shuffled(labels.df.withColumnRenamed("node", "f")), "f", "left").withColumn("label", F.coalesce("label", "f"))
    held = Table(lab, "held")
    for t in (shared, labels):
        t.free()
    found = open_links(held.df)
    held.free()
    return [stars, *found]


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id, kept: one row for each row of docs."""
    base = materialize(signed(docs, words, seed), "signed")
    named = base.where("doc_id IS NOT NULL")
    prints = Table(named.groupBy("f").agg(F.min("doc_id").alias("rep")), "prints")
    # texts of one doc_id are one node: its fingerprints hang together
    several = Table(named.groupBy("doc_id").agg(F.min("f").alias("u"), F.max("f").alias("v")).where("u <> v").select("doc_id", "u"), "several")
    found = links(prints.df)
    edges = named.join(shuffled(several.df), "doc_id").select("u", F.col("f").alias("v")).where("u <> v").distinct()
    for t in found:
        edges = edges.union(t.df)
    linked = components(edges)
    for t in (several, *found):
        t.free()
    own = prints.df.join(shuffled(linked.df.withColumnRenamed("node", "f")), "f", "left").select("f", "rep", F.coalesce("label", "f").alias("label"))
    own = Table(own, "labelled")
    least = Table(own.df.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    placed = Table(own.df.join(shuffled(least.df), "label").select("f", "component_id"), "placed")
    for t in (prints, linked, own, least):
        t.free()
    done = base.join(shuffled(placed.df), "f", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    digits = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return done.select("doc_id", digits.alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup_documents(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """The documents that stay, one doc_id of each component, with all their columns; rows without a doc_id stay."""
    key = unused(docs, "key")
    gone = materialize(near_duplicates(docs, words, seed).where("NOT kept").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(shuffled(gone), F.col("doc_id") == F.col(key), "left_anti")
