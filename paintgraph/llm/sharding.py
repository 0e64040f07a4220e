"""Sharding by fixed virtual slots.

Rows hash into `n_slots` slots by doc_id and text; the bytes of each slot are summed over all rows; a stored, versioned
map gives each slot its shard. Version 0 deals slots round; each rebalancing loads the map, edits its newest version
by moving slots from the heaviest shard to the lightest while that evens them out, and appends the next version, so
that older assignments stay readable. The map holds n_slots rows a version, so the driver edits it; the rows
themselves meet it by a broadcast of that fixed size.

Contract. A null text has size 1 and crc32 of the empty text. Rows with one doc_id and text fall into one slot;
rows that share only a doc_id don't. A null doc_id hashes like any value. Texts of any length are handled whole; a slot
is as heavy as its heaviest text at least, so a text above a shard's share can't be evened out. Empty table: empty
result, and a map of empty slots. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

N_SLOTS, N_SHARDS = 4096, 16
MAP = "version int, vslot int, shard int, bytes long, n_rows long"


def slot_of(n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(n_slots)).cast("int")


def slot_sizes(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """vslot, bytes, n_rows: n_slots rows at most; sums are made before the shuffle."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def first_map(n_slots: int, n_shards: int) -> list[int]:
    return [s % n_shards for s in range(n_slots)]


def rebalance(shards: list[int], sizes: list[int], n_shards: int) -> list[int]:
    """The next version: slots move, largest useful one first, from the heaviest shard to the lightest."""
    shards, load = list(shards), [0] * n_shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for s, (h, b) in enumerate(zip(shards, sizes, strict=True)):
        load[h] += b
        own[h].append((b, s))
    for _ in range(4 * len(shards)):
        high, low = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[high] - load[low]
        # a move of b changes the gap to |gap - 2 b|; without such a slot, swap two of a useful difference
        move = max((x for x in own[high] if 0 < x[0] < gap), key=lambda x: (-abs(gap - 2 * x[0]), -x[1]), default=None)
        best, swap = (abs(gap - 2 * move[0]) if move else gap), None
        few = sorted(own[low])
        for b, s in own[high]:
            for c, t in few:
                if 0 < b - c < gap and abs(gap - 2 * (b - c)) < best:
                    best, swap = abs(gap - 2 * (b - c)), ((b, s), (c, t))
            if best <= max(1, gap // 50):
                break
        if best >= gap or gap <= max(1, sum(load) // n_shards // 10_000):
            break
        gone, back = swap or (move, None)
        own[high].remove(gone)
        own[low].append(gone)
        shards[gone[1]] = low
        if back:
            own[low].remove(back)
            own[high].append(back)
            shards[back[1]] = high
        change = gone[0] - (back[0] if back else 0)
        load[high] -= change
        load[low] += change
    return shards


def _rows(spark: SparkSession, version: int, shards: list[int], amounts: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(version, s, shards[s], *amounts[s]) for s in range(len(shards))], MAP)


def _amounts(sizes: DataFrame, n_slots: int) -> list[tuple[int, int]]:
    got = {r["vslot"]: (r["bytes"], r["n_rows"]) for r in sizes.collect()}  # n_slots rows at most
    return [got.get(s, (0, 0)) for s in range(n_slots)]


def new_map(sizes: DataFrame, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 0 of a map: slots as dealt round, with the bytes and rows that they hold."""
    return _rows(sizes.sparkSession, 0, first_map(n_slots, n_shards), _amounts(sizes, n_slots))


def edited(stored: DataFrame, sizes: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The next version of a stored map: its newest one, edited for what the slots hold now."""
    newest = newest_of(stored).orderBy("vslot").collect()  # n_slots rows
    amounts = _amounts(sizes, len(newest))
    return _rows(stored.sparkSession, newest[0]["version"] + 1, rebalance([r["shard"] for r in newest], [a[0] for a in amounts], n_shards), amounts)


def newest_of(stored: DataFrame) -> DataFrame:
    last = stored.agg(F.max("version").alias("version"))
    return stored.join(F.broadcast(last), "version", "left_semi")  # one row


def save(version: DataFrame, path: str) -> None:
    """Appends a version to the stored map; a version that is there already is never written again."""
    version.write.mode("append").partitionBy("version").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAP).parquet(path)


def sized(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(n_slots).alias("vslot"))


def place(rows: DataFrame, version: DataFrame) -> DataFrame:
    """Each row's shard by one version of the map, and its place there, gapless from 0.

    A slot's first place follows the slots before it in its shard (n_slots rows); inside a slot rows are numbered by a
    window over the slot, so no task ever holds a shard.
    """
    first = F.sum("n_rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    known = version.select("vslot", "shard", F.coalesce(first, F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("n", within).join(F.broadcast(known), "vslot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("n")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")


def assign(docs: DataFrame, path: str | None = None, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> tuple[DataFrame, DataFrame]:
    """Each row's shard and place by a rebalanced map, and all versions of it.

    With a path, the map stored there is loaded, edited and stored with one version more; where there is none yet,
    version 0 is stored first. Without a path the map lives in a scratch table.
    """
    spark = docs.sparkSession
    rows = materialize(sized(docs, n_slots), "sized")
    sizes = slot_sizes(rows, n_slots)
    if path is None:
        first = new_map(sizes, n_slots, n_shards)
        stored = materialize(first.union(edited(first, sizes, n_shards)), "slotmap")
    else:
        try:
            known = load(spark, path).limit(1).count()
        except Exception as e:  # Spark's own error class for a path that isn't there
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = 0
        if not known:
            save(new_map(sizes, n_slots, n_shards), path)
        save(edited(load(spark, path), sizes, n_shards), path)
        stored = load(spark, path)
    return place(rows, newest_of(stored)), stored
