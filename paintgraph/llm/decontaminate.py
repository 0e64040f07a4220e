"""Benchmark decontamination with training suffix arrays.

Documents are cut into shards of a few MB. A shard's word positions are sorted by the words that follow, as far as the
longest item goes (words that the benchmark lacks end a suffix). Every suffix of every item is looked up by binary
search: the rows that share its first `window` words (the whole item, if it is shorter) are its verbatim matches, which
are then followed to their full length. What is kept are the matches that can't begin a word earlier: item, place in
it, place in the document, length.

The benchmark is dealt into blocks of about `block_bytes`; a block is what a task holds. One block is broadcast, its size
being checked. Several blocks are never broadcast: in one pass over the corpus each document's windows are held
against a filter of the benchmark's windows, of FILTER_BITS bits at most, and those that pass meet the benchmark's
windows by hash in a join, which gives the blocks that a document has to be searched for. The hashes only choose blocks;
the same search decides. Documents of a block are dealt to shares, so no task gathers them.

Contract. Null texts have no words; an item without words matches nothing, one of fewer than `window` words is one
window. Repeated documents are judged alike; repeated items (same id) count once; null item ids are left out of
the list. Texts of any length are handled whole: a shard grows to the largest text, whose arrays take about 100 bytes a
word. Empty tables give no hits. The other columns take no part; `remove_contaminated` returns them untouched, whatever
their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Table
from .common import fmix, keyed, materialize, row_key, same_row, shuffled, slices, unused, word_hashes
from .repeats import Rolling

WINDOW = 10
#: Bytes of benchmark text in a block, about, and bits of the filter.
BLOCK_BYTES, FILTER_BITS = 2 << 20, 1 << 26
#: Bytes of documents that are searched at once, about.
SHARD = 8 << 20
MATCHES = "array<struct<item:string,item_place:int,place:int,length:int>>"
_word = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(b: bytes) -> list[bytes]:
    return _word.findall(b.lower())  # bytes.lower() changes A-Z alone


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.zeros(0, "S4")


class Block:
    """Items as one array of word numbers (0 between them), and all suffixes that a match may begin with."""

    def __init__(self, items: list[tuple], window: int):
        self.window, self.vocabulary, self.names = window, {}, []
        ids, item, first, need = [0], [-1], [0], [0]
        starts = []
        for name, text in items:
            words = words_of(text or b"")
            if not words:
                continue
            size, at = min(window, len(words)), len(ids)
            starts += range(at, at + len(words) - size + 1)
            ids += [*(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), 0]
            item += [len(self.names)] * (len(words) + 1)
            first += [at] * (len(words) + 1)
            need += [size] * (len(words) + 1)
            self.names.append(name)
        self.ids, self.item, self.first, need = (np.array(x, np.int64) for x in (ids, item, first, need))
        self.starts = np.array(starts, np.int64)
        self.need = need[self.starts]
        self.shortest = int(self.need.min()) if len(self.starts) else window
        self.longest = int(np.diff(np.flatnonzero(self.ids == 0)).max(initial=1)) - 1

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys between which the suffixes of a shard lie that begin with the words that each item suffix needs."""
        rows = np.concatenate((self.ids, np.zeros(self.window, np.int64)))[self.starts[:, None] + np.arange(self.window)]
        beyond = np.arange(self.window) >= self.need[:, None]
        return as_keys(np.where(beyond, 0, rows)), as_keys(np.where(beyond, 0xFFFFFFFF, rows))


class SuffixArray:
    """Of one shard: the positions that could match, sorted by the words that follow up to the next unknown one.

    The first `window` words are sorted at once; groups that still agree are sorted by the next ones, and so on to the
    longest item's length.
    """

    def __init__(self, ids: np.ndarray, window: int, shortest: int, longest: int):
        n = len(ids)
        stops = np.flatnonzero(ids == 0)  # unknown words and the ends of documents
        known = np.append(stops, n)[np.searchsorted(stops, np.arange(n))] - np.arange(n)
        self.places = np.flatnonzero(known >= shortest)
        wide = np.concatenate((ids, np.zeros(window, ids.dtype)))

        def key(places: np.ndarray, depth: int) -> np.ndarray:
            reach = np.minimum(places + depth, n)
            rows = wide[reach[:, None] + np.arange(window)]
            rows[np.arange(window) >= (known[places] - depth)[:, None]] = 0
            return as_keys(rows)

        keys = key(self.places, 0)
        order = np.argsort(keys, kind="stable")
        self.places, self.keys = self.places[order], keys[order]
        new = np.concatenate(([True], self.keys[1:] != self.keys[:-1])) if len(order) else np.zeros(0, bool)
        depth = window
        while depth < longest and len(new):
            group = np.cumsum(new)
            size = np.bincount(group)[group]
            at = np.flatnonzero((size > 1) & (known[self.places] > depth - window))  # ties that go on
            if not len(at):
                break
            more = key(self.places[at], depth)
            by = np.lexsort((more, group[at]))
            self.places[at], more, own = self.places[at][by], more[by], group[at][by]
            new[at] |= np.concatenate(([True], (more[1:] != more[:-1]) | (own[1:] != own[:-1])))
            depth += window

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")


def longest_matches(block: Block, low: np.ndarray, high: np.ndarray, split: list[list[bytes]]) -> list[list[tuple]]:
    """For each document (words): its matches, as (item number, place in the item, place, length)."""
    vocabulary = block.vocabulary.get
    ends = np.cumsum([len(w) + 1 for w in split])
    ids = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)  # a 0 before the first document and after each
    for w, e in zip(split, ends, strict=True):
        ids[e - len(w) : e] = [vocabulary(x, 0) for x in w]
    found: list[list[tuple]] = [[] for _ in split]
    if not len(low):
        return found
    array = SuffixArray(ids, block.window, block.shortest, block.longest)
    lo, hi = array.find(low, high)
    count = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(lo)), count)
    p = array.places[np.repeat(lo, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
    i = block.starts[which]
    earlier = (block.ids[i - 1] == ids[p - 1]) & (ids[p - 1] > 0)  # then the match begins a word before
    i, p, length = i[~earlier], p[~earlier], block.need[which][~earlier]
    going = np.arange(len(i))
    while len(going):
        a, b = block.ids[i[going] + length[going]], ids[np.minimum(p[going] + length[going], len(ids) - 1)]
        going = going[(a == b) & (a > 0)]
        length[going] += 1
    document = np.searchsorted(ends, p, "left")
    starts = np.concatenate(([1], ends[:-1] + 1)) if len(ends) else ends
    for d, k, at, place, size in zip(document.tolist(), block.item[i].tolist(), (i - block.first[i]).tolist(), (p - starts[document]).tolist(), length.tolist(), strict=True):
        found[d].append((k, at, place, size))
    return found


def _searched(block: Block, batch: pa.RecordBatch, texts: list, bounds: tuple) -> pa.RecordBatch:
    split = [words_of(t) for t in texts]
    rows = [[{"item": block.names[k], "item_place": a, "place": p, "length": n} for k, a, p, n in sorted(own)] for own in longest_matches(block, *bounds, split)]
    kind = pa.list_(pa.struct([("item", pa.string()), ("item_place", pa.int32()), ("place", pa.int32()), ("length", pa.int32())]))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in split], pa.int64()), pa.array(rows, kind)], names=["doc_id", "k", "n_words", "matches"])


def _schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k long, n_words long, matches {MATCHES}"


def search_block(docs: DataFrame, items: list[tuple], window: int) -> DataFrame:
    """doc_id, k, n_words, matches of every row, for items that fit one block."""
    shared = docs.sparkSession.sparkContext.broadcast(Block(items, window))

    def run(batches):
        block = shared.value
        bounds = block.bounds()
        for batch, texts in slices(batches, "b", SHARD):
            yield _searched(block, batch, texts, bounds)

    return keyed(docs).mapInArrow(run, _schema(docs))


def window_hashes(words: list[bytes], sizes: list[int], memo: dict) -> np.ndarray:
    """Hashes of all windows of the given sizes."""
    h = word_hashes(words, memo)
    r, out = Rolling(h), []
    for size in sizes:
        at = np.arange(len(h) - size + 1)
        if len(at):
            out.append(fmix(r.of(at, at + size) + np.uint64(size)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def search_blocks(docs: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """The same for a benchmark of any size: documents meet only the blocks that they share a window's hash with."""
    spark = docs.sparkSession
    items = Table(items.withColumn("block", F.pmod(F.xxhash64("item", "t"), F.lit(blocks)).cast("int")), "items").df

    def item_windows(batches):
        memo: dict = {}
        for batch, values in slices(batches, "t", 1 << 20):
            hs, sizes, own = [], [], []
            for block, t in zip(batch.column(1).to_pylist(), values, strict=True):
                words = words_of(t)
                if words:
                    h = window_hashes(words, [min(window, len(words))], memo)
                    hs += h.view(np.int64).tolist()
                    sizes += [min(window, len(words))] * len(h)
                    own += [block] * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(own, pa.int32())], names=["h", "size", "block"])

    windows = Table(items.select("t", "block").mapInArrow(item_windows, "h long, size int, block int").distinct(), "windows").df
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `window` numbers
    words_at = F.shiftrightunsigned(F.pmod("h", F.lit(FILTER_BITS)), 6)
    bit = F.expr("shiftleft(1L, CAST(pmod(h, 64) AS INT))")
    words_set = windows.groupBy(words_at.alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words_set["w"].to_numpy(np.int64)] = words_set["bits"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)

    def doc_windows(batches):
        memo: dict = {}
        for batch, texts in slices(batches, "b", 4 << 20):
            counts, hits = [], []
            for t in texts:
                words = words_of(t)
                h = window_hashes(words, sizes, memo)
                at = (h.view(np.int64) % FILTER_BITS).astype(np.int64)
                hits.append(h[(shared.value[at >> 6] >> (h % np.uint64(64))) & np.uint64(1) > 0].view(np.int64))
                counts.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64()))], names=["doc_id", "k", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs)
    base = Table(rows.mapInArrow(doc_windows, f"doc_id {kind}, k long, n_words long, hits array<bigint>"), "hits").df
    wanted = base.select("doc_id", "k", F.explode("hits").alias("h")).join(shuffled(windows.select("h", "block")), "h").groupBy("doc_id", "k").agg(F.collect_set("block").alias("blocks"))
    found = rows.join(shuffled(wanted), same_row(rows, wanted)).select(rows["doc_id"], rows["k"], "b", F.explode("blocks").alias("block"))
    found = Table(found.withColumn("share", F.pmod("k", F.greatest(F.lit(1), F.lit(spark.sparkContext.defaultParallelism))).cast("int")), "found").df
    # a share's group begins with its block's items
    shares = found.select("block", "share").distinct()
    heads = items.join(shuffled(shares), "block").select(F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("k"), F.col("t").alias("b"), "block", "share", F.lit(0).alias("kind"), "item")
    both = heads.union(found.select("doc_id", "k", "b", "block", "share", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("item")))

    def run(batches):
        held, key, block, bounds = [], None, None, None
        for batch, texts in slices(batches, "b", SHARD):
            blocks_, shares_, kinds, names = (batch.column(i).to_pylist() for i in (3, 4, 5, 6))
            start = 0
            for i in range(len(texts) + 1):
                end = i == len(texts)
                if end or kinds[i] == 0 or (blocks_[i], shares_[i]) != key:
                    if start < i:
                        yield _searched(block, batch.slice(start, i - start), texts[start:i], bounds)
                    start = i
                if end:
                    break
                if (blocks_[i], shares_[i]) != key:
                    key, held = (blocks_[i], shares_[i]), []
                if kinds[i] == 0:
                    held.append((names[i], texts[i]))
                    block, start = None, i + 1
                elif block is None:
                    block = Block(held, window)
                    bounds = block.bounds()

    parts = both.repartition("block", "share").sortWithinPartitions("block", "share", "kind").mapInArrow(run, _schema(docs))
    parts = parts.groupBy("doc_id", "k").agg(F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
    done = base.join(shuffled(parts), same_row(base, parts), "left")
    return done.select(base["doc_id"], base["k"], "n_words", F.coalesce("matches", F.array().cast(MATCHES)).alias("matches"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, k, n_words, matches, spans of hit words (maximal runs), items (ids as strings, sorted), contaminated."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    if blocks == 1:
        m = search_block(docs, [(r["item"], bytes(r["t"])) for r in items.collect()], window)  # block_bytes at most
    else:
        m = search_blocks(docs, items, blocks, window)
    hit = F.array_sort(F.transform("matches", lambda x: F.struct(x["place"].alias("start"), (x["place"] + x["length"]).alias("stop"))))
    named = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda x: x["item"]), lambda x: x.isNotNull())))
    return m.select("doc_id", "k", "n_words", "matches", hit.alias("spans"), named.alias("items"), (F.size("matches") > 0).alias("contaminated"))


def n_hit(spans: str):
    """Words covered by sorted spans, overlaps counted once."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["stop"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns, and each document's longest match: its words, its place, the item and the place there."""
    c = contamination(docs, benchmark)
    best = F.array_max(F.transform("matches", lambda x: F.struct(x["length"].alias("length"), (-x["place"]).alias("p"), x["item"].alias("item"), x["item_place"].alias("item_place"))))
    return c.select("doc_id", "n_words", n_hit("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.coalesce(best["length"], F.lit(0)).cast("long").alias("longest"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns."""
    row, key, i = unused(docs, "row"), unused(docs, "key"), unused(docs, "id")
    bad = materialize(contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(i), F.col("k").alias(key)).distinct(), "contaminated")
    d = docs.withColumn(row, row_key())
    return d.join(shuffled(bad), (F.col(row) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(i)), "left_anti").drop(row)
