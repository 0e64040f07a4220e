"""Importance resampling towards a target distribution, with a vectorised byte automaton over Arrow buffers.

Features are runs of 1 to `longest` consecutive words, joined by one space; a feature's bucket is the CRC-32 of its bytes
modulo `buckets`. Bucket counts of the corpus and of the target give each bucket a gain, a document's weight is the sum
of its features' gains, and weight plus Gumbel noise named by the seed and the doc_id is its score: the highest scores
are a sample without replacement in proportion to exp(weight / 1000).

The automaton never makes a Python string. A table of 256 classes marks the bytes of words in the buffer of a whole
batch, differences of that mark (and the borders of documents) are the words' ends, and the CRCs of all features advance
together, a byte a step, through the usual table of 256 remainders; features that have ended drop out. What is left of a
feature after STEPS bytes goes through zlib, which continues the same CRC, so one very long word costs no step a byte.

Scale. Two scans of the texts and no shuffle of them. Counts leave a task as at most `buckets` rows; the gains, `buckets`
numbers, are the only thing the driver holds. Scores (about 40 bytes a document) are written, dealt by range of
(score, doc_id), numbered within ranges, and the ranges' sizes give the ranks: no task sorts everything.

Contract. Null and empty texts have no features: weight 0, a score of noise alone, never drawn if `least` is over 0.
Repeated rows are scored, counted and drawn one by one; rows alike in score and doc_id go by n_features. A null doc_id is
hashed as an empty one and comes last among ties. Empty target: its counts are 0. Empty table: empty result. Other
columns take no part, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BUCKETS, LEAST, PERCENT, SEED, STEPS, SLICE = 10_000, 20, 10, 2024, 64, 4 << 20
#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-casing of A-Z alone, classes (word bytes are digits, letters and all from 0x80 on), CRC remainders."""
    code = np.arange(256, dtype=np.uint8)
    low = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint8)
    word = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1).astype(np.uint32)
    return low, word, crc


LOW, WORD_BYTE, REMAINDERS = _tables()


def words_in(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer, and how many each text (bounds[i] to bounds[i + 1]) has."""
    mark = np.zeros(len(data) + 2, np.int8)
    mark[1:-1] = WORD_BYTE[data]
    step = np.diff(mark)
    inner = bounds[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    touch = inner[(mark[inner] == 1) & (mark[inner + 1] == 1)]  # two texts' words meet there
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(touch):
        starts, ends = np.sort(np.concatenate([starts, touch])), np.sort(np.concatenate([ends, touch]))
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice of the buffer, all of them a byte further at each step."""
    order = np.argsort(-sizes, kind="stable")
    at, size = starts[order], sizes[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = len(order)
    for j in range(min(STEPS, int(size[0]) if len(size) else 0)):
        live = int(np.searchsorted(-size[:live], -j, side="left"))  # those longer than j come first
        now = state[:live]
        state[:live] = REMAINDERS[(now ^ data[at[:live] + j]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -STEPS, side="left"))):
        state[i] = zlib.crc32(data[at[i] + STEPS : at[i] + size[i]].tobytes(), int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, bounds: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature of a buffer of texts, the text it stands in, and the number of words of each text."""
    starts, ends, n = words_in(data, bounds)
    data, sizes = LOW[data], ends - starts
    owner = np.repeat(np.arange(len(n)), n)
    if longest > 1:  # words with one space between them, so that a run of words is a slice too
        word = np.repeat(np.arange(len(starts)), sizes)
        joined = np.full(int(sizes.sum()) + len(starts), 32, np.uint8)
        joined[np.arange(len(word)) + word] = data[np.arange(len(word)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)]
        starts = np.cumsum(sizes + 1) - sizes - 1
        data, ends = joined, starts + sizes
    found, owners = [], []
    for k in range(longest):
        first = np.flatnonzero(owner[: len(owner) - k] == owner[k:])  # the run's last word is of the same text
        found.append(crcs(data, starts[first], ends[first + k] - starts[first]) % np.uint32(buckets))
        owners.append(owner[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), n


def _buffers(batch: pa.RecordBatch, column: str):
    """Runs of rows with about SLICE bytes of text: rows, the UTF-8 buffer's bytes and the texts' bounds in it."""
    values = batch.column(batch.schema.get_field_index(column))
    if not len(values):
        return
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    offsets = np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        to = min(to, len(values))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text"), F.lit("")).alias("t"))


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts. A task gives one row for each bucket it met."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, bounds in _buffers(batch, "t"):
                total += np.bincount(features(data, bounds, longest, buckets)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return _texts(docs).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket."""
    s, t = (bucket_counts(x, longest, buckets).withColumnRenamed("n", n) for x, n in ((docs, "s"), (target, "t")))
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    out = np.zeros((3, buckets))
    for r in both.collect():  # `buckets` rows
        out[:, r.bucket] = r.s, r.t, 0
    s, t, _ = out
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = SEED, keys: dict | None = None) -> DataFrame:
    """doc_id, the columns `keys`, n_words, n_features, weight, score; no shuffle."""
    keys = keys or {}
    rows = docs.select("doc_id", *[c.alias(k) for k, c in keys.items()], F.coalesce(F.col("text"), F.lit("")).alias("t"))
    kept = rows.schema[:-1]

    def weigh(batches):
        for batch in batches:
            for own, data, bounds in _buffers(batch, "t"):
                bucket, owner, words = features(data, bounds, longest, len(gain))
                weight = np.zeros(len(words), np.int64)
                np.add.at(weight, owner, gain[bucket])
                count = np.bincount(owner, minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(words.astype(np.int64)), pa.array(count), pa.array(weight)], names=[*own.schema.names[:-1], "n_words", "n_features", "weight"])

    done = rows.mapInArrow(weigh, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return done.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def ranked(rows: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """Adds `rank` to a written table of scores: 1, 2, 3 and so on for the drawn ones, null for the others."""
    spark = rows.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.where(F.col("n_words") >= least).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(np.arange(seen + 1, seen + n + 1))], names=[*batch.schema.names, "part", "i"])
            seen += n

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = materialize(dealt.mapInArrow(number, f"{columns}, part long, i long"), "placed")
    sizes = placed.groupBy("part").agg(F.max("i").alias("n")).orderBy("part").collect()  # a row for each partition of the shuffle
    before, total = [], 0
    for r in sizes:
        before.append((r.part, total))
        total += r.n
    drawn = percent * total // 100
    places = spark.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("i")
    numbered = placed.join(F.broadcast(places), "part").withColumn("rank", F.when(rank <= drawn, rank)).select(*rows.columns, "rank")
    return numbered.union(rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row for each row of docs."""
    rows = materialize(scored(docs, gains(docs, target, longest, buckets), longest, seed), "scored")
    return ranked(rows, least, percent).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn documents with all their columns: those not after the last rank. Rows that are alike in score, doc_id
    and n_features with it all stay. The texts are read once more instead of being joined."""
    gain = gains(docs, target, longest, buckets)
    last = ranked(materialize(scored(docs, gain, longest, seed), "scored"), least, percent).where("rank IS NOT NULL").orderBy(F.desc("rank")).first()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = scored(docs, gain, longest, seed, {"row": row}).where(F.col("n_words") >= least)
    if last is None:
        return docs.limit(0)
    earlier = F.col("doc_id").isNotNull() if last.doc_id is None else F.coalesce(F.col("doc_id") < last.doc_id, F.lit(False))
    same = F.col("doc_id").eqNullSafe(F.lit(last.doc_id)) & (F.col("n_features") <= last.n_features)
    return again.where((F.col("score") > last.score) | (F.col("score") == last.score) & (earlier | same)).select("row.*")
