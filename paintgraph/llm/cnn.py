"""Quality classifier: a byte-level convolutional network in numpy.

Overlapping chunks cover the whole text. Each byte has a learned vector; filters of eight bytes move by four; each
filter's maximum over a chunk feeds a small hidden layer and a logit, and the chunks' mean logit gives the
document's probability. Training takes a bounded sample: at most TRAIN_DOCS labelled rows, half of each label, with
their whole texts; the labels' shares over all allowed rows set the prior. The driver trains and reads the sample a
partition at a time, so it never holds all texts; chunks of a text are worked on in slices.

Contract. Null and empty texts are one chunk of padding and get its score. Repeated rows score alike; a doc_id with
several texts trains with the least of them alone. Texts of any length are scored and trained on whole. A table
without usable labels gives the neutral score 0.5. Null doc_id: scored, never held out, never a label. Empty table:
empty result. Other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Table
from .common import slices

TRAIN_DOCS, EPOCHS, SEED, PARTS, SLICE = 3000, 6, 7, 8, 256
CHUNK, OVERLAP, STEP, DIM, FILTERS, HIDDEN = 512, 64, 4, 8, 32, 16


def id_crc(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def chunks_of(b: bytes) -> np.ndarray:
    """The text's chunks, one a row; the last is padded with zero bytes."""
    hop = CHUNK - OVERLAP
    n = max(1, -(-(len(b) - OVERLAP) // hop))
    padded = np.zeros(hop * (n - 1) + CHUNK, np.uint8)
    padded[: len(b)] = np.frombuffer(b, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::hop]


class Network:
    def __init__(self, rng: np.random.Generator):
        block = STEP * DIM
        make = lambda *shape, by: (rng.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
        self.p = {"e": make(256, DIM, by=1), "w": make(block, 2 * FILTERS, by=2 * block), "c": np.zeros(FILTERS, np.float32), "u": make(FILTERS, HIDDEN, by=FILTERS), "d": np.zeros(HIDDEN, np.float32), "v": make(HIDDEN, by=HIDDEN), "b": np.zeros(1, np.float32)}

    def pooled(self, x: np.ndarray, places: bool = False):
        """Chunks (n, CHUNK) to filter maxima; a filter spans two blocks of STEP bytes, so both halves are one product."""
        p = self.p
        blocks = p["e"][x].reshape(len(x), CHUNK // STEP, STEP * DIM)
        y = blocks.reshape(-1, STEP * DIM) @ p["w"]
        y = y.reshape(len(x), CHUNK // STEP, 2 * FILTERS)
        s = y[:, :-1, :FILTERS] + y[:, 1:, FILTERS:]
        if not places:
            return np.maximum(s.max(1) + p["c"], 0), None, None
        at = s.argmax(1)
        top = np.take_along_axis(s, at[:, None], 1)[:, 0] + p["c"]
        return np.maximum(top, 0), at, blocks

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.p
        out = [np.tanh(self.pooled(x[i : i + 128])[0] @ p["u"] + p["d"]) @ p["v"] + p["b"][0] for i in range(0, len(x), 128)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def gradients(self, x: np.ndarray, doc: np.ndarray, target: np.ndarray) -> dict:
        """Of the mean cross-entropy over documents; doc gives each chunk's document, 0 to len(target) - 1.

        A document's logit is the mean of its chunks', so chunks can be worked on in slices once it is known.
        """
        own = np.bincount(doc, minlength=len(target)).astype(np.float32)
        logit = np.bincount(doc, self.logits(x), len(target)) / own
        g = ((1 / (1 + np.exp(-logit)) - target) / len(target) / own)[doc].astype(np.float32)
        total: dict = {}
        for i in range(0, len(x), SLICE):
            for k, v in self._backward(x[i : i + SLICE], g[i : i + SLICE]).items():
                total[k] = total[k] + v if k in total else v
        return total

    def _backward(self, x: np.ndarray, g: np.ndarray) -> dict:
        """Gradients of the chunks' logits, weighted by g."""
        p = self.p
        h, at, blocks = self.pooled(x, places=True)
        z = np.tanh(h @ p["u"] + p["d"])
        gz = g[:, None] * p["v"] * (1 - z * z)
        gh = (gz @ p["u"].T) * (h > 0)
        n = np.arange(len(x))[:, None]
        first, second = blocks[n, at], blocks[n, at + 1]  # (chunks, FILTERS, block): a maximum has one place
        gw = np.concatenate([np.einsum("nf,nfb->bf", gh, first), np.einsum("nf,nfb->bf", gh, second)], 1)
        ge = np.zeros_like(p["e"])
        parts = x.reshape(len(x), CHUNK // STEP, STEP)
        for places, w in ((at, p["w"][:, :FILTERS]), (at + 1, p["w"][:, FILTERS:])):
            np.add.at(ge, parts[n, places].reshape(-1), (gh[:, :, None] * w.T).reshape(-1, DIM))
        return {"e": ge, "w": gw, "c": gh.sum(0), "u": h.T @ gz, "d": gz.sum(0), "v": z.T @ g, "b": g.sum(keepdims=True)}


def train(parts, seed: int = SEED, epochs: int = EPOCHS) -> Network:
    """Adam over batches of 32 documents. parts(): the sample as lists of (bytes, label), read anew for each epoch."""
    rng = np.random.default_rng(seed)
    net = Network(rng)
    m, s, t = {k: 0.0 for k in net.p}, {k: 0.0 for k in net.p}, 0
    for epoch in range(epochs):
        for docs in parts():
            order = rng.permutation(len(docs))
            for i in range(0, len(order), 32):
                part = [(chunks_of(docs[j][0]), docs[j][1]) for j in order[i : i + 32]]
                x = np.concatenate([c for c, _ in part])
                doc = np.repeat(np.arange(len(part)), [len(c) for c, _ in part])
                grads, t = net.gradients(x, doc, np.array([y for _, y in part], np.float32)), t + 1
                for k, g in grads.items():
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                    net.p[k] -= (0.004 * 0.75**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int) -> DataFrame:
    """At most per_class documents of each label among the allowed ones, picked by a hash; with the label as y."""
    usable = labels.where(allowed & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).dropDuplicates(["doc_id"])
    picks = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picks[0].union(picks[1])), "doc_id")  # 2 * per_class rows are broadcast
    # a doc_id may come any number of times: one text of it stays, chosen in each task first
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, n_docs: int = TRAIN_DOCS) -> tuple[Network | None, float]:
    """The network and what the prior adds to its logit."""
    shares = {r["y"]: r["n"] for r in labels.where(allowed).groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).where("y in (0, 1)").collect()}
    if len(shares) < 2:
        return None, 0.0

    picked = sample(docs, labels, label, allowed, n_docs // 2).select(F.col("doc_id").cast("string").alias("doc_id"), "y", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    told = Table(picked.repartition(PARTS, F.xxhash64("doc_id")), "told")
    have = {r["y"]: r["n"] for r in told.df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def parts():
        """The rows of a part of the documents at a time, in an order that doesn't depend on Spark's."""
        for i in range(PARTS):
            own = told.df.where(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == i).select("doc_id", "y", "b").collect()  # n_docs / PARTS rows, about
            yield [(bytes(r["b"]), r["y"]) for r in sorted(own, key=lambda r: r["doc_id"])]

    net = train(parts)
    told.free()
    return net, float(np.log(shares[1] / shares[0]) - np.log(max(have.get(1, 0), 1) / max(have.get(0, 0), 1)))


def score(docs: DataFrame, net: Network | None, shift: float) -> DataFrame:
    """doc_id and score (0 to 1) of every row; the network's few thousand numbers are all that is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((net, shift))

    def run(batches):
        net, shift = shared.value
        for batch, values in slices(batches, "b", 1 << 20):
            if net is None:
                scores = np.full(len(values), 0.5)
            else:
                cut = [chunks_of(v) for v in values]
                own = np.array([len(c) for c in cut])
                logit = np.bincount(np.repeat(np.arange(len(cut)), own), net.logits(np.concatenate(cut)), len(cut)) / own
                scores = 1 / (1 + np.exp(-(logit.astype(np.float64) + shift)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    net, shift = fit(docs, labels, "quality", id_crc() % 4 != 2, n_docs)
    scored = score(docs, net, shift)
    return scored.select("doc_id", F.coalesce(id_crc() % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
