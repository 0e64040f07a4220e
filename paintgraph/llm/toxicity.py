"""Toxicity by noisy-channel deobfuscation.

A character language model (letter trigrams) is counted over all documents. Tokens with leetspeak, separators or
stretched letters, and runs of single characters, become lattices of the letters that they may stand for; Viterbi
decoding under the model picks the likeliest path, and the restored words are scored. Word weights (lower bounds of
the log odds of the label) come from a bounded sample: at most TRAIN_DOCS labelled rows, half of each label; copies of a
text in it count once for each label. A `*` may stand for any letter: such tokens also give the weighted words that fit
all their other letters.

Contract. Null and empty texts hold no words and get the score of a text without any weighted word. Repeated rows
score alike; a doc_id with several texts trains with the least of them alone. Texts and tokens of any length are
decoded whole: paths are kept for BLOCK places at once, and the others are walked again from the costs kept at each
block's start. Without usable labels every score is 0. Null doc_id: scored, never held out. Empty table: empty result.
Other columns take no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cnn import id_crc, sample
from .common import slices

TRAIN_DOCS, MIN_DOCS, MIN_Z, BLOCK = 12_000, 6, 3.0, 8192
#: Tokens that a worker remembers, and the longest (characters) remembered.
MEMO, MEMO_LONGEST = 300_000, 64
#: Letters that a character may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "&": "a", "%": "x"}
SEPARATORS = ".-_*~'`^,:/\\·"
ANY = "abcdefghijklmnopqrstuvwxyz"
_odd = re.compile(r"(?:[^\W\d_][^\w\s]|[^\W\d_][\d_]|[\d@$!|+(<€£¡#&%][^\W\d_]|(.)\1\1)", re.S)
_edges = re.compile(r"^[^\w@$]+|[^\w@$!]+$")
_spaced = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_letters = np.full(256, 0, np.int32)
_letters[97:123] = np.arange(1, 27)
_letters[65:91] = np.arange(1, 27)
_letters[128:] = 27
BASE = 28


def trigram_counts(docs: DataFrame) -> DataFrame:
    """code, n: letter trigrams of all texts (28 classes of bytes), summed in each task before the shuffle."""

    def run(batches):
        total = np.zeros(BASE**3, np.int64)
        for _, values in slices(batches, "b", 2 << 20):
            c = _letters[np.frombuffer(b" ".join([b"", *values, b""]), np.uint8)]
            if len(c) > 2:
                total += np.bincount((c[:-2] * BASE + c[1:-1]) * BASE + c[2:], minlength=BASE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["code", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    return rows.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Decoder:
    """Viterbi over character lattices; costs are negative log probabilities."""

    def __init__(self, counts: list[tuple[int, int]]):
        n = np.full(BASE**3, 0.1)
        for code, k in counts:
            n[code] += k
        n = n.reshape(BASE, BASE, BASE)
        self.cost = (-np.log(n / n.sum(2, keepdims=True))).tolist()

    def arcs(self, text: str, i: int, run: int) -> list[tuple[int, str, float]]:
        """Ways on from place i, where the same character stands `run` times: (next place, letters put out, channel cost)."""
        ch = text[i]
        if ch.isalpha():
            if run >= 3:
                return [(i + run, ch, 1.0), (i + run, ch * 2, 1.5)]
            return [(i + 1, ch, 0.0)]
        on = [(i + 1, x, 1.0) for x in STANDS_FOR.get(ch, "")]
        if ch in SEPARATORS or ch.isspace() or run >= 3:
            on.append((i + run, "", 0.5))
        if ch == "*":
            on += [(i + 1, x, 2.0) for x in ANY]
        return on or [(i + 1, ch, 0.0)]

    @staticmethod
    def code(ch: str) -> int:
        o = ord(ch)
        return o - 96 if 97 <= o <= 122 else 27 if o > 127 else 0

    def _walk(self, text: str, ends: list[int], live: dict, start: int, stop: int, back: dict | None) -> None:
        """Moves the paths at places start to stop - 1 on. live: place -> last two letters -> cost; back: with how they came."""
        for i in range(start, stop):
            here = live.pop(i, None)
            if not here:
                continue
            ways = self.arcs(text, i, ends[i] - i)
            for (a, b), cost in here.items():
                for to, put, extra in ways:
                    x, y, total = a, b, cost + extra
                    for ch in put:
                        z = self.code(ch)
                        total += self.cost[x][y][z]
                        x, y = y, z
                    states = live.setdefault(to, {})
                    old = states.get((x, y))
                    if old is None or total < old:
                        states[x, y] = total
                        if back is not None:
                            back[to, x, y] = (i, a, b, put)

    def decode(self, text: str) -> str:
        """The likeliest letters; each place keeps the best path for its last two letters."""
        n = len(text)
        ends = [n] * n  # where each place's run of one character ends
        for i in range(n - 2, -1, -1):
            ends[i] = ends[i + 1] if text[i] == text[i + 1] else i + 1
        live: dict = {0: {(0, 0): 0.0}}
        kept = []  # costs at the start of each block, for the places from there on
        for start in range(0, n, BLOCK):
            kept.append({p: dict(s) for p, s in live.items()} if n > BLOCK else live)
            if n > BLOCK:
                self._walk(text, ends, live, start, min(n, start + BLOCK), None)
        place, state, out = n, None, []
        for k in range(len(kept) - 1, -1, -1):
            start = k * BLOCK
            if state is not None and place <= start:  # a jump went over the whole block
                continue
            back: dict = {}
            again = kept[k]
            self._walk(text, ends, again, start, min(n, start + BLOCK), back)
            if state is None:
                last = again[n]
                state = min(last, key=lambda s: last[s] + self.cost[s[0]][s[1]][0])
            while (step := back.get((place, *state))) is not None:
                place, state = step[0], (step[1], step[2])
                out.append(step[3])
        return "".join(reversed(out))

    def words(self, token: str) -> tuple[str, ...]:
        """The forms to score of a lower-case token: without its edges, and restored where it looks altered."""
        core = _edges.sub("", token)
        forms = [core] if core else []
        if _odd.search(core):
            restored = self.decode(core)
            forms.append(_edges.sub("", restored))
            bare = re.sub(r"[^\w]+$", "", core)
            if bare != core and bare:
                forms.append(self.decode(bare) if _odd.search(bare) else bare)
        return tuple(dict.fromkeys(f for f in forms if f))

    def of_text(self, text: str, memo: dict) -> set[str]:
        low = text.lower()
        found = set()
        for token in set(low.split()):
            forms = memo.get(token)
            if forms is None:
                if len(memo) > MEMO:
                    memo.clear()
                forms = self.words(token)
                if len(token) <= MEMO_LONGEST:
                    memo[token] = forms
            found.update(forms)
            if "*" in token:
                found.add(token)  # as it stands, for the words that fit it
        for run in _spaced.findall(low):
            letters = "".join(run.split())
            found.update(self.words(letters))
            if not letters.isalpha():
                found.add(self.decode(letters))
        return found


def restored_words(docs: DataFrame, decoder: Decoder, keep: list[str]) -> DataFrame:
    """docs' columns `keep`, and the distinct words of the restored text."""
    shared = docs.sparkSession.sparkContext.broadcast(decoder)

    def run(batches):
        memo: dict = {}
        for batch, values in slices(batches, "b"):
            words = [sorted(shared.value.of_text(v.decode(), memo)) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.list_(pa.string()))], names=[*keep, "words"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("b")).mapInArrow(run, f"{schema}, words array<string>")


def features(weights: list[float]) -> list[float]:
    """Of a document's weighted words: the largest weight, how many, and their sum, damped."""
    return [max(weights, default=0.0), np.log1p(len(weights)), np.log1p(sum(weights))]


class Model:
    def __init__(self, decoder: Decoder, weights: dict[str, float], beta: np.ndarray | None):
        self.decoder, self.weights, self.beta = decoder, weights, beta
        self.by_length: dict[int, list[str]] = {}
        for w in weights:
            self.by_length.setdefault(len(w), []).append(w)

    def fitting(self, token: str) -> list[str]:
        """The weighted words that a token with stars may stand for: as long, and alike but for fewer stars than letters."""
        core = _edges.sub("", token) if not token.startswith("*") else token
        letters = [STANDS_FOR.get(ch, ch) for ch in core]
        if 2 * core.count("*") >= len(core):
            return []
        return [w for w in self.by_length.get(len(core), ()) if all(ch == "*" or x in ch for ch, x in zip(letters, w, strict=True))]

    def weighted(self, found: set[str]) -> list[float]:
        known = found & self.weights.keys()
        for f in found:
            if "*" in f:
                known.update(self.fitting(f))
        return [self.weights[f] for f in sorted(known)]

    def score(self, found: set[str]) -> float:
        if self.beta is None:
            return 0.0
        x = np.array([1.0, *features(self.weighted(found))])
        return float(1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge."""
    x, beta = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.5 * beta)
    return beta


def telling(per_word: DataFrame, have: dict[int, int]) -> DataFrame:
    """word, w: the words whose log odds of the label are above 1.5 at the lower end of their Wilson interval of MIN_Z deviations (w).

    Each word is judged by its own counts alone, and w keeps growing with the rows where no clean row has the word.
    """
    n, zz = F.col("bad") + F.col("good"), MIN_Z**2
    p = F.col("bad") / n
    low = (p + zz / (2 * n) - MIN_Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    w = F.log(low / (1 - low)) - F.log(F.lit(have[1] / have[0]))
    return per_word.where(F.col("bad") >= MIN_DOCS).select("word", w.alias("w")).where("w > 1.5")


def fit(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS) -> Model:
    """Language model from all documents; word weights and the last layer from the bounded sample."""
    decoder = Decoder([(r["code"], r["n"]) for r in trigram_counts(docs).collect()])  # 28^3 rows at most
    allowed = id_crc() % 5 != 0
    shares = {r["y"]: r["n"] for r in labels.where(allowed).groupBy(F.col("toxic").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).where("y in (0, 1)").collect()}
    if len(shares) < 2:
        return Model(decoder, {}, None)
    from .common import materialize

    told = materialize(restored_words(sample(docs, labels, "toxic", allowed, n_docs // 2).dropDuplicates(["y", "text"]), decoder, ["y"]), "told")
    have = {r["y"]: r["n"] for r in told.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(have) < 2:
        return Model(decoder, {}, None)
    per_word = told.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    weights = {r["word"]: r["w"] for r in telling(per_word, have).collect()}  # words of MIN_DOCS rows of the sample or more
    model = Model(decoder, weights, None)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches):
        for batch in batches:
            x = [features(shared.value.weighted(set(words))) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([float(r[i]) for r in x], pa.float64()) for i in range(3))], names=["y", "a", "b", "c"])

    told_x = told.select("y", "words").mapInArrow(measured, "y int, a double, b double, c double").orderBy("y", "a", "b", "c").collect()  # n_docs rows
    x = np.array([r[1:] for r in told_x])
    y = np.array([r["y"] for r in told_x], float)
    prior = np.where(y == 1, shares[1] / max(have[1], 1), shares[0] / max(have[0], 1))
    return Model(decoder, weights, logistic(x, y, prior / prior.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; the model (letter costs, and the words that MIN_DOCS rows of the bounded sample share) is what is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memo: dict = {}
        for batch, values in slices(batches, "b"):
            model = shared.value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(model.decoder.of_text(v.decode(), memo)) for v in values], pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, n_docs))
    return scored.select("doc_id", F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
