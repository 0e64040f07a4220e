"""Substring removal with suffix automata, over words.

Removes each word in a window of `length` consecutive words that also starts anywhere else. The corpus's repeated
anchors (see repeats.py) pick the contexts that matter, one of each content with its number of occurrences; each shard
of them gets a suffix automaton with counts of occurrences, and the contexts are streamed through it: the matching
statistics give the longest match that ends at each word, and a window recurs if its state was reached more than once.
Every removed word comes from such a match, those in exact copies as well.

The reference shards are dealt to the tasks beside the documents that can match them instead of being broadcast
whole, because their number grows with the corpus. A shard is about 256 KB of contexts.

Contract. Null texts have no words; texts of fewer than `length` words lose none. Windows are judged on the input.
A row repeated with doc_id and text counts as another place. Texts of any length are handled whole. Empty table:
empty result. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import covered, materialize, row_key, same_row

LENGTH = 35


class Automaton:
    """The suffix automaton of several word sequences, with how often each state's strings occur."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]

    def _state(self, size: int, step: dict, link: int, count: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.size.append(size)
        self.count.append(count)
        return len(self.size) - 1

    def _split(self, p: int, q: int, w) -> int:
        clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q], 0)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list, weight: int) -> None:
        last = 0
        nxt, link, size = self.next, self.link, self.size
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, q, w)
                self.count[last] += weight
                continue
            new = self._state(size[last] + 1, {}, 0, weight)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, q, w)
            last = new

    def close(self) -> None:
        """Occurrences of a state are those of the states whose suffixes it holds, too."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def repeated(self, words: list, length: int) -> list[int]:
        """Starts of the windows that occur more than once: streams the words, keeping the match at `length` at most."""
        state, found = 0, []
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
            state = self.next[state].get(w, 0)
            while self.link[state] >= 0 and self.size[self.link[state]] >= length:
                state = self.link[state]
            if i + 1 >= length and self.size[state] >= length and self.count[state] > 1:
                found.append(i + 1 - length)
        return found


def resolver(length: int):
    def resolve(rows: list) -> list:
        shard, by = Automaton(), {}
        contexts = [[by.setdefault(w, len(by)) for w in r[5].split()] for r in rows]
        for words, r in zip(contexts, rows, strict=True):
            shard.add(words, r[2])
        shard.close()
        return [(r[0], r[1], s, e) for words, r in zip(contexts, rows, strict=True) for s, e in covered([(i, i + length) for i in shard.repeated(words, length)])]

    return resolve


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, k, kept, n_removed, n_spans of the rows that lose words."""
    kind = repeats.word_kind(length, max(1, length * 6 // 35))
    return repeats.cut(repeats.spans(docs, kind, resolver(length)), kind, b" ")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The query's result; rows that lose nothing are hashed where they are read, and only numbers are joined."""
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    base = docs.select("doc_id", row_key().alias("k"), F.btrim(words).alias("w"))
    base = base.select("doc_id", "k", F.when(F.col("w") == "", 0).otherwise(F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"), F.sha2("w", 256).alias("whole"))
    lost = materialize(repeated_spans(docs, length).select("doc_id", "k", "n_removed", "n_spans", F.sha2("kept", 256).alias("part")).dropDuplicates(["doc_id", "k"]), "lost")
    return base.join(lost, same_row(base, lost), "left").select(base["doc_id"], "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("part", "whole").alias("kept_sha256"))
