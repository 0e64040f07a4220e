"""Substring removal with suffix arrays, sorted deep-shallow.

Removes each byte that lies in a `length`-byte string which also starts anywhere else. The corpus's repeated anchors
(see repeats.py) give the suffixes to sort: for each representative context the suffix from its key, and the
reversed text before it. Contexts that occur more than once stand beside themselves in the order. Multikey quicksort orders them to a shallow depth; groups with a longer common prefix go
to blind tries, which look at the characters that tell suffixes apart and compare text once an insertion. Longest
common prefixes of neighbours then tell which windows around the anchor recur.

Contract. Null texts are empty; texts shorter than `length` have no string to remove. Strings are judged on the
input. A row repeated with doc_id and text counts as another place. Texts of any length are handled whole. Empty
table: empty result. Other columns take no part.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import covered, keyed, materialize, same_row

LENGTH, SHALLOW = 400, 32


def lcp(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving compares of slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """A blind trie: inner nodes hold a depth and the byte there of each child; leaves hold suffixes."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.root = texts, None

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [len(self.texts[i]), None, [i]]  # depth, children, equal suffixes
            return
        text, node, path = self.texts[i], self.root, []
        while node[1] is not None:  # blind: bytes between branches aren't looked at
            path.append(node)
            node = node[1].get(text[node[0]] if node[0] < len(text) else -1) or next(iter(node[1].values()))
        other = self.texts[node[2][0]]
        common = lcp(text, other)
        if common == len(text) == len(other):
            node[2].append(i)
            return
        parent = None
        for step in path:
            if step[0] >= common:
                node = step
                break
            parent = step
        key = text[common] if common < len(text) else -1
        leaf = [len(text), None, [i]]
        if node[1] is not None and node[0] == common:
            node[1][key] = leaf
            return
        inner = [common, {other[common] if common < len(other) else -1: node, key: leaf}, None]
        if parent is None:
            self.root = inner
        else:
            parent[1][text[parent[0]] if parent[0] < len(text) else -1] = inner

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[1] is None:
                out += node[2]
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def suffix_order(texts: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of the suffixes in order: three-way quicksort on four bytes at a time, then blind tries."""
    out: list[int] = []
    stack = [(list(range(len(texts))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            trie = Trie(texts)
            for i in group:
                trie.insert(i)
            out += trie.ordered()
        else:
            pivot = texts[group[len(group) // 2]][depth : depth + 4]
            less, same, more = [], [], []
            for i in group:
                key = texts[i][depth : depth + 4]
                (less if key < pivot else same if key == pivot else more).append(i)
            stack += [(more, depth), (same, depth + 4 if len(pivot) == 4 else shallow), (less, depth)]
    return out


def resolve_group(members: list[tuple[bytes, bytes]], length: int, copies: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """For contexts (text before the key reversed, text from the key on): the ranges of window offsets that recur.

    A context that occurs more than once is its own neighbour in both orders, and agrees with itself on all of it.

    A window that starts o before the key recurs if another context agrees on o bytes before it and length - o
    from it. Contexts are united from the longest common left part down; an insertion looks only at its two
    neighbours in the order of right parts, for any other agrees on no more.
    """
    m = len(members)
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(m)]

    def note(i: int, j: int, left: int) -> None:
        right = lcp(members[i][1], members[j][1])
        if length - right <= left:
            for x in (i, j):
                ranges[x].append((max(0, length - right), left))

    for i, n in enumerate(copies or ()):
        if n > 1:
            note(i, i, len(members[i][0]))
    if m < 3:
        if m == 2:
            note(0, 1, lcp(members[0][0], members[1][0]))
        return ranges
    rank = [0] * m
    for r, i in enumerate(suffix_order([right for _, right in members])):
        rank[i] = r
    at = {r: i for i, r in enumerate(rank)}
    order = suffix_order([left for left, _ in members])
    steps = sorted(((lcp(members[a][0], members[b][0]), a, b) for a, b in zip(order, order[1:])), reverse=True)
    group = list(range(m))
    sets: list[list[int]] = [[rank[i]] for i in range(m)]

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for left, a, b in steps:
        a, b = root(a), root(b)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        for r in sets[b]:
            k = bisect_left(sets[a], r)
            for near in sets[a][max(0, k - 1) : k + 1]:
                note(at[r], at[near], left)
            sets[a].insert(k, r)
        group[b], sets[b] = a, []
    return ranges


def resolver(length: int):
    def resolve(rows: list) -> list:
        out, i = [], 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            own = rows[i:j]
            members = [(r[5][: r[3]][::-1], r[5][r[3] :]) for r in own]
            for r, found in zip(own, resolve_group(members, length, [r[2] for r in own]), strict=True):
                out += [(r[0], r[1], s, e) for s, e in covered([(r[3] - high, r[3] - low + length) for low, high in found])]
            i = j
        return out

    return resolve


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, k, kept, n_removed, n_spans of the rows that lose bytes."""
    kind = repeats.byte_kind(length, max(1, length * 128 // 400))
    return repeats.cut(repeats.spans(docs, kind, resolver(length)), kind, b"")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The query's result; rows that lose nothing are hashed where they are read, and only numbers are joined."""
    base = keyed(docs).select("doc_id", "k", F.octet_length("b").cast("long").alias("n_bytes"), F.sha2("b", 256).alias("whole"))
    lost = materialize(repeated_spans(docs, length).select("doc_id", "k", "n_removed", "n_spans", F.sha2("kept", 256).alias("part")).dropDuplicates(["doc_id", "k"]), "lost")
    zero = F.lit(0).cast("long")
    return base.join(lost, same_row(base, lost), "left").select(base["doc_id"], "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("part", "whole").alias("kept_sha256"))
