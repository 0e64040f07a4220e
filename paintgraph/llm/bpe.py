"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Contract. Null texts count as empty; empty texts give no ids. Texts of any length are handled whole. Repeated
rows give repeated results, a null doc_id is kept; other columns of the table are left alone. Characters that no match
of the pattern covers are left out, as the tiktoken library does. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes of pretokens and of their ids that each Python worker remembers, about, and the longest pretoken remembered
#: (bytes); the others are encoded again.
MEMO_BYTES, MEMO_LONGEST = 48 << 20, 64
#: A pattern, and characters in whose texts ASCII classes split as its Unicode classes do.
PLAIN_FOR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"[\x00-\x1b\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*"
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    chars, free = [], 0x100
    for b in range(256):
        chars.append(chr(b) if b in shown else chr(free))
        free += b not in shown
    return chars


class Codec:
    """The tokenizer of a rank file, with a bounded memo of pretokens and the reverse byte table."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.chars = byte_characters()
        shown = lambda token: "".join(self.chars[b] for b in token)
        merges = [tuple(map(shown, self._parts(token, rank, ranks))) for token, rank in sorted(ranks.items(), key=lambda x: x[1]) if len(token) > 1]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges))
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.full = regex.compile(pattern)
        self.plain = re.compile(PLAIN) if pattern == PLAIN_FOR else None  # the quick way is one pattern's alone
        self.fast = re.compile(PLAIN_PATTERN)
        self.memo: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _parts(token: bytes, rank: int, ranks: dict) -> list[bytes]:
        """The pair whose merge makes the token: merge by ranks below its own until two parts are left."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: (r if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < rank else 1 << 40, i))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def split(self, text: str) -> list[str]:
        if self.plain and self.plain.fullmatch(text):
            return self.fast.findall(text)
        return [m[0] for m in self.full.finditer(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        split = [self.split(t) for t in texts]
        memo, char = self.memo, self.chars
        long: dict[str, bytes] = {}
        new = list(dict.fromkeys(w for words in split for w in words if w not in memo))
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            shown = ["".join([char[b] for b in w.encode()]) for w in part]
            for w, e in zip(part, self.tokenizer.encode_batch(shown, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4").tobytes()
                if len(w) <= MEMO_LONGEST:
                    memo[w] = ids
                    self.held += 150 + len(w) + len(ids)
                else:
                    long[w] = ids
        ids_of = (lambda w: memo.get(w) or long[w]) if long else memo.__getitem__
        return [b"".join(map(ids_of, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> np.ndarray:
        """For each id the first and last+1 character that its bytes touch; parts of one split character overlap."""
        raw = np.frombuffer(text.encode(), np.uint8)
        starts = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to each byte
        ends = np.cumsum([len(self.table[i]) for i in np.frombuffer(ids, "<u4").tolist()], dtype=np.int64)
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
        return np.stack([starts[begins] - 1, starts[ends - 1]], 1).astype("<u4") if len(ends) else np.zeros((0, 2), "<u4")


_codecs: dict = {}


def codec(path: str, pattern: str) -> Codec:
    """One per Python worker and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit), n_tokens; with offsets also character spans (pairs, same format)."""

    def run(batches):
        c = codec(path, pattern)
        for batch, values in slices(batches, "t", 1 << 20):
            texts = [(v or b"").decode() for v in values]
            ids = c.encode(texts)
            cols = [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if offsets:
                cols.append(pa.array([c.offsets(t, x).tobytes() for t, x in zip(texts, ids, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_tokens", "offsets"][: len(cols)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("binary").alias("t")).mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long" + ", offsets binary" * offsets)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds `decoded`: the bytes that the ids stand for. A character split over ids is whole again in the bytes."""
    kind = tokens.select("doc_id", "ids", "n_tokens")

    def run(batches):
        c = codec(path, pattern)
        for batch, values in slices(batches, "ids", 2 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.decode(v or b"") for v in values], pa.binary())], names=[*batch.schema.names, "decoded"])

    return kind.mapInArrow(run, f"doc_id {kind.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The query's result: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = decode(encode(docs, path, pattern), path, pattern)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
