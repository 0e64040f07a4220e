"""The text operators against brute force, on tables with every awkward row."""

import collections
import hashlib
import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k int, b string, _extra string"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))


def texts():
    passage, base = prose(90), prose(150)
    near = base.split()
    near[70] = "changed"
    lines = "\n".join(prose(6) for _ in range(40))
    return [
        None, "", " \t\n ", "word", "two words", passage, prose(40) + " " + passage + " " + prose(40), prose(30) + "\n" + passage + prose(20), base, base, " ".join(near), "x " * 900, "a" * 3000, lines, prose(3) + "\n" + lines, lines + "\n" + prose(5), prose(6000),
        "Ünï çödé 漢字 😀 \x1c\x85\xa0 1² ½ a's  don't\r\n\r\n tab\t", base.upper(), "é" * 700, *[prose(rng.randint(1, 80)) for _ in range(15)],
    ]


@pytest.fixture(scope="module")
def table():
    t = texts()
    rows = [(i, x, ["en", "fr", None, "xx"][i % 4], "s", 1, i, "b", None) for i, x in enumerate(t)]
    return [*rows, rows[6], rows[8]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_quality_counts(docs, nothing, table):
    from paintgraph.llm import quality

    got = collections.defaultdict(list)
    for r in quality.judge(docs).collect():
        got[r.doc_id].append(r)
    for i, x, *_ in table:
        x = x or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        grams = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        hit = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))
        for r in got[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
            assert not (r.base_failed and r.kept)
    assert quality.judge(nothing).count() == 0
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and quality.filter_documents(nothing).count() == 0


def test_bpe(docs, nothing, table):
    import base64

    import numpy as np
    import public_tokenizers as P
    import tiktoken

    from paintgraph.llm import bpe

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by = {i: x or "" for i, x, *_ in table}
    got = bpe.digests(docs, path, P.PATTERN).collect()
    assert len(got) == len(table)
    for r in got:
        ids = e.encode_ordinary(by[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(by[r.doc_id].encode()))
    assert bpe.digests(nothing, path, P.PATTERN).count() == 0
    for r in bpe.encode(docs, path, P.PATTERN, offsets=True).collect():
        spans, text = np.frombuffer(r.offsets, "<u4").reshape(-1, 2).tolist(), by[r.doc_id]
        assert len(spans) == r.n_tokens and all(s < t for s, t in spans) and (not spans or (spans[0][0], spans[-1][1]) == (0, len(text)))


def removed(parts, length):
    """Brute force: which elements of each sequence lie in a window that starts elsewhere, too."""
    seen = collections.Counter(tuple(p[i : i + length]) for p in parts for i in range(len(p) - length + 1))
    out = []
    for p in parts:
        gone = bytearray(len(p))
        for i in range(len(p) - length + 1):
            if seen[tuple(p[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return out


def test_suffix_arrays(docs, nothing, table):
    from paintgraph.llm import suffix_dedup

    parts = [(x or "").encode() for _, x, *_ in table]
    want = collections.Counter((r[0], len(p), sum(g), len(re.findall(b"\1+", bytes(g))), sha(bytes(c for c, z in zip(p, g, strict=True) if not z))) for r, p, g in zip(table, parts, removed(parts, 400), strict=True))
    assert collections.Counter(map(tuple, suffix_dedup.digests(docs).collect())) == want
    assert suffix_dedup.digests(nothing).count() == 0


def test_suffix_order_is_the_sorted_order():
    from paintgraph.llm.suffix_dedup import resolve_group, suffix_order

    t = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    t += [b"q" * 50 + x for x in t[:60]] + [b"q" * 50] * 3
    assert [t[i] for i in suffix_order(t)] == sorted(t)
    members = [(x[:20], b"m" + x[20:60]) for x in t[:120]]
    got = resolve_group(members, 12)
    windows = [{o: (x[0][:o], x[1][: 12 - o]) for o in range(13) if len(x[0]) >= o and len(x[1]) >= 12 - o} for x in members]
    seen = collections.Counter((o, w) for own in windows for o, w in own.items())
    for own, ranges in zip(windows, got, strict=True):
        assert {o for a, b in ranges for o in range(a, b + 1)} == {o for o, w in own.items() if seen[o, w] > 1}


def test_suffix_automata(docs, nothing, table):
    from paintgraph.llm import automaton_dedup

    parts = [(x or "").encode().split() for _, x, *_ in table]
    want = collections.Counter((r[0], len(p), sum(g), sha(b" ".join(w for w, z in zip(p, g, strict=True) if not z))) for r, p, g in zip(table, parts, removed(parts, 35), strict=True))
    assert collections.Counter(map(tuple, automaton_dedup.digests(docs).collect())) == want
    assert automaton_dedup.digests(nothing).count() == 0


def test_sharding(docs, nothing, table):
    import zlib

    from paintgraph.llm import sharding

    placed, stored = sharding.assign(docs)
    got = placed.collect()
    assert len(got) == len(table) and {r.law for r in got} == {"bytes"}
    by = {i: (x or "").encode() for i, x, *_ in table}
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all((r.size, r.text_crc32) == (len(by[r.doc_id]) + 1, zlib.crc32(by[r.doc_id])) for r in got)
    assert sorted(tuple(r) for r in stored.groupBy("version").count().collect()) == [(0, 4096), (1, 4096)] and sharding.assign(nothing)[0].count() == 0


def test_rebalancing_evens_out():
    from paintgraph.llm.sharding import first_map, rebalance

    sizes = [rng.randint(1, 2000) for _ in range(1024)]
    after = rebalance(first_map(1024, 16), sizes, 16)
    load = [sum(b for b, s in zip(sizes, after, strict=True) if s == h) for h in range(16)]
    assert max(load) - min(load) < 0.01 * sum(load) / 16


def labelled(spark):
    good = [(i, prose(60), 1, 0) for i in range(80)]
    bad = [(100 + i, " ".join(w + "$$$" for w in prose(60).split()), 0, 0) for i in range(60)]
    toxic = [(200 + i, prose(30) + " " + rng.choice(["idiot", "1d10t", "i d i o t", "i.d.i.o.t"]) + " " + prose(30), 1, 1) for i in range(80)]
    rows = [*good, *bad, *toxic, (400, None, 1, 0), (401, "", 1, 0), (None, "some text", 1, 0)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")


def test_network_learns(spark):
    from paintgraph.llm import cnn

    docs, labels = labelled(spark)
    got = cnn.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert held and sum((r.predicted == 1) == (not 100 <= r.doc_id < 200) for r in held) >= 0.9 * len(held)
    assert cnn.classify(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert cnn.classify(docs.limit(0), labels).count() == 0


def test_chunks_cover_the_text():
    from paintgraph.llm.cnn import CHUNK, OVERLAP, chunks_of

    for n in (0, 1, CHUNK, CHUNK + 1, 5000):
        b = bytes(rng.randint(1, 255) for _ in range(n))
        joined = b"".join([c.tobytes() if i == 0 else c.tobytes()[OVERLAP:] for i, c in enumerate(chunks_of(b))])
        assert joined[:n] == b and not joined[n:].strip(b"\0")


def test_toxicity(spark):
    from paintgraph.llm import toxicity

    docs, labels = labelled(spark)
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and sum((r.predicted == 1) == (r.doc_id >= 200) for r in held) >= 0.9 * len(held)
    assert toxicity.classify(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_lines(docs, nothing, table):
    from paintgraph.llm import lines

    split = [(r[0], r[1].encode().split(b"\n")) for r in table if r[1] is not None]
    first = {}
    for i, own in sorted(split, key=lambda x: x[0]):
        for n, (s, e) in enumerate(lines.chunk_lines(own)):
            first.setdefault(tuple(own[s:e]), (i, n))
    want = {i: b"\n".join(x for n, (s, e) in enumerate(lines.chunk_lines(own)) if e - s < 2 or first[tuple(own[s:e])] == (i, n) for x in own[s:e]) for i, own in split}
    got = lines.digests(docs).collect()
    assert len(got) == len(table) and all(r.kept_sha256 == sha(want.get(r.doc_id, b"")) for r in got)
    left = lines.dedup_documents(docs)
    assert left.columns == docs.columns and sum(r.n_removed for r in got) > 0
    assert {r.doc_id: (r.text or "").encode() for r in left.collect()} == {r[0]: want.get(r[0], b"") for r in table if not (want.get(r[0], b"").strip() == b"" and (r[1] or "").strip())}
    assert lines.dedup_documents(nothing).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, docs, nothing, table, block):
    from paintgraph.llm import decontaminate as D

    whole = table[5][1].split()
    bench = [(1, " ".join(whole[3:20])), (2, "Word"), (3, None), (4, ""), (5, " ".join(whole[60:75])), (5, prose(12)), (None, "two words"), (6, "nowhere at all in these texts"), (10, " ".join(whole[8:30]).upper())]
    b = spark.createDataFrame(bench, "item_id long, text string")
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = collections.defaultdict(set)
    for i, x in bench:
        w = words(x)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(i)
    got = {r.doc_id: r for r in D.contamination(docs, b, block_bytes=block).select("doc_id", "n_words", D.n_hit("spans").alias("n_hit"), "items", "contaminated").collect()}
    for i, x, *_ in table:
        w, hit, items = words(x), set(), set()
        for j in range(len(w)):
            for size in {len(z) for z in windows}:
                if j + size <= len(w) and tuple(w[j : j + size]) in windows:
                    hit.update(range(j, j + size))
                    items |= windows[tuple(w[j : j + size])]
        r = got[i]
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (len(w), len(hit), sorted(str(x) for x in items if x is not None), bool(hit)), i
    left = D.remove_contaminated(docs, b)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i in got if not got[i].contaminated}
    assert D.digests(nothing, b).count() == 0 and D.digests(docs, b.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("block,shingles", [(1500, 1 << 22), (2, 1 << 22), (1500, 100)])
def test_near_duplicates(docs, nothing, table, block, shingles, monkeypatch):
    from paintgraph.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    sets = {}
    for i, x, *_ in table:
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(docs, 3, 85).collect()
    assert len(got) == len(table)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert neardup.near_duplicates(nothing, 3, 85).count() == 0 and neardup.dedup_documents(docs).columns == docs.columns


def test_sketches_fill_and_estimate():
    import numpy as np

    from paintgraph.llm import neardup

    x = np.arange(1, 401, dtype=np.uint64)
    sets = [x[:300], x[60:], x[:1], x[:3]]
    s = neardup.sketches(np.concatenate(sets), np.repeat(np.arange(4), [len(y) for y in sets]), 4)
    assert not (s == neardup._EMPTY).any() and abs((s[0] == s[1]).mean() - 0.6) < 0.15


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ids = [r.doc_id for r in got]
    assert len(set(ids)) == len(ids) and 50 < len(ids) < 200 and all(len(r.ids) == 4 * r.n_tokens for r in got)
