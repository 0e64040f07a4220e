"""SimHash signatures, importance resampling and vector codes against plain Python."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

rng = random.Random(77)
WORDS = ["".join(rng.choice("abcdeéñZ9漢") for _ in range(rng.randint(1, 9))) for _ in range(500)]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
SCHEMA = "doc_id long, text string, f long, t string, part int, label string, fixed int, weight int, `row` string, e string"


def fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    n = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)] if n else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 3, 4, "z", "w") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    base, long = prose(300).split(), prose(200)
    near = []
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        near.append(" ".join(own))
    return [None, "", " \t ", "one", "Two words", long, long.upper(), long, "a" * 100_000 + " b", "Ünï\x1cçö\x85dé\xa0x\r\ny", *near, *[prose(rng.randint(1, 120)) for _ in range(40)]]


def test_fingerprints_and_components(spark, texts):
    from paintgraph.llm import simhash

    rows = [*enumerate(texts), (3, texts[20]), (5, texts[5]), (None, texts[5]), (500, texts[12])]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [(i, fingerprint(t)) for i, t in rows]
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == collections.Counter((i, f"{f:016x}") for i, f in prints)
    named = [x for x in prints if x[0] is not None]
    want = roots({i for i, _ in named}, [(a, b) for a, f in named for b, g in named if (f ^ g).bit_count() <= 3])
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert len(set(want.values())) < len(want) - 5
    stay = {r.doc_id for r in simhash.dedup_documents(table(spark, rows)).collect()}
    assert stay == {None, *(i for i in want if want[i] == i)}
    assert simhash.near_duplicates(table(spark, rows).limit(0)).count() == 0


def components_of(spark, values, most):
    """Components of given fingerprints, with groups held to `most`."""
    from paintgraph import scratch
    from paintgraph.llm import simhash

    old, simhash.MOST = simhash.MOST, most
    try:
        prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "f long").repartition(3)
        found = simhash.links(prints)
        edges = found[0].df
        for t in found[1:]:
            edges = edges.union(t.df)
        assert edges.where("bit_count(u ^ v) > 3").count() == 0
        return {r.node & (1 << 64) - 1: r.label for r in scratch.components(edges).df.collect()}
    finally:
        simhash.MOST = old


@pytest.mark.parametrize("most", [1, 3, 256])
def test_no_link_is_lost_however_often_signatures_are_cut(spark, most):
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {c for c in centres} | {rng.getrandbits(64) for _ in range(50)}
    for c in centres:
        bits = rng.sample(range(64), 10)
        for _ in range(25):
            v = c
            for b in rng.sample(bits, rng.randint(0, 6)):
                v ^= 1 << b
            values.add(v)
    for b in range(64):  # pairs at three bits, spread in every way
        v = rng.getrandbits(64)
        values |= {v, v ^ 1 << b ^ 1 << rng.randrange(64) ^ 1 << (b + 32) % 64}
    values = sorted(values)
    got = components_of(spark, values, most)
    want = roots(values, [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3])
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups(got) == {g for g in groups(want) if len(g) > 1}


def words(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in low).split(b" ")


def draw(rows, target, longest, buckets, least, percent):
    def grams(t):
        w = [x for x in words(t) if x]
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(grams(x)[1])
    for x in target:
        t.update(grams(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in rows:
        n, f = grams(x)
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is None, x[1] or 0, x[2]))
    drawn = percent * len(order) // 100
    return [(i, f, w, sc) for _, i, f, w, sc in order[:drawn]], collections.Counter((i, f, w, sc) for _, i, f, w, sc in out)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (3, 60), (1, 100)])
def test_resampling(spark, texts, longest, percent):
    from paintgraph.llm import resampling

    rows = [*enumerate(texts), (7, texts[7]), (None, texts[20]), (None, texts[20]), (900, "a1" * 300 + " é" * 40)]
    target = [prose(50), None, "", texts[5], "B " * 30]
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    docs = table(spark, rows)
    got = resampling.resample(docs, bench, longest=longest, percent=percent).collect()
    drawn, all_rows = draw(rows, target, longest, 10_000, 20, percent)
    assert collections.Counter(tuple(r)[:4] for r in got) == all_rows
    assert [tuple(r)[:4] for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == drawn
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(drawn) + 1))
    kept = resampling.drawn_documents(docs, bench, longest=longest, percent=percent)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in drawn} and kept.count() >= len(drawn)


def test_resampling_of_empty_tables(spark, texts):
    from paintgraph.llm import resampling

    docs, none = table(spark, enumerate(texts)), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs, none).count() == len(texts)
    assert resampling.resample(docs.limit(0), none).count() == 0 and resampling.drawn_documents(docs.limit(0), none).count() == 0


def test_automaton_advances_every_crc():
    from paintgraph.llm import resampling

    texts = [b"", b"Ab", b"cD1", b" x", b"", b"y ", b"z" * 1000, "é".encode() * 50 + b"!k", b"!!"]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    bucket, owner, n = resampling.features(data, bounds, 1, 2**31 - 1)
    want = [(i, zlib.crc32(w) % (2**31 - 1)) for i, t in enumerate(texts) for w in words(t.decode()) if w]
    assert list(zip(owner.tolist(), bucket.tolist(), strict=True)) == want and n.tolist() == [sum(j == i for j, _ in want) for i in range(len(texts))]


def coded(vectors, parts=8, entries=16, rounds=6):
    """Plain integers all the way: codes, errors and codebooks."""
    ok = [(i, lab, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, v, lab in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    d = len(ok[0][2]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, _, v in ok]
    firsts = {}
    for (i, _, v), c in sorted(zip(ok, cut, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][2])):
        if i is not None and len(firsts) < entries:
            firsts.setdefault(i, c)
    books = [[c[p] for c in firsts.values()] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else e for j, e in enumerate(books[p])]
    out = []
    for (i, lab, _), c in zip(ok, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{j:02x}" for _, j in found), sum(x for x, _ in found)))
    total = collections.Counter()
    for _, lab, _, e in out:
        total[lab] += e
    h = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((i, code, e, total[lab], h) for i, lab, code, e in out)


VECTOR = "vec_id long, embedding array<float>, label int, v int, code string, part int"


def vectors():
    x = np.random.default_rng(3).normal(size=(160, 64)).astype(np.float32)
    x[40:90] = x[7]  # a group of copies
    x[90] = 0
    x[100:110, :8] = x[0, :8]
    rows = [(int(i), [float(y) for y in v], None if i % 7 == 0 else int(i % 3)) for i, v in enumerate(x)]
    bad = [(1000, None, 1), (1001, [None] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [float("inf")] + [0.0] * 63, 1), (1004, [-float("inf")] + [0.0] * 63, 2)]
    return [*rows, *bad, rows[20], rows[20], (3, rows[50][1], 2), (None, rows[11][1], None)]


@pytest.mark.parametrize("few", [0, 9])
def test_vector_codes(spark, few):
    from paintgraph.llm import quantize

    rows = vectors()[:few] if few else vectors()
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], VECTOR).repartition(5)
    got = quantize.digests(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert collections.Counter(map(tuple, got)) == coded(rows)


def test_codes_decode_to_their_entries(spark):
    from paintgraph.llm import quantize

    df = spark.createDataFrame([r for r in vectors()[:160]], "vec_id long, embedding array<float>, label int")
    codes, books = quantize.compress(df)
    whole = {r.vec_id: np.array(r.v) for r in quantize.integers(df).collect()}
    for r in quantize.decode(codes, books).collect():
        assert ((np.array(r.vector) * 4096 - whole[r.vec_id]) ** 2).sum() == r.error
    assert books.table(spark).count() == 128


def test_empty_and_unfit_vectors(spark):
    from paintgraph.llm import quantize

    df = spark.createDataFrame([r for r in vectors()[:20]], "vec_id long, embedding array<float>, label int")
    assert quantize.digests(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(900, [1.0] * 8, 1), (901, [], 1), (902, [1e30] * 64, 1)], "vec_id long, embedding array<float>, label int")
    assert {r.vec_id for r in quantize.digests(df.union(odd)).collect()} == {*range(20), 902}
    with pytest.raises(ValueError):
        quantize.digests(spark.createDataFrame([(1, [1.0] * 9, 1)], "vec_id long, embedding array<float>, label int"))


def test_bounds_lose_no_nearest_entry():
    from paintgraph.llm import quantize

    g = np.random.default_rng(8)
    for d in (1, 2, 3, 6, 8, 16):
        for scale in (3, 4096, quantize.LIMIT // 2):
            x, book = g.integers(-scale, scale + 1, (300, d)), g.integers(-scale, scale + 1, (16, d))
            book[5], x[:20] = book[2], book[3]
            dist = ((x[:, None] - book) ** 2).sum(2)
            index, found = quantize.nearest(x, book)
            assert (index == dist.argmin(1)).all() and (found == dist.min(1)).all()
