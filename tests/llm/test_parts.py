"""Parts of the operators against plain forms of them: paths, gradients, maps, matches, crowded anchors, the pipeline."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

rng = random.Random(23)
WORDS = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(2, 8))) for _ in range(900)]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
sha = lambda b: hashlib.sha256(b).hexdigest()


# --- toxicity


@pytest.fixture(scope="module")
def decoder():
    from paintgraph.llm.toxicity import BASE, Decoder

    r = random.Random(1)
    return Decoder([(r.randrange(BASE**3), r.randint(1, 900)) for _ in range(4000)])


def cost_of(decoder, letters):
    x = y = 0
    total = 0.0
    for ch in letters:
        z = decoder.code(ch)
        total += decoder.cost[x][y][z]
        x, y = y, z
    return total + decoder.cost[x][y][0]


def run_at(text, i):
    return sum(1 for _ in itertools.takewhile(lambda c: c == text[i], text[i:]))


def all_paths(decoder, text, i=0):
    if i >= len(text):
        yield "", 0.0
        return
    for to, put, extra in decoder.arcs(text, i, run_at(text, i)):
        for rest, cost in all_paths(decoder, text, to):
            yield put + rest, extra + cost


@pytest.mark.parametrize("text", ["1d10t", "i.d.i.o.t", "heeeello", "sc*m", "a$$", "00", "b@d--w0rd", "!!!", "x", "ñ4é", "…"])
def test_decoding_finds_the_best_of_all_paths(decoder, text):
    best = min(cost + cost_of(decoder, letters) for letters, cost in all_paths(decoder, text))
    got = decoder.decode(text)
    assert math.isclose(min(cost for letters, cost in all_paths(decoder, text) if letters == got) + cost_of(decoder, got), best, rel_tol=1e-9)


def plain_decode(decoder, text):
    """One table over all places."""
    at = [{} for _ in range(len(text) + 1)]
    at[0][0, 0] = (0.0, None, None)
    for i in range(len(text)):
        for (a, b), (cost, *_) in at[i].items():
            for to, put, extra in decoder.arcs(text, i, run_at(text, i)):
                x, y, total = a, b, cost + extra
                for ch in put:
                    z = decoder.code(ch)
                    total += decoder.cost[x][y][z]
                    x, y = y, z
                if (x, y) not in at[to] or total < at[to][x, y][0]:
                    at[to][x, y] = (total, put, (i, (a, b)))
    end = min(at[-1], key=lambda s: at[-1][s][0] + decoder.cost[s[0]][s[1]][0])
    place, state, out = len(text), end, []
    while (step := at[place][state])[2] is not None:
        out.append(step[1])
        place, state = step[2]
    return "".join(reversed(out))


def test_long_tokens_are_decoded_by_blocks_alike(decoder):
    from paintgraph.llm import toxicity

    r = random.Random(4)
    text = "".join(r.choice(["a", "b", "1", "0", "$", "-", "zzz", "....", "5"]) for _ in range(9000))
    assert len(text) > toxicity.BLOCK and decoder.decode(text) == plain_decode(decoder, text)
    jump = "ab1" + "." * (3 * toxicity.BLOCK) + "c0d"
    assert decoder.decode(jump) == plain_decode(decoder, "ab1....c0d")


def test_stars_stand_for_letters_of_known_words(decoder):
    from paintgraph.llm.toxicity import Model

    m = Model(decoder, {"scam": 2.0, "idiot": 3.0, "scum": 1.0}, np.array([0.0, 1, 1, 1]))
    assert m.weighted({"sc*m"}) == [2.0, 1.0] and m.weighted({"1d*0t"}) == [3.0]
    assert m.weighted({"****", "s***", "sc*mm"}) == []


# --- network


def test_gradients_are_differences():
    from paintgraph.llm import cnn

    r = np.random.default_rng(3)
    net = cnn.Network(r)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, doc, y = r.integers(1, 256, (5, cnn.CHUNK)).astype(np.uint8), np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        own = np.bincount(doc)
        z = np.bincount(doc, net.logits(x)) / own
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = net.gradients(x, doc, y)
    for k, p in net.p.items():
        flat, g = p.reshape(-1), np.asarray(grads[k]).reshape(-1)
        picks = np.argsort(-np.abs(g))[:6]
        for i in picks:
            old, eps = flat[i], 1e-5
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert math.isclose((up - down) / (2 * eps), g[i], rel_tol=2e-3, abs_tol=1e-7), (k, i)


def test_slices_of_a_long_text_give_its_gradient(monkeypatch):
    from paintgraph.llm import cnn

    r = np.random.default_rng(5)
    net = cnn.Network(r)
    x = cnn.chunks_of(bytes(r.integers(1, 256, 9000).astype(np.uint8)))
    whole = net.gradients(x, np.zeros(len(x), int), np.array([1.0], np.float32))
    monkeypatch.setattr(cnn, "SLICE", 4)
    parts = net.gradients(x, np.zeros(len(x), int), np.array([1.0], np.float32))
    assert all(np.allclose(whole[k], parts[k], atol=1e-5) for k in whole)


# --- shards


def test_bytes_are_shared_out_by_the_stored_map(spark, tmp_path):
    from pyspark.sql import functions as F

    from paintgraph.llm import sharding

    docs = spark.createDataFrame([(i, prose(rng.randint(1, 60))) for i in range(3000)] + [(7, "equal"), (7, "equal"), (8, "equal"), (None, None)], "doc_id long, text string")
    path = str(tmp_path / "map")
    placed, stored = sharding.assign(docs, path, n_slots=512)
    load = {r.shard: r.b for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 16
    newest = {r.vslot: r.shard for r in stored.where("version = 1").collect()}
    assert all(newest[r.vslot] == r.shard for r in placed.collect())
    first = {r.vslot: r.shard for r in stored.where("version = 0").collect()}
    assert first == {s: s % 16 for s in range(512)}

    more = docs.union(spark.createDataFrame([(10_000 + i, prose(300)) for i in range(200)], "doc_id long, text string"))
    again, stored = sharding.assign(more, path, n_slots=512)
    assert sorted(r.version for r in stored.select("version").distinct().collect()) == [0, 1, 2] and stored.count() == 3 * 512
    assert {r.vslot: r.shard for r in stored.where("version = 1").collect()} == newest  # older versions stay
    load = {r.shard: r.b for r in again.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert max(load.values()) - min(load.values()) <= 0.05 * sum(load.values()) / 16
    moved = sum(newest[s] != h for s, h in {r.vslot: r.shard for r in stored.where("version = 2").collect()}.items())
    assert 0 < moved < 256  # edited, not dealt anew
    for shard in range(16):
        slots = sorted(r.slot for r in again.where(F.col("shard") == shard).collect())
        assert slots == list(range(len(slots)))


# --- repeated windows


def removed(parts, length):
    seen = collections.Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    out = []
    for p in parts:
        gone = bytearray(len(p))
        for i in range(len(p) - length + 1):
            if seen[p[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(gone))
    return out


def crowd():
    """A passage in more texts than a resolver takes at once, each time among other words; some of them twice."""
    from paintgraph.llm import repeats

    passage = prose(75)
    texts = [prose(rng.randint(3, 9)) + " " + passage + " " + prose(rng.randint(3, 9)) for _ in range(repeats.MOST + 120)]
    return texts + texts[:40] + [" ".join(x.split()[2:60]) for x in texts[40:60]]


def test_crowded_anchors(spark):
    from paintgraph.llm import automaton_dedup, suffix_dedup

    texts = crowd()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words = [tuple(t.encode().split()) for t in texts]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in automaton_dedup.digests(docs).collect()}
    for i, (p, g) in enumerate(zip(words, removed(words, 35), strict=True)):
        assert got[i] == (len(p), sum(g), sha(b" ".join(w for w, z in zip(p, g, strict=True) if not z)))
    parts = [t.encode() for t in texts]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect()}
    for i, (p, g) in enumerate(zip(parts, removed(parts, 400), strict=True)):
        assert got[i] == (len(p), sum(g), len(re.findall(b"\1+", g)), sha(bytes(c for c, z in zip(p, g, strict=True) if not z)))


# --- benchmark matches


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_matches_are_followed_to_their_ends(spark, block):
    from paintgraph.llm import decontaminate as D

    items = [(1, prose(40)), (2, prose(25)), (3, "short item here"), (4, prose(12))]
    w = {i: t.split() for i, t in items}
    texts = [prose(5) + " " + " ".join(w[1][3:30]) + " " + prose(4), " ".join(w[1]) + " " + " ".join(w[2][5:20]), prose(9) + " short item here " + prose(3), " ".join(w[2][:9]) + " " + prose(20), " ".join(w[4]) + " " + " ".join(w[4]), None, prose(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: sorted((m["item"], m["item_place"], m["place"], m["length"]) for m in r.matches) for r in D.contamination(docs, bench, block_bytes=block).collect()}
    for d, t in enumerate(texts):
        own, want = D.words_of((t or "").encode()), []
        for i, x in items:
            item = D.words_of(x.encode())
            for a in range(len(item)):
                for p in range(len(own)):
                    n = 0
                    while a + n < len(item) and p + n < len(own) and item[a + n] == own[p + n]:
                        n += 1
                    if n >= min(10, len(item)) and not (a and p and item[a - 1] == own[p - 1]):
                        want.append((str(i), a, p, n))
        assert got[d] == sorted(want), d


def test_suffixes_are_sorted_to_the_longest_item():
    from paintgraph.llm.decontaminate import SuffixArray

    r = random.Random(2)
    ids = np.array([r.choice([0, 1, 1, 1, 2]) for _ in range(400)] + [1] * 60 + [0] + [1] * 55)
    array = SuffixArray(ids, 3, 1, 50)
    suffix = lambda p: ids[p : p + next(n for n in range(len(ids) - p + 1) if p + n == len(ids) or ids[p + n] == 0)].tolist()[:51]
    order = [suffix(p) for p in array.places.tolist()]
    assert order == sorted(order) and len(order) == int((ids > 0).sum())


# --- tokens


def test_other_patterns_are_honoured():
    import public_tokenizers as P

    from paintgraph.llm import bpe

    c = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), r"[\s\S]")
    assert c.split("abc def") == list("abc def") and c.decode(c.encode(["abc d"])[0]) == b"abc d" and len(c.encode(["abc d"])[0]) == 20
    c = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "x" * 200_000 + " " + "ab " * 10
    assert c.decode(c.encode([text])[0]) == text.encode() and all(len(w) <= bpe.MEMO_LONGEST for w in c.memo)


# --- pipeline


def divergence(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    half = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    return math.sqrt(max(0.0, (half(p) + half(q)) / 2))


def kept_by_rules(rows):
    from paintgraph.llm import quality as Q

    found = {}
    for i, text, lang in rows:
        t, lang = text or "", lang if lang in Q.COMMON else ""
        w, classes, rest = re.findall(r"[^\x20\x09-\x0D]+", t), [], t
        for _, pattern in Q.CLASSES:
            left = re.sub(pattern, "", rest)
            classes.append(len(rest) - len(left))
            rest = left
        low = collections.Counter(x.lower() for x in w)
        common = [low[k] for k in Q.COMMON[lang]] if lang else [0] * Q.N_COMMON
        grams = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeats = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
        found[i] = (lang, len(w), [*classes, len(rest)], [*common, len(w) - sum(common)], len(w) < 50 or 100 * len(repeats) > 50 * len(w))
    ref = collections.defaultdict(lambda: ([0] * (len(Q.CLASSES) + 1), [0] * (Q.N_COMMON + 1)))
    for lang, _, classes, common, failed in found.values():
        if not failed:
            ref[lang] = tuple([a + b for a, b in zip(x, y, strict=True)] for x, y in zip(ref[lang], (classes, common), strict=True))
    out = set()
    for i, (lang, n, classes, common, failed) in found.items():
        far = n >= Q.MIN_WORDS and (divergence(classes, ref[lang][0]) > Q.MAX_CLASS or divergence(common, ref[lang][1]) > Q.MAX_COMMON + Q.NOISE / math.sqrt(n))
        if not failed and not far:
            out.add(i)
    return out


def english(n):
    from paintgraph.llm.quality import COMMON

    return " ".join(rng.choice(COMMON["en"]) if rng.random() < 0.4 else rng.choice(WORDS) for _ in range(n))


def test_pipeline_against_its_stages_written_out(spark, tmp_path):
    import base64

    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline
    from test_whole_jobs import later_runs

    base = [english(rng.randint(60, 160)) for _ in range(40)]
    lines = lambda n: "\n".join(english(12) for _ in range(n))
    shared = lines(4)
    near = base[3].split()
    near[50] = "changed"
    item = english(30)
    texts = [*base, base[0], base[0], " ".join(near), *[lines(6) + "\n" + shared + "\n" + lines(3) for _ in range(6)], english(80) + " " + item + " " + english(80), english(90) + " " + " ".join(item.split()[4:16]), "short", None, "", "#$% " * 90, "same words " * 60, *["".join(rng.choice("0123456789 ") for _ in range(900)) for _ in range(3)]]
    rows = [(i, t, "en" if i % 9 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    stay = kept_by_rules([r[:3] for r in rows])
    now = {r[0]: r[1] for r in rows if r[0] in stay}
    assert 0 < len(now) < len(rows) - 5
    cut = later_runs({i: t for i, t in now.items() if t is not None})
    now = {i: cut[i] for i in now if cut[i].split() or not now[i].split()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for i, t in now.items()}
    parent = {i: i for i in now}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(now), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    now = {i: t for i, t in now.items() if root(i) == i}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    w = words(item)
    windows = {tuple(w[j : j + 10]) for j in range(len(w) - 9)}
    now = {i: t for i, t in now.items() if not any(tuple(v[j : j + 10]) in windows for v in [words(t)] for j in range(len(v) - 9))}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: np.array(e.encode_ordinary(t), "<u4").tobytes() for i, t in now.items()}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: bytes(r.ids) for r in got} == want and len(got) == len(want)
    assert all(r.ids_sha256 == sha(want[r.doc_id]) and r.decoded_sha256 == sha(now[r.doc_id].encode()) and r.n_tokens * 4 == len(want[r.doc_id]) for r in got)
