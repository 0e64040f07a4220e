"""Very long texts and tokens, repeated ids, clashing names and empty tables, for every operator and stage."""

import hashlib
import random

import pytest

rng = random.Random(31)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
sha = lambda b: hashlib.sha256(b).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key_0 string, row_0 string, ID_0 string, kept_0 string, _pg_w int, k long, b string, row string"


@pytest.fixture(scope="module")
def texts():
    long = prose(900_000)  # about 5 MB
    return [long, "ab" * 150_000, "q1$" * 20_000, "x\n" * 50_000, long[:3_000_000], *["repeated id " + prose(60)] * 3, prose(80), None, ""]


@pytest.fixture(scope="module")
def docs(spark, texts):
    ids = [0, 1, 2, 3, 4, 5, 5, 5, 5, 6, 7]
    return spark.createDataFrame([(i, t, "en", "s", 1, "a", "b", "c", "d", 1, 2, "e", "f") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark, texts):
    return spark.createDataFrame([(1, " ".join(texts[0].split()[500_000:500_030]))], "item_id long, text string")


def rows_of(name, docs, labels, bench):
    import public_tokenizers as P

    from paintgraph.llm import automaton_dedup, bpe, cnn, decontaminate, lines, neardup, quality, sharding, suffix_dedup, toxicity

    path = P.path("byte_bpe_50k.tiktoken")
    return {
        "quality": lambda: quality.judge(docs), "bpe": lambda: bpe.digests(docs, path, P.PATTERN), "suffix": lambda: suffix_dedup.digests(docs), "shards": lambda: sharding.assign(docs)[0],
        "automata": lambda: automaton_dedup.digests(docs), "network": lambda: cnn.classify(docs, labels), "toxicity": lambda: toxicity.classify(docs, labels), "lines": lambda: lines.digests(docs),
        "benchmark": lambda: decontaminate.digests(docs, bench), "near": lambda: neardup.near_duplicates(docs, 3, 85),
    }[name]()


@pytest.mark.parametrize("name", ["quality", "bpe", "suffix", "shards", "automata", "network", "toxicity", "lines", "benchmark", "near"])
def test_long_texts_and_repeated_ids(spark, docs, labels, bench, texts, name):
    got = rows_of(name, docs, labels, bench).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3, 4, 5, 5, 5, 5, 6, 7]
    one = {r.doc_id: r for r in got}
    if name == "quality":
        assert one[0].n_words == 900_000 and one[1].n_words == 1
    if name == "bpe":
        assert one[0].decoded_sha256 == sha(texts[0].encode()) and one[1].decoded_sha256 == sha(texts[1].encode())
    if name == "suffix":
        assert one[0].n_removed == 3_000_000 and one[4].n_removed == 3_000_000 and one[1].n_removed == 300_000
    if name == "automata":
        assert one[4].n_removed >= one[4].n_words - 1 and one[3].n_removed == 50_000
    if name == "benchmark":
        assert one[0].contaminated and one[0].longest == 30
    if name in ("network", "toxicity"):
        assert all(0 <= r.score <= 1 for r in got)
    if name == "near":
        assert one[5].component_id == 5 and one[0].component_id == 0


def test_stages_keep_columns_whatever_their_names(spark, docs, bench, tmp_path):
    import corpus_pipeline

    few = docs.where("doc_id >= 5")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, few, str(tmp_path))
        assert left.columns == docs.columns and left.count() <= few.count(), name
        assert stage(spark, few.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, few.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["quality", "bpe", "suffix", "shards", "automata", "network", "toxicity", "lines", "benchmark", "near"])
def test_empty_tables(docs, labels, bench, name):
    assert rows_of(name, docs.limit(0), labels, bench).count() == 0


def test_a_doc_id_of_many_rows_trains_once(spark):
    from pyspark.sql import functions as F

    from paintgraph.llm.cnn import sample

    docs = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert [tuple(r) for r in sample(docs, labels, "quality", F.lit(True), 10).select("doc_id", "y", "text").collect()] == [(1, 1, "t0")]


def test_texts_of_one_id_are_one_node(spark):
    from paintgraph.llm import neardup

    a, b, c = prose(80), prose(80), prose(80)
    docs = spark.createDataFrame([(3, a), (3, b), (1, b), (2, a), (9, c)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, 3, 85).collect()} == {(3, 1), (1, 1), (2, 1), (9, 9)}
