"""The queries of the operators of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .common import table


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    q = quality.judge(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[F.round(c, 6).alias(c) for c in ("class_distance", "common_distance")])


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    ship(spark)
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    ship(spark)
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.assign(table(spark, sf_dir, "documents"))[0]


def op5_suffix_automata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import automaton_dedup

    ship(spark)
    return automaton_dedup.digests(table(spark, sf_dir, "documents"))


def op6_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import cnn

    ship(spark)
    return cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    ship(spark)
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    ship(spark)
    return lines.digests(table(spark, sf_dir, "documents"))


def op9_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    ship(spark)
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_minhash_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    ship(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op11_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    ship(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import resampling

    ship(spark)
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quantize

    ship(spark)
    return quantize.digests(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w)-33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i+35)) AS p FROM win WHERE s IN (SELECT s FROM again))),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w)+1)) AS p FROM d WHERE len(w) > 0),
left_over AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)"""

OP8 = r"""
WITH l AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a)+1)) AS p, len(a) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h0 FROM l),
b AS (SELECT *, (h0 + 3*coalesce(lag(h0) OVER o, 0) + 5*coalesce(lag(h0, 2) OVER o, 0)) % 97 < 24 AS stop FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
c AS (SELECT *, coalesce(sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM b),
k AS (SELECT doc_id, i, count(*) AS n_in, string_agg(line, chr(10) ORDER BY p) AS body FROM c GROUP BY 1, 2),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, n_in, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS r FROM k WHERE n_in >= 2) WHERE r > 1),
kept AS (SELECT c.doc_id, string_agg(line, chr(10) ORDER BY p) AS t, count(*) AS n FROM c ANTI JOIN g ON c.doc_id = g.doc_id AND c.i = g.i GROUP BY 1),
total AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines, 0) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, i AS j, array_to_string(w[i:i+9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w)-8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i+size-1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w)-size+2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, i, j, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.s = bw.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i+size)) AS p FROM m) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1),
runs AS (SELECT doc_id, count(*) + any_value(size) - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS g FROM m) GROUP BY doc_id, item_id, i - j, g),
long AS (SELECT doc_id, max(n) AS n FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(long.n, 0) AS longest FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN long USING (doc_id)"""

OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2*i+1, 800)) AS s FROM (SELECT doc_id, x, unnest(range(0, n-399)) AS i FROM d WHERE n >= 400)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM again)),
marked AS (SELECT *, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 400, -1) AS new FROM hit),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
sums AS (SELECT doc_id, sum(z-a) AS removed, count(*) AS spans, string_agg(substr(x, 2*before+1, 2*(a-before)), '' ORDER BY a) AS kept, max(z) AS last FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2*coalesce(last, 0)+1))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)-1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100*k >= 85*(x.n+y.n-k)),
t AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT t.v, r.root FROM r JOIN t ON t.u = r.node WHERE r.root < t.v),
l AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l ON l.node = d.doc_id"""


OP12 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
m AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d) GROUP BY 1, 2),
crc AS (SELECT list(x ORDER BY i) AS r FROM (SELECT i, list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, i) AS x FROM range(0, 256) t(i))),
v AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM m UNION SELECT f FROM b)),
y AS (SELECT f, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2*i+1:2*i+2] AS BIGINT)) AS bytes FROM v),
k AS (SELECT f, xor(list_reduce(bytes, lambda a, c: xor(a >> 8, r[(xor(a, c) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM y, crc),
s AS (SELECT bucket, sum(n) AS n FROM m JOIN k USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM b JOIN k USING (f) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000*ln((coalesce(t.n, 0)+1)::DOUBLE*((SELECT coalesce(sum(n), 0) FROM s)+10000)::DOUBLE/((s.n+1)::DOUBLE*((SELECT coalesce(sum(n), 0) FROM t)+10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
e AS (SELECT doc_id, CAST(sum(n*gain) AS BIGINT) AS weight FROM m JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
z AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000*ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT)+0.5::DOUBLE)/4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN e USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT z.*, rank FROM z LEFT JOIN (SELECT doc_id, rank FROM o WHERE rank <= 10*n // 100) USING (doc_id)"""


def _op13_sql() -> str:
    """Six rounds of assignment and means over parts, written out one after another."""
    from .quantize import ENTRIES, PARTS, ROUNDS, SCALE

    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS (SELECT row, p, e, dist FROM (SELECT x.row, p, e, sum((x.v-c.v)*(x.v-c.v)) AS dist, row_number() OVER (PARTITION BY x.row, p ORDER BY sum((x.v-c.v)*(x.v-c.v)), e) AS r FROM x JOIN c{r} c USING (p, j) GROUP BY x.row, p, e) WHERE r = 1)")
        if r < ROUNDS:
            steps.append(f"m{r} AS (SELECT p, e, j, sum(v)::BIGINT AS s, count(*) AS n FROM a{r} JOIN x USING (row, p) GROUP BY 1, 2, 3)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, j, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{r} LEFT JOIN m{r} USING (p, e, j))")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row, (i-1) // d AS p, (i-1) % d AS j, CAST(floor({SCALE}*embedding[i]::DOUBLE) AS BIGINT) AS v FROM (SELECT row, embedding, len(embedding) // {PARTS} AS d, unnest(range(1, len(embedding)+1)) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT p, row-1 AS e, j, v FROM x WHERE row <= {ENTRIES}),
{", ".join(steps)},
codes AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1),
book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN codes USING (row), book"""


def _op1_sql() -> str:
    """The counts, both histograms, the references of each language and the two distances."""
    from .quality import CLASSES, COMMON, MAX_CLASS, MAX_COMMON, MIN_WORDS, N_COMMON, NOISE

    langs = ", ".join(f"'{x}'" for x in COMMON)
    chain, last = [], "t"
    for i, (_, pattern) in enumerate(CLASSES):
        chain.append(f"r{i} AS (SELECT *, regexp_replace({last}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS t{i} FROM {'d' if i == 0 else f'r{i - 1}'})")
        last = f"t{i}"
    names = ["t", *[f"t{i}" for i in range(len(CLASSES))]]
    classes = "[" + ", ".join([f"length({a})-length({b})" for a, b in zip(names, names[1:], strict=False)] + [f"length({names[-1]})"]) + "]"
    common = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(f'len(list_filter(low, lambda x: x = {chr(39)}{w}{chr(39)}))' for w in words)}]" for k, words in COMMON.items()) + f" ELSE [{', '.join(['0'] * N_COMMON)}] END"
    arrays = lambda c, n: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, n + 1)) + "]"
    term = "CASE WHEN {x} > 0 THEN {x}*log2({x}/(({x}+{y})/2)) ELSE 0 END"
    both = f"({term.format(x='z[1]', y='z[2]')}) + ({term.format(x='z[2]', y='z[1]')})"
    share = lambda h: f"list_transform({h}, lambda x: x/list_sum({h})::DOUBLE)"
    distance = lambda p, q: f"CASE WHEN list_sum({p}) > 0 AND coalesce(list_sum({q}), 0) > 0 THEN sqrt(greatest(0.0, list_sum(list_transform(list_zip({share(p)}, {share(q)}), lambda z: {both}))/2)) ELSE 0 END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({langs}) THEN lang ELSE '' END AS lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
{", ".join(chain)},
c AS (SELECT *, list_transform(w, lambda x: lower(x)) AS low, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, {classes} AS classes FROM r{len(CLASSES) - 1}),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS a FROM (SELECT doc_id, w, unnest(range(1, len(w)-1)) AS i FROM d WHERE len(w) >= 4))),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM g WHERE n > 1) GROUP BY 1),
e AS (SELECT c.*, {common} AS few, len(w) AS n_words, coalesce(h.n, 0) AS n_repeat_words FROM c LEFT JOIN h USING (doc_id)),
m AS (SELECT *, list_append(few, n_words - list_sum(few)) AS common, n_words < 50 OR 100*n_repeat_words > 50*n_words AS base_failed FROM e),
ref AS (SELECT lang, {arrays("classes", len(CLASSES) + 1)} AS rc, {arrays("common", N_COMMON + 1)} AS rw FROM m WHERE NOT base_failed GROUP BY 1),
j AS (SELECT m.*, {distance("classes", "rc")} AS cd, {distance("common", "rw")} AS wd FROM m LEFT JOIN ref USING (lang))
SELECT doc_id, n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines)-len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND NOT (n_words >= {MIN_WORDS} AND (cd > {MAX_CLASS} OR wd > {MAX_COMMON} + {NOISE}/sqrt(n_words))) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS common_distance FROM j"""


def oracle_sql() -> dict[str, str]:
    """The others hold learned models, tokenizers or a driver-made slot map: tests/llm compare op2, op4 and op11 with plain
    Python, op6 and op7 by held-out rows and part by part, the pipeline with its stages written out."""
    return {"op1_quality_divergence": _op1_sql(), "op3_suffix_array_dedup": OP3, "op5_suffix_automata_dedup": OP5, "op8_line_chunks": OP8, "op9_suffix_array_decontamination": OP9, "op10_minhash_sketches": OP10, "op12_importance_resampling": OP12, "op13_vector_codes": _op13_sql()}
