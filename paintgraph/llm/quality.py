"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histograms of character classes and of its language's common words are compared with the
language's reference by Jensen-Shannon distance. References are gathered from all documents that pass the base
rules, by language; a fixed list of languages bounds them, so they can be broadcast. Guards: a text shorter than
`min_words` words isn't judged by divergence, only by the base rules.

Contract. Null and empty texts have no words and fail the base rules. An unknown or null language is judged
against the pooled reference of such rows. Repeated rows are judged alike. Empty table: empty result. A row's
other columns take no part; `filter_documents` returns them untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Common words of each language; other languages are pooled under "" without common words.
COMMON = {
    "de": "der die und in den von zu das mit ist für auf dem nicht ein eine".split(),
    "en": "the of and to in a is that for it was on with as by at".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
    "fr": "de la le et les des en un du une que est pour qui dans au".split(),
}
#: Classes of characters, each removed in turn; what is left is "other".
CLASSES = [("lower", r"[a-z]+"), ("upper", r"[A-Z]+"), ("space", r"[\x20\x09-\x0D]+"), ("digit", r"[0-9]+"), ("stop", r"[.,;:!?'\x22()\-]+"), ("symbol", r"[\x21-\x7E]+")]
#: A common-word distance may reach MAX_COMMON plus NOISE / sqrt(words), for a short text's histogram is a small sample.
MIN_WORDS, MAX_CLASS, MAX_COMMON, NOISE = 50, 0.30, 0.15, 2.0
N_COMMON = 16


def base_columns() -> list[Column]:
    """From text and words w: the counts of the base rules."""
    grams = F.transform(F.sequence(F.lit(0), F.size("_pg_w") - 3), lambda i: F.struct(F.xxhash64(F.get("_pg_w", i), F.get("_pg_w", i + 1), F.get("_pg_w", i + 2)).alias("h"), i.alias("i")))
    # in the sorted windows, those equal to a neighbour are repeated; let-bound by one-element arrays, so sorted once
    repeated = lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])), lambda x: x["i"]))
    words_in = lambda p: F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    starts = F.get(F.transform(F.array(F.sort_array(grams)), repeated), F.lit(0))
    lines = F.filter(F.split("_pg_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        F.size("_pg_w").cast("long").alias("n_words"),
        F.length(F.array_join("_pg_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_pg_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")), F.lit(0)).alias("n_dup_lines"),
        F.when(F.size("_pg_w") >= 4, words_in(starts)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    ]


def equals(k: str):
    return lambda x: x == k


def without(pattern: str):
    return lambda a: F.struct(a["t"].alias("t"), F.regexp_replace(a["t"], pattern, "").alias("r"), a["n"].alias("n"))


def measures(docs: DataFrame) -> DataFrame:
    """row (the whole row, so that no name of it clashes) and one struct `_pg_m`: language, base counts, both histograms. No shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.coalesce(F.col("text"), F.lit("")).alias("_pg_text"), F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("").alias("_pg_lang"))
    d = d.withColumn("_pg_w", F.regexp_extract_all("_pg_text", F.lit(WORD), 0))
    # each removal works on what the one before left, so the chain reads the text once
    chain = F.array(F.struct(F.col("_pg_text").alias("t"), F.array().cast("array<long>").alias("n")))
    for _, pattern in CLASSES:
        chain = F.transform(F.transform(chain, without(pattern)), lambda a: F.struct(a["r"].alias("t"), F.array_append(a["n"], (F.length(a["t"]) - F.length(a["r"])).cast("long")).alias("n")))
    classes = F.get(F.transform(chain, lambda a: F.array_append(a["n"], F.length(a["t"]).cast("long"))), F.lit(0))

    def counted(lang: str) -> Column:
        found = F.filter(F.transform("_pg_w", lambda x: F.lower(x)), lambda x: x.isin(*COMMON[lang]))
        return F.get(F.transform(F.array(found), lambda f: F.concat(F.array(*[F.size(F.filter(f, equals(k))).cast("long") for k in COMMON[lang]]), F.array((F.size("_pg_w") - F.size(f)).cast("long")))), F.lit(0))

    common = F.array(*[F.lit(0).cast("long")] * N_COMMON, F.size("_pg_w").cast("long"))
    for lang in COMMON:
        common = F.when(F.col("_pg_lang") == lang, counted(lang)).otherwise(common)
    d = d.withColumn("_pg_m", F.struct(F.col("_pg_lang").alias("lang"), *base_columns(), classes.alias("classes"), common.alias("common")))
    return d.drop("_pg_text", "_pg_lang", "_pg_w")


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def references(measured: DataFrame) -> DataFrame:
    """Summed histograms by language over all documents that pass the base rules: a row per language of COMMON and one."""
    m = F.col("_pg_m")
    sums = {c: [F.sum(m[c][i]) for i in range(n)] for c, n in (("classes", len(CLASSES) + 1), ("common", N_COMMON + 1))}
    return measured.where(~base_failed(m)).groupBy(m["lang"].alias("_pg_lang")).agg(*[F.array(*x).alias(f"_pg_{c}") for c, x in sums.items()])


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (base 2, 0 to 1) of two histograms, arrays of counts; 0 if either is empty."""
    share = lambda h: F.get(F.transform(F.array(F.aggregate(h, F.lit(0.0), lambda a, x: a + x)), lambda n: F.transform(h, lambda x: x / n)), F.lit(0))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    total = F.aggregate(F.zip_with(share(p), share(q), lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2)), F.lit(0.0), lambda a, x: a + x)
    filled = lambda h: F.exists(h, lambda x: x > 0)
    return F.when(filled(p) & filled(q), F.sqrt(F.greatest(F.lit(0.0), total / 2))).otherwise(0.0)


def judged(measured: DataFrame, ref: DataFrame, min_words: int, max_class: float, max_common: float) -> DataFrame:
    """Adds _pg_class_d, _pg_common_d (distances) and _pg_kept to a measured table, by a broadcast of at most five rows."""
    m = F.col("_pg_m")
    j = measured.join(F.broadcast(ref), m["lang"] == F.col("_pg_lang"), "left")
    distance = lambda c: F.coalesce(jensen_shannon(m[c], F.col(f"_pg_{c}")), F.lit(0.0))
    j = j.withColumns({"_pg_class_d": distance("classes"), "_pg_common_d": distance("common")})
    diverges = (m["n_words"] >= min_words) & ((F.col("_pg_class_d") > max_class) | (F.col("_pg_common_d") > max_common + NOISE / F.sqrt(m["n_words"])))
    return j.withColumn("_pg_kept", ~base_failed(m) & ~diverges)


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_class: float = MAX_CLASS, max_common: float = MAX_COMMON) -> DataFrame:
    """A row for each document: doc_id, the base counts, base_failed, kept, class_distance, common_distance."""
    measured = materialize(measures(docs).select(F.col("row.doc_id").alias("doc_id"), "_pg_m"), "measures")
    m, j = F.col("_pg_m"), judged(measured, references(measured), min_words, max_class, max_common)
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return j.select("doc_id", *counts, base_failed(m).alias("base_failed"), F.col("_pg_kept").alias("kept"), F.col("_pg_class_d").alias("class_distance"), F.col("_pg_common_d").alias("common_distance"))


def filter_documents(docs: DataFrame, min_words: int = MIN_WORDS, max_class: float = MAX_CLASS, max_common: float = MAX_COMMON) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The measured table is written once: references and verdicts read it, and no expression is worked out twice.
    """
    measured = materialize(measures(docs), "measured")
    kept = judged(measured, references(measured), min_words, max_class, max_common).where("_pg_kept")
    return kept.select("row.*")
