"""Cases in which an operator once did less than its whole job."""

import random

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))


def test_copies_of_a_toxic_document_hide_no_insult(spark):
    from paintgraph.llm import toxicity

    clean = [(i, prose(60), 0) for i in range(220)]
    toxic = [(300 + i, prose(30) + " idiot " + prose(30), 1) for i in range(80)]
    copied = prose(60)
    rows = [*clean, *toxic, *[(500 + i, copied, 1) for i in range(120)]]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert "idiot" in toxicity.fit(docs, labels).weights


def test_a_word_also_in_clean_rows_hides_no_insult_in_any_sample(spark):
    from paintgraph.llm import toxicity

    for n in (1, 10, 1000):
        words = [("insult", 300 * n, 0), ("mixed", 500 * n, 100 * n), ("language", 60, 8), ("plain", 900 * n, 1000 * n)]
        per_word = spark.createDataFrame(words, "word string, bad long, good long")
        w = {r.word: r.w for r in toxicity.telling(per_word, {1: 6000 * n, 0: 6000 * n}).collect()}
        assert "insult" in w and not {"language", "plain"} & set(w) and w["insult"] == max(w.values())


def later_runs(texts):
    """Plain Python: each text without its lines in later occurrences of repeated runs of lines (or chunks)."""
    from paintgraph.llm import lines

    first, out = set(), {}
    for i, text in sorted(texts.items()):
        own, lost = text.encode().split(b"\n"), set()
        worded = [n for n, x in enumerate(own) if x.split()]
        spans = [("chunk", s, e) for s, e in lines.chunk_lines(own) if e - s > 1] + [("run", a, b + 1) for a, b in zip(worded, worded[1:], strict=False)]
        for kind, s, e in spans:
            body = (kind, tuple(own[s:e]))
            if body in first:
                lost.update(range(s, e))
            first.add(body)
        out[i] = b"\n".join(x for n, x in enumerate(own) if n not in lost).decode()
    return out


def test_short_passages_inside_documents_go_whole(spark):
    import corpus_pipeline

    passages = [[prose(12) for _ in range(n)] for n in (2, 3, 5, 5, 10, 10, 20, 20)]
    own = lambda: [prose(9) for _ in range(rng.randint(1, 5))]
    texts = {i: "\n".join(own() + passages[i % 8] + own() + [""] * (i % 3) + passages[(3 * i + 1) % 8] + own()) for i in range(60)}
    texts |= {100: "one line alone\n\n\n" + prose(5), 101: prose(5) + "\none line alone\n\n\n", 102: "\n".join(["again"] * 5 + ["end"]), 103: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {i: x for i, x in later_runs(texts).items() if x.split() or not texts[i].split()}
    whole = "\n".join(got.values()).split("\n")
    assert all(whole.count(line) == 1 for p in passages for line in p)
    assert {x for t in texts.values() for x in t.split("\n")} == set(whole)
