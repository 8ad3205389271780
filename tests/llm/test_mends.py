"""Two texts of one doc_id, unequal counts, repeated labelled rows, ends of repeated spans."""

import random
from collections import Counter

from pyspark.sql import functions as F

from gaugeworks.llm import neardup, spans, toxicity

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def test_two_texts_of_one_doc_id_both_stay(spark):
    rng = random.Random(1)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(7, a, 0), (7, b, 1), (8, a.upper(), 2), (9, b + " more", 3), (10, a, 4), (10, a, 5), (7, a, 6), (None, a, 7), (None, a, 8), (6, " ", 9), (6, None, 10)]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _r int")).collect()
    assert Counter((r.doc_id, r.text) for r in kept if r.text and r.text.strip()) == {(7, a): 1, (7, b): 1, (None, a): 2} and len(kept) == 5


def test_equal_sets_of_unlike_counts_are_linked(spark):
    """One text repeats a phrase of eight words, the other one has it once."""
    rng = random.Random(2)
    for times in (20, 50, 200):
        rows = []
        for i in range(0, 240, 2):
            head, phrase, tail = words(rng, 60), words(rng, 8), words(rng, 60)
            again = " ".join([phrase] * times)
            rows += [(i, f"{head} {phrase} {phrase} {tail}"), (i + 1, f"{head} {again} {tail}")]
        got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        linked = sum(r.class_id == r.doc_id - 1 for r in got if r.doc_id % 2)
        assert linked >= 0.95 * 120 and all(r.class_id == r.doc_id for r in got if r.doc_id % 2 == 0)


def test_sample_is_bounded_by_rows(spark):
    docs = spark.range(40).withColumnRenamed("id", "doc_id").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("k")).selectExpr("doc_id", "if(doc_id % 2 = 0, 'same', concat('text ', k)) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    got = toxicity.sample(docs, labels, 15).collect()
    assert len(got) == len({r.doc_id for r in got}) == 15 and all(r.text == "same" or r.doc_id % 2 for r in got)


def removed(docs):
    """Sentences in a run of several with MIN_WORDS words that stands earlier, or of LONE_WORDS alone; all runs, whatever their length."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        parts = spans.sentences(text)
        gone = set()
        for i in range(len(parts)):
            for j in range(i, len(parts)):
                run = tuple(" ".join(parts[i : j + 1]).lower().split())
                if not (len(run) >= spans.LONE_WORDS if i == j else len(run) >= spans.MIN_WORDS):
                    continue
                if run in seen:
                    gone |= set(range(i, j + 1))
                seen.add(run)
        out[doc] = parts, gone
    return out


def test_repeated_spans_go_to_their_ends(spark):
    rng = random.Random(3)
    pool = [[words(rng, rng.choice([2, 3, 5, 9, 20, 45])).capitalize() + rng.choice([". ", "!\n", "? "]) for _ in range(rng.randint(2, 6))] for _ in range(12)]
    docs = []
    for i in range(80):
        body = [words(rng, rng.choice([1, 4, 12])).capitalize() + ". " for _ in range(rng.randint(0, 4))]
        for span in rng.sample(pool, 2):
            body[rng.randint(0, len(body)) : 0] = span[rng.randint(0, 1) :]
        docs.append((i, "".join(body).strip()))
    docs += [(90, f"{words(rng, 20)}. Ab cd. Ef gh ij."), (91, "")]
    docs.append((92, docs[80][1] + " Other words."))
    want = removed(docs)
    assert want[92][1] == {0, 1, 2}
    got = {r.doc_id: r for r in spans.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    for doc, (parts, gone) in want.items():
        r = got[doc]
        assert {k for s in r.spans for k in range(s.start, s.end)} == gone and r.n_removed == len(gone)
        assert r.text == "".join(p for k, p in enumerate(parts) if k not in gone)
    assert sum(len(g) for _, g in want.values()) > 100
