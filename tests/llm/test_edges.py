"""Cases at the edges: empty tables, clashing names, items of few words, few vectors, texts without letters or labels."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from agrarium.llm import op1_decontaminate, op3_byte_bpe, op4_simhash_dedup, op5_token_counts, op6_line_dedup, op7_substring_dedup, op8_suffix_dedup, op9_nearest, op10_language_id

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTER = op5_token_counts.json_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, lang string, row_key string, row_key2 string, _row_key string, _row_key2 string, keep int, _keep int, fingerprint string, n_tokens string"


@pytest.fixture(scope="module")
def clash(spark):
    line = "a line of more than forty characters that many documents share"
    rows = [(i, f"{line}\nand words of number {i} that nobody else has said before {i * 7}", "en", *"abcd", 5, 6, "f", "t") for i in range(8)]
    rows += [rows[0], (None, line, "en", *"abcd", 5, 6, "f", "t"), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, CLASH)


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert op3_byte_bpe.digests(none, BPE, public_tokenizers.PATTERN).count() == 0
    assert op3_byte_bpe.encoded(none, BPE, public_tokenizers.PATTERN).count() == 0
    assert op5_token_counts.token_counts(none, COUNTER).count() == 0
    for df in (op1_decontaminate.decontaminated(none, items(spark, "a b c d e f")), op6_line_dedup.deduplicated(none), op10_language_id.accepted(none)):
        assert df.columns == none.columns and df.count() == 0


def test_empty_benchmark(spark, clash):
    assert op1_decontaminate.decontaminated(clash, spark.createDataFrame([], "item_id long, text string"), short=True).count() == clash.count()


def test_empty_stages(spark, sf):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0


def test_clashing_names(spark, clash):
    own = lambda df: sorted(map(str, df.drop("text", "lang").distinct().collect()))
    want = own(clash)
    for df in (op6_line_dedup.deduplicated(clash), op4_simhash_dedup.representatives(clash), op1_decontaminate.decontaminated(clash, items(spark, "nothing of this is in there")), op10_language_id.accepted(clash)):
        assert df.columns == clash.columns and set(own(df)) <= set(want) and df.count() > 2
    kept = {r.doc_id: r.text for r in op6_line_dedup.deduplicated(clash).collect()}
    assert sum("more than forty" in (t or "") for t in kept.values()) == 1 and "more than forty" in kept[7]
    for digest in (op6_line_dedup.digests, op7_substring_dedup.digests, op8_suffix_dedup.digests):
        assert digest(clash).count() == clash.count()


def test_short_items(spark):
    text = "one Two three four. five six seven"
    found = op1_decontaminate.leaks(spark.createDataFrame([(1, text), (2, "one two")], "doc_id long, text string"), items(spark, "two three four", "three four five six", "three four five six seven", "seven one", "one two"), short=True)
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in found.collect()) == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (1, 4, 1.0), (2, 4, 1.0)]


def test_few_vectors_and_lengths(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(1, 60)] + [(100 + i, [float(i), 2.0]) for i in range(4)] + [(500, [1.0])]
    found = op9_nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {20, 40, 100}
    vectors = dict(rows)
    for q, got in by.items():
        near = sorted(((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in rows if i != q and len(v) == len(vectors[q])))[:3]
        assert [(k, i, s) for k, i, s in sorted(got)] == [(k, i, -s) for k, (s, i) in enumerate(near, 1)]


@pytest.mark.parametrize("text", ["² ½", "Ⅷ ①", "123 _ !", "", None])
def test_no_letter(spark, text):
    rows = [(i, "das ist ein Text", "de") for i in range(6)] + [(10, text, None), (11, "ein á", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in op10_language_id.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[10] == ("und", 0.0) and got[11][0] == "de"


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "1 2", None), (3, None, None), (4, "more", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in op10_language_id.accepted(docs).collect()) == [1, 4]


def test_predictions_by_hand(spark):
    """Whole predictions against longest matches found by search."""
    import math

    texts = {"aa": "the cat sat on the mat and the dog sat on the log with a frog", "bb": "le chat est sur le tapis et le chien est sur la table avec une grenouille", "cc": "der hund liegt auf dem teppich und die katze sitzt auf dem tisch"}
    learn = tuple((name, op10_language_id.letters(t)) for name, t in texts.items())
    tries = ["the log and the cat", "le tapis est sur la table", "Katze UND Hund!", "xyz żółw", "a", "cat chien hund " * 60, "q" * 1300]

    def phrases(data, known):
        n = i = 0
        while i < len(data):
            k = 1
            while i + k < len(data) and data[i : i + k + 1] in known:
                k += 1
            i, n = i + k, n + 1
        return n

    docs = spark.createDataFrame(list(enumerate(tries)), "doc_id long, text string")
    for r in op10_language_id.predict(docs, learn).collect():
        parts = op10_language_id.stretches(op10_language_id.letters(tries[r.doc_id]))
        cost = [sum(phrases(x, known) for x in parts) * math.log2(len(known)) for _, known in learn]
        first, second = sorted(cost)[:2]
        assert r.lang_pred == learn[cost.index(first)][0]
        assert abs(r.score - (1 - first / second)) < 1e-12
