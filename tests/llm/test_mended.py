"""Short items in short texts, labelled rows without ids or with equal ones, memos by size, and many candidates in one text."""

import time

import public_tokenizers
import pytest

from agrarium.llm import op1_decontaminate as op1
from agrarium.llm import op2_secret_scan as op2
from agrarium.llm import op3_byte_bpe as op3
from agrarium.llm import op10_language_id as op10


def test_short_items_stand_in_short_texts(spark):
    items = spark.createDataFrame([(1, "two words"), (2, "one"), (3, "a b c d")], "item_id long, text string")
    texts = ["two words more", "x two words more", "two words", "Two, words!", "one", "just one here now", "a b c d", "x a b c d", "a b c", "one two words a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in op1.leaks(docs, items, short=True).collect())
    words = [op1.words_of(t) for t in texts]
    own = {1: ["two", "words"], 2: ["one"], 3: list("abcd")}
    want = sorted((d, i) for d, w in enumerate(words) for i, x in own.items() if any(w[k : k + len(x)] == x for k in range(len(w))))
    assert found == want
    plain = sorted((r.doc_id, r.item_id) for r in op1.leaks(docs, items).collect())
    assert plain == sorted((d, i) for d, w in enumerate(words) for i, x in own.items() if w == x)


@pytest.mark.parametrize("doc_id", ["null", "7", "id"])
def test_labelled_rows_without_ids_or_with_equal_ones_teach(spark, doc_id):
    rows = spark.range(2_000).selectExpr(f"cast({doc_id} as long) doc_id", "if(id % 2 = 0, concat('der hund und die katze ', id), concat('the dog and a cat ', id)) text", "if(id % 2 = 0, 'de', 'en') lang")
    texts = op10.samples(rows, 40, 120_000)
    assert [lang for lang, _ in texts] == ["de", "en"] and all(len(x) > 400 for _, x in texts)
    found = op10.languages(rows).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in found} == {"de": 1_000, "en": 1_000}


def test_copies_teach_once(spark):
    rows = spark.range(3_000).selectExpr("id doc_id", "if(id < 2900, 'the same text', concat('other text ', id)) text", "'en' lang")
    ((_, text),) = op10.samples(rows, 40, 120_000)
    assert text.count(b"same") <= 1 and text.count(b"other") >= 35


def test_long_pieces_are_not_remembered():
    from public_tokenizers import PATTERN, path

    codec = op3.Codec(path("byte_bpe_multi_50k.tiktoken"), PATTERN)
    text = " ".join("x" * n for n in range(1, 300))
    ids = codec.encode(text)
    assert codec.decode(ids) == text.encode() and codec.decode_pieces(codec.encode_pieces(text)) == text.encode()
    assert max(map(len, codec.ids)) <= 64 and max(map(len, codec.decimals)) <= 64 and max(map(len, codec.bytes)) <= 384
    assert public_tokenizers.PATTERN == PATTERN


def test_many_candidates_beside_many_base_spans():
    text = " ".join(f"{i:040x} Zk{i:06d}QmVx83LpTw0Rj{i:05d}uYbN" for i in range(8_000))
    base = op2.base_spans(text)
    began = time.time()
    found = op2.candidates(text, base, 0.01)
    assert time.time() - began < 20
    assert not any(s <= a and b <= e for a, b, *_ in found[:50] for s, _, e in base)
