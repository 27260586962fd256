"""Each stage of the pipeline against brute force over all documents of the smallest tables."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import regex
import xxhash

from agrarium.llm import op10_language_id

STAGES = dict(corpus_pipeline.STAGES)


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output rows of each stage."""
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), {}
    before = rows(docs)
    for name, stage in corpus_pipeline.STAGES:
        after = rows(stage(spark, docs, sf))
        found[name] = before, after
        if name != corpus_pipeline.STAGES[-1][0]:
            docs, before = spark.createDataFrame([tuple(r.values()) for r in after], docs.schema), after
    return found


def by_id(found):
    return sorted(found, key=lambda r: r["doc_id"])


def test_language_id(spark, sf, stages):
    before, after = stages["language_id"]
    assert [r["doc_id"] for r in by_id(after)] == [r["doc_id"] for r in by_id(before) if regex.search(r"\p{L}", r["text"] or "")]
    learn = op10_language_id.samples(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), 40, 120_000)

    def phrases(data, known):
        n = i = 0
        while i < len(data):
            k = 1
            while i + k < len(data) and data[i : i + k + 1] in known:
                k += 1
            i, n = i + k, n + 1
        return n

    for r in sorted(after, key=lambda r: len(r["text"]))[:: max(1, len(after) // 60)]:
        parts = op10_language_id.stretches(op10_language_id.letters(r["text"]))[:12]
        if len(parts) < 12:
            cost = [sum(phrases(x, known) for x in parts) * math.log2(len(known)) for _, known in learn]
            assert r["lang"] == learn[cost.index(min(cost))][0]
    same = {r["doc_id"]: (r["text"], r["source"]) for r in before}
    assert all(same[r["doc_id"]] == (r["text"], r["source"]) for r in after)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    held = defaultdict(set)
    for r in before:
        for x in (r["text"] or "").split("\n"):
            held[key(x)].add(r["doc_id"])
    want = {}
    for r in before:
        kept = [x for x in (r["text"] or "").split("\n") if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and r["doc_id"] != max(held[key(x)]))]
        want[r["doc_id"]] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_simhash_dedup(stages):
    before, after = stages["simhash_dedup"]

    def fingerprint(text):
        words = [w.decode() for w in (text or "").encode().lower().split()]
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if words else 0

    fps = {r["doc_id"]: fingerprint(r["text"]) for r in before}
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r["doc_id"] for r in after) == sorted(i for i in ids if find(i) == i)


def test_decontaminate(spark, sf, stages):
    before, after = stages["decontaminate"]

    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    items = [(Counter(s), len(s)) for (t,) in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect() if (s := shingles(t))]

    def leaks(text):
        s = shingles(text)
        every = set(s)
        for item, n in items:
            if not every & set(item):
                continue
            w = min(n, len(s))
            for p in range(len(s) - w + 1):
                shared = (Counter(s[p : p + w]) & item).total()
                if shared / (n + w - shared) >= 0.8:
                    return True
        return False

    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not leaks(r["text"]))


def test_byte_bpe(stages):
    import tiktoken

    before, after = stages["byte_bpe"]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(r["text"])) for r in before for ids in (own.encode_ordinary(r["text"]),))
    assert sorted(tuple(r.values()) for r in after) == want
