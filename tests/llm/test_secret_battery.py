"""Secrets of every encoding and length among names: recall and false discoveries; pattern spans against a second implementation."""

import hashlib
import random
import re

from agrarium.llm import op2_secret_scan
from agrarium.llm.op2_secret_scan import ENCODINGS


def words(rng):
    return [rng.choice("the user account name of customer order status service value table field local system global number first second handler factory request".split()) for _ in range(40)]


def decoy(rng, n, k):
    parts = words(rng)
    text = {0: "_".join(parts), 1: "".join(w.title() for w in parts), 2: "/".join(parts), 3: "".join(parts)}[k % 4]
    return text[:n]


def planted(n_each, seed):
    rng = random.Random(seed)
    rows, secrets = [], {}
    for name, alphabet, _ in ENCODINGS:
        for n in (40, 64, 128, 256):
            for _ in range(n_each):
                i = len(rows)
                secrets[i] = (name, n, "".join(rng.choice(alphabet) for _ in range(n)))
                rows.append((i, f"some text before {secrets[i][2]} and after"))
    for k in range(8 * n_each * 10):
        rows.append((len(rows), f"some text before {decoy(rng, rng.randint(20, 160), k)} and after"))
    return rows, secrets


def measured(spark, n_each=10, seed=1):
    rows, secrets = planted(n_each, seed)
    found = op2_secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    hit, false, every = {}, 0, 0
    for r in found:
        spans = r.spans.split(",") if r.spans else []
        every += r.n_random
        if r.doc_id in secrets:
            name, n, value = secrets[r.doc_id]
            ok = any(s.split(":")[0] in ("random", "hex") and f":17:{17 + n}" in s for s in spans)
            hit.setdefault((name, n), []).append(ok)
        else:
            false += r.n_random
    return {k: sum(v) / len(v) for k, v in hit.items()}, false, every


def test_recall_and_false_discoveries(spark):
    recall, false, every = measured(spark)
    assert every > 100 and false <= 0.1 * every
    for name in ("alphanumeric", "base64", "base64url", "letters"):
        assert min(recall[name, 128], recall[name, 256]) >= 0.8, recall


def second_spans(text):
    """The three patterns by hand: leftmost, without overlap within a kind, failing matches dropped."""
    out = []
    kinds = [("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)", 8), ("access", r"(AKIA[A-Z0-9]+)", 16), ("hex", r"([0-9a-f]+)", 32)]
    for order, (kind, pattern, least) in enumerate(kinds):
        at = 0
        while m := re.compile(pattern).search(text, at):
            at = m.end()
            if len(m[1]) >= least:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_pattern_spans(spark):
    rng = random.Random(4)
    bits = ["password", "PassWD", "secret", "tOken", "api_key", "APIKEY", "=", ":", " ", "  ", "'", '"', "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 4, "0123456789abcdef" * 2, "xyz", "é", "\n", "-", "abcdefgh", "ſecret", "toKen"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)] + [(400, None), (401, "")]
    got = {r.doc_id: r for r in op2_secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = second_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s.startswith(k) for s in want.split(",")) for k in ("assign", "access", "hex")]


def test_discoveries_by_hand(spark):
    """Benjamini and Hochberg over the bins of each stratum."""
    rng = random.Random(9)
    rows = [(i, [(0, 1, rng.randint(0, 3), int(rng.expovariate(0.08))) for _ in range(rng.randint(0, 4))]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, candidates array<struct<start:int,end:int,stratum:int,bin:int>>")
    want = {}
    for s in range(4):
        ps = sorted(10 ** (-c[3] / 10) for _, cs in rows for c in cs if c[2] == s)
        good = [p for k, p in enumerate(ps, 1) if p <= 0.05 * k / len(ps)]
        if good:
            want[s] = max(good)
    got = op2_secret_scan.thresholds(df, 0.05)
    assert {s: round(10 ** (-b / 10), 12) for s, b in got.items()} == {s: round(p, 12) for s, p in want.items()} and want


def test_other_columns_and_ids(spark):
    rows = [(None, "token=abcdefgh12", 1, "x"), (3, "token=abcdefgh12", 2, "y"), (3, "token=abcdefgh12", 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, candidates string")
    got = sorted((str(r.doc_id), r.spans) for r in op2_secret_scan.secrets(df).collect())
    assert got == [("3", "assign:0:16")] * 2 + [("None", "assign:0:16")]
