"""Secrets that stand right after '=', and in runs that mix both base64 alphabets."""

import random

import pytest

from agrarium.llm import op2_secret_scan

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
STD, URL = LETTERS + "+/", LETTERS + "-_"


def key(alphabet, n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n - 2)) + "1a"


def cases():
    a, b = key(STD, 96, 1), key(URL, 160, 2)
    plain = key(LETTERS, 96, 3)
    return {
        "assigned": (f"AWS_SECRET_ACCESS_KEY={a}", a),
        "env line": (f"PATH_1=x\nSIGNING_KEY_OF_THE_2ND_SERVICE={a}\nB=2", a),
        "padded": (f"k={a}== next", f"{a}=="),
        "parameter": (f"https://host/get?sig={b}&user=me", b),
        "path before": (f"my-bucket/{plain}", plain),
        "both sides": (f"a-b/{plain}_c/d", plain),
    }


@pytest.mark.parametrize("name", sorted(cases()))
def test_run_is_candidate(name):
    text, want = cases()[name]
    found = op2_secret_scan.candidates(text, op2_secret_scan.base_spans(text), 0.0)
    held = [text[s:e] for s, e, _, _ in found]
    assert any(want in h and len(h) <= len(want) + 10 for h in held)
    assert all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(found) for b in found[:i])


def test_spans(spark):
    want, rows = {}, []
    for i, name in enumerate(("assigned", "env line", "padded", "parameter")):
        text, value = cases()[name]
        rows.append((i, text))
        want[i] = f"random:{text.index(value)}:{text.index(value) + len(value)}"
    rows.append((9, "name_of_the_2nd_customer_account=the_name_of_the_3rd_customer_account_here"))
    got = {r.doc_id: r.spans for r in op2_secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**want, 9: ""}
