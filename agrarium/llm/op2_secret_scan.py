"""Secret scan: pattern spans, and spans that a battery of randomness tests adds.

Candidates are runs of at least 20 characters of [A-Za-z0-9+/_-], and the '='
that pad them; any other '=' ends a run, so that in NAME=value both sides are
runs. Of a run that no encoding holds, as it mixes + or / with - or _, the
longest parts in one alphabet that look random count. Each is read in the
narrowest of the encodings below, and tested:

- chi-squared uniformity over the encoding's alphabet, upper tail;
- Wald-Wolfowitz runs about the alphabet's middle, two-sided;
- serial correlation of neighbouring symbols, two-sided.

Cauchy's combination, which holds for dependent tests, makes one p of the
three: that of the string if it were random. Strings with less than ``alpha``
go. Not to be refused as random says little of a short string, so the others
must also be told from writing: the chi-squared statistic again, as pair
coincidences, against text of the encoding's coincidence rate. This p falls
with the length as far as the length can tell, and is controlled for false
discoveries at rate ``q`` (Benjamini and Hochberg) over all documents, within
strata of encoding and length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrarium.llm.rows import flat_map, saved

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]+"
#: Both find whole runs only: a run begins where no such character stands before.
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?"
PARTS = (r"[A-Za-z0-9+/]{20,}=*", r"[A-Za-z0-9_-]{20,}=*", r"[A-Za-z0-9]{20,}=*")
KINDS = ("assign", "access", "hex", "random")
#: Encodings from narrow to wide: name, alphabet, coincidence rate of writing in it.
ENCODINGS = (
    ("digits", "0123456789", 0.125),
    ("hex", "0123456789abcdef", 0.125),
    ("hex_upper", "0123456789ABCDEF", 0.125),
    ("lower", "abcdefghijklmnopqrstuvwxyz", 0.0655),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.0655),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.0655),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.06),
    ("alphanumeric", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.05),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.05),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.05),
)
LENGTHS = (20, 32, 48, 64, 96, 160)
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, candidates array<struct<start:int,end:int,stratum:int,bin:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.ASCII) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    return sorted(found)


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def combined(*ps: float) -> float:
    """Cauchy's combination of p-values, which may depend on each other; those above 0.99 count as 0.99, so that none hides another."""
    mean = sum(math.tan((0.5 - min(max(p, 1e-15), 0.99)) * math.pi) for p in ps) / len(ps)
    return 0.5 - math.atan(mean) / math.pi


def battery(string: str) -> tuple[int, float, float] | None:
    """(encoding, p of the string if it were random, p if it were writing), or None if no encoding holds it."""
    body = string.rstrip("=")
    n = len(body)
    if n < LENGTHS[0]:
        return None
    used = set(body)
    k = next((i for i, (_, alphabet, _) in enumerate(ENCODINGS) if used <= set(alphabet)), None)
    if k is None:
        return None
    alphabet, rate = ENCODINGS[k][1:]
    size = len(alphabet)
    x = np.fromiter(map(alphabet.index, body), np.int64, n)
    counts = np.bincount(x, minlength=size)
    chi2 = float(size / n * (counts**2).sum() - n)
    # Wilson and Hilferty's cube root of a chi-squared variable is close to normal.
    d = size - 1
    uniform = 0.5 * math.erfc((((max(chi2, 0) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))) / math.sqrt(2))
    high = x >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    c = x - x.mean()
    spread = float((c * c).sum())
    serial = two_sided(((float((c[1:] * c[:-1]).sum()) / spread) + 1 / n) * math.sqrt(n)) if spread else 0.0
    pairs = float((counts * (counts - 1)).sum())
    third = 1.5 * rate * rate
    sd = math.sqrt(2 * n * (n - 1) * (rate - rate**2) + 4 * n * (n - 1) * (n - 2) * (third - rate**2))
    writing = 0.5 * math.erfc((n * (n - 1) * rate - pairs) / sd / math.sqrt(2))
    return k, combined(uniform, runs, serial), writing


def runs(m: re.Match) -> list[tuple[int, int]]:
    """(start, end) of the run, or of its parts in one alphabet, longest first, if it mixes both of base64."""
    if not (set(m[0]) & set("+/") and set(m[0]) & set("-_")):
        return [m.span()]
    parts = {(m.start() + x.start(), m.start() + x.end()) for part in PARTS for x in re.finditer(part, m[0])}
    return sorted(parts, key=lambda p: (p[0] - p[1], p[0]))


def candidates(text: str, base: list[tuple[int, int, int]], alpha: float) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, tenths of -log10 p) of strings that look random and lie in no base span."""
    out = []
    # Base spans are in order of their starts: one holds a string if it starts no later and the furthest end so far isn't before the string's.
    starts, furthest = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in re.finditer(CANDIDATE, text):
        taken: list[tuple[int, int]] = []
        for start, end in runs(m):
            held, at = bisect_right(starts, start), bisect_right(taken, (start, end))
            if held and furthest[held - 1] >= end or at and taken[at - 1][1] > start or at < len(taken) and taken[at][0] < end:
                continue
            tested = battery(text[start:end])
            if tested and tested[1] >= alpha:
                taken.insert(at, (start, end))
                stratum = tested[0] * len(LENGTHS) + sum(end - start >= x for x in LENGTHS) - 1
                out.append((start, end, stratum, int(-10 * math.log10(max(tested[2], 1e-300)))))
    return out


def tested(docs: DataFrame, alpha: float) -> DataFrame:
    """Pattern spans and tested candidates of each row."""

    def make() -> Callable:
        def each(doc_id: int | None, text: str | None) -> list[tuple]:
            base = base_spans(text or "")
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            digest = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
            return [(doc_id, *n, digest, [dict(zip(("start", "kind", "end"), x, strict=True)) for x in base], [dict(zip(("start", "end", "stratum", "bin"), x, strict=True)) for x in candidates(text or "", base, alpha)])]

        return each

    return flat_map(docs.select("doc_id", "text"), make, SCHEMA, batch=5_000)


def thresholds(rows: DataFrame, q: float) -> dict[int, int]:
    """The least bin that counts as a discovery, by stratum; at most len(ENCODINGS) * len(LENGTHS) rows reach the driver.

    A bin's p is taken at its upper end, so the rate is never above ``q``.
    """
    bins = rows.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").agg(F.count("*").alias("n"))
    above = "PARTITION BY stratum ORDER BY bin DESC"
    ranked = bins.select("stratum", "bin", F.expr(f"sum(n) OVER ({above})").alias("found"), F.expr("sum(n) OVER (PARTITION BY stratum)").alias("tests"))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= q * F.col("found") / F.col("tests"))
    return {r["stratum"]: r["bin"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def secrets(docs: DataFrame, q: float = 0.05, alpha: float = 0.01) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, digest of the pattern spans, and all spans.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind. Null text counts as empty; ids and repeated rows are kept; other
    columns are ignored; an empty table gives no rows. Very long texts are
    scanned whole.
    """
    rows = saved(tested(docs, alpha))
    least = thresholds(rows, q)
    bound = F.create_map(*(F.lit(v) for kv in least.items() for v in kv)) if least else None
    random = F.filter("candidates", lambda c: (c["bin"] >= bound[c["stratum"]]) if bound is not None else F.lit(False))
    added = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    every = F.array_sort(F.concat("base", added))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size(added).cast("long").alias("n_random"))
