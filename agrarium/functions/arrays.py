"""Expressions over arrays: probabilities, sequences and their masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x.cast("double") - top.cast("double")))
    # Held in a struct, the sum is taken once and not for each element.
    held = F.struct(powers.alias("p"), array_sum(powers).alias("s"))
    return F.element_at(F.transform(F.array(held), lambda h: F.transform(h["p"], lambda x: x / h["s"])), 1)


def from_confidence(confidence: Column, classes: int) -> Column:
    """Probabilities with a confidence for the first class and the rest shared evenly."""
    return F.concat(F.array(confidence), F.array_repeat((1 - confidence) / (classes - 1), classes - 1))


def entropy(probabilities: Column) -> Column:
    """Bits of a distribution."""
    return array_sum(F.transform(probabilities, lambda p: -p * F.log2(F.greatest(p, F.lit(1e-12)))))


def top_classes(probabilities: Column, k: int) -> Column:
    """array<struct<p, i>>: the ``k`` likeliest classes, ties to the lower one."""
    ranked = F.array_sort(F.transform(probabilities, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct((-s["p"]).alias("p"), s["i"].alias("i")))


def padded(values: Column, size: int, keep_last: bool = False, pad_left: bool = False, fill: float = 0.0) -> Column:
    """Exactly ``size`` values: cut at the end (or the start), filled at the end (or the start)."""
    n = F.size(values)
    cut = F.slice(values, F.greatest(n - size + 1, F.lit(1)) if keep_last else F.lit(1), F.lit(size))
    rest = F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - n, F.lit(0)))
    return F.concat(rest, cut) if pad_left else F.concat(cut, rest)


def pad_mask(values: Column, size: int, pad_left: bool = False) -> Column:
    """1 where ``padded`` holds a value."""
    n = F.least(F.size(values), F.lit(size))
    at = F.sequence(F.lit(1), F.lit(size))
    return F.transform(at, lambda i: (i > size - n if pad_left else i <= n).cast("int"))


def day_gaps(dates: Column) -> Column:
    """Days between consecutive distinct dates."""
    days = F.array_sort(F.array_distinct(F.filter(dates, lambda d: d.isNotNull())))
    n = F.size(days)
    return F.when(n < 2, F.array().cast("array<int>")).otherwise(F.zip_with(F.slice(days, 1, F.greatest(n - 1, F.lit(0))), F.slice(days, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.datediff(b, a)))


def resized(values: Column, size: tuple[int, int], new: tuple[int, int]) -> Column:
    """A patch (rows one after the other) of ``size`` (rows, columns) as one of ``new``, bilinearly between the centres of its cells; values at the rim go on outwards.

    Columns are weighted first, then rows. Null for arrays of another length; a null cell makes those null that need it.
    """
    if min(*size, *new) < 1:
        raise ValueError("sizes must be at least 1")

    def weights(n: int, m: int) -> Column:
        out = []
        for i in range(m):
            at = min(max((i + 0.5) * n / m - 0.5, 0.0), n - 1.0)
            lo = int(at)
            out.append(F.struct(F.lit(lo).alias("lo"), F.lit(min(lo + 1, n - 1)).alias("hi"), F.lit(at - lo).alias("f")))
        return F.array(*out)

    # Without weight a neighbour doesn't count, not even as null.
    between = lambda a, b, f: F.when(f == 0, a).otherwise(a * (1 - f) + b * f)
    h, w = size
    cell = lambda r, c: F.get(values, r * w + c).cast("double")
    wide = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.transform(weights(w, new[1]), lambda c: between(cell(r, c["lo"]), cell(r, c["hi"]), c["f"])))
    # Held in an array, the columns' step is taken once and not for each row.
    tall = F.transform(F.array(wide), lambda m: F.flatten(F.transform(weights(h, new[0]), lambda q: F.zip_with(m[q["lo"]], m[q["hi"]], lambda a, b: between(a, b, q["f"])))))[0]
    return F.when(F.size(values) == h * w, tall)
