"""Rates, calibration, ranking, multiclass and regression metrics, fairness and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrarium.operators import ranks
from agrarium.operators.lineage import saved


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def group_rates(df: DataFrame, group: str, truth: str, predicted: str) -> DataFrame:
    """Confusion counts and rates of 0/1 columns per group."""
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = df.groupBy(group).agg(F.count("*").alias("support"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({"base_rate": ratio(tp + fn, F.col("support")), "accuracy": ratio(tp + tn, F.col("support")), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall), "tpr": recall, "fpr": ratio(fp, fp + tn), "tnr": ratio(tn, fp + tn), "fnr": ratio(fn, tp + fn)})


def group_errors(df: DataFrame, group: str, truth: str, predicted: str) -> DataFrame:
    e = F.col(predicted) - F.col(truth)
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(truth).alias("mean_truth"), F.avg(predicted).alias("mean_predicted"), F.avg(e).alias("bias"))


#: The largest spread of a metric that is compliant, and that is at risk.
SPREADS = {"base_rate": (0.10, 0.20), "tpr": (0.10, 0.20), "fpr": (0.10, 0.20), "accuracy": (0.05, 0.10)}


def verdicts(rates: DataFrame, least_support: int = 30) -> DataFrame:
    """(metric, spread, ratio, status): differences between groups of enough rows."""
    used = rates.where(F.col("support") >= least_support)
    one = [F.struct(F.lit(m).alias("metric"), (F.max(m) - F.min(m)).alias("spread"), ratio(F.min(m), F.max(m)).alias("ratio"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, (a, b) in SPREADS.items()]
    rows = used.agg(F.array(*one).alias("x")).select(F.inline("x"))
    status = F.when(F.col("spread") <= F.col("a"), "compliant").when(F.col("spread") <= F.col("b"), "at_risk").otherwise("violating")
    return rows.select("metric", "spread", "ratio", status.alias("status"))


STATUSES = ("compliant", "at_risk", "violating")


def rates_by_attribute(df: DataFrame, attributes: list[str], truth: str, predicted: str) -> DataFrame:
    """group_rates of every attribute in one aggregation: (attribute, group, support, ...)."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group")) for a in attributes))
    rows = df.select(truth, predicted, F.inline(pairs)).withColumn("_g", F.struct("attribute", "group"))
    found = group_rates(rows, "_g", truth, predicted)
    return found.select("_g.*", *(c for c in found.columns if c != "_g"))


def verdicts_by(rates: DataFrame, attribute: str, least_support: int = 30) -> DataFrame:
    """(attribute, metric, spread, ratio, status, worst): the verdicts of each attribute, and the worst of its statuses."""
    used = rates.where(F.col("support") >= least_support)
    one = [F.struct(F.lit(m).alias("metric"), (F.max(m) - F.min(m)).alias("spread"), ratio(F.min(m), F.max(m)).alias("ratio"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, (a, b) in SPREADS.items()]
    rows = used.groupBy(attribute).agg(F.array(*one).alias("x")).select(attribute, F.inline("x"))
    level = F.when(F.col("spread") <= F.col("a"), 1).when(F.col("spread") <= F.col("b"), 2).otherwise(3)
    named = lambda r: F.element_at(F.array(*map(F.lit, STATUSES)), r)
    rows = rows.withColumn("_l", level)
    top = rows.groupBy(attribute).agg(F.max("_l").alias("_w"))
    return rows.join(top, attribute).select(attribute, "metric", "spread", "ratio", named(F.col("_l")).alias("status"), named(F.col("_w")).alias("worst"))


def calibration(df: DataFrame, probability: Column, hit: Column, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) over bins of equal width, the last one closed."""
    bin_ = F.least(F.floor(probability * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("confidence"), F.avg(hit.cast("double")).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """(ece, mce): mean and largest distance of confidence and accuracy."""
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return bins.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def roc_auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(auc, positives, negatives): equal scores count half; 0 with one class only.

    Counts per score are summed over ranges of scores, whose edges are quantiles
    of the distinct scores, with the sums of the ranges before added.
    """
    steps = saved(df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n")))
    rows = ranks.running(steps, [], "s", ["n"])
    whole = rows.agg(F.sum(F.col("p") * (F.col("_before_n") + F.col("n") / 2)).alias("u"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return whole.select(ratio(F.col("u"), F.col("positives") * F.col("negatives")).alias("auc"), "positives", "negatives")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) from a confusion table."""
    by_truth = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    by_guess = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    rows = by_truth.join(by_guess, "label", "full_outer").na.fill(0)
    precision, recall = ratio(F.col("tp"), F.col("guessed")), ratio(F.col("tp"), F.col("support"))
    return rows.select("label", "support", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def averages(counts: DataFrame) -> DataFrame:
    """One row: accuracy, balanced accuracy, and macro and weighted precision, recall and F1."""
    right = counts.agg(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("r"), F.sum("n").alias("n"))
    classes = per_class(counts).where("support > 0")
    means = classes.agg(F.avg("recall").alias("balanced_accuracy"), *(F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")), *((F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")))
    one = right.first()
    return means.withColumn("accuracy", F.lit((one["r"] or 0) / one["n"] if one["n"] else 0.0))


def top_k_accuracy(df: DataFrame, probabilities: str, label: str, k: int) -> DataFrame:
    from agrarium.functions.arrays import top_classes

    hit = F.exists(top_classes(F.col(probabilities), k), lambda s: s["i"] == F.col(label))
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("n"))


def pr_curve(df: DataFrame, score: str, truth: str, points: int = 100) -> DataFrame:
    """(threshold, precision, recall) at ``points`` thresholds from 0 to 1."""
    steps = df.groupBy(F.floor(F.least(F.col(score), F.lit(1.0)) * points).cast("int").alias("b")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("b"))
    run = steps.select("b", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("got"), F.sum("p").over(Window.partitionBy()).alias("all"))
    return run.select((F.col("b") / points).alias("threshold"), ratio(F.col("tp"), F.col("got")).alias("precision"), ratio(F.col("tp"), F.col("all")).alias("recall"))


def class_curves(scores: DataFrame, points: int = 100) -> DataFrame:
    """(label, threshold, precision, recall) of (label, score, hit): at most about ``points`` distinct scores of each class, highest first.

    Every k-th distinct score is a point, with k the share of ``points`` in the
    class's distinct scores, and the lowest score always is.
    """
    counts = saved(scores.groupBy("label", (-F.col("score")).alias("_s")).agg(F.count_if("hit").alias("p"), F.count("*").alias("n"), F.lit(1).alias("d")))
    totals = counts.groupBy("label").agg(F.sum("p").alias("_all"), F.count("*").alias("_m"))
    rows = ranks.running(counts, ["label"], "_s", ["p", "n", "d"]).join(totals, "label")
    tp, got, at = F.col("_before_p") + F.col("p"), F.col("_before_n") + F.col("n"), F.col("_before_d")
    step = F.greatest(F.floor(F.col("_m") / points), F.lit(1))
    kept = rows.where((F.pmod(at, step) == 0) | (at == F.col("_m") - 1))
    return kept.select("label", (F.lit(0.0) - F.col("_s")).alias("threshold"), ratio(tp, got).alias("precision"), ratio(tp, F.col("_all")).alias("recall"))


def regression_metrics(df: DataFrame, truth: str, predicted: str, tolerance: float = 0.1) -> DataFrame:
    """One row: mse, rmse, mae, lower median of the absolute error, bias (truth less prediction), largest error, r2, mape, share within tolerance."""
    y, e = F.col(truth), F.col(truth) - F.col(predicted)
    found = df.agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"), F.max(F.abs(e)).alias("max_error"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"), F.avg(F.when(F.abs(y) > 1e-8, F.abs(e / y))).alias("mape"), F.avg((F.abs(e) <= tolerance * F.abs(y)).cast("double")).alias("within"),
    )
    middle = ranks.values_at(df, [], F.abs(e), {"median_ae": F.floor((F.col("n") - 1) / 2)})
    return found.crossJoin(middle)


def outliers(df: DataFrame, truth: str, predicted: str, share: float = 0.95) -> DataFrame:
    """Rows whose absolute error exceeds the quantile ``share`` of all, with that error."""
    error = F.abs(F.col(truth) - F.col(predicted))
    limit = ranks.quantiles(df, {"e": error}, [share]).get("e", [None])[0]
    return df.withColumn("abs_error", error).where(F.col("abs_error") > F.lit(limit))


def latency(df: DataFrame, ms: str) -> DataFrame:
    q = ranks.quantiles_by(df, [], F.col(ms), [0.5, 0.95, 0.99]).select("q")
    found = df.agg(F.avg(ms).alias("mean"), F.min(ms).alias("min"), (F.count("*") / (F.sum(ms) / 1000)).alias("per_second")).crossJoin(q)
    return found.select("mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "min", "per_second")


def cross_entropy(probabilities: Column, label: Column, smoothing: float = 0.0) -> Column:
    k = F.size(probabilities)
    logs = F.transform(probabilities, lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    whole = F.aggregate(logs, F.lit(0.0), lambda s, x: s + x)
    return -((1 - smoothing) * F.element_at(logs, label + 1) + smoothing / k * whole)


def focal_loss(probabilities: Column, label: Column, gamma: float = 2.0) -> Column:
    p = F.greatest(F.element_at(probabilities, label + 1), F.lit(1e-12))
    return -F.pow(1 - p, gamma) * F.log(p)


def huber(truth: Column, predicted: Column, delta: float = 1.0) -> Column:
    e = F.abs(truth - predicted)
    return F.when(e <= delta, e * e / 2).otherwise(delta * (e - delta / 2))
