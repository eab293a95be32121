"""Scores, thresholds and metrics of a contract classifier, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from randaudit.sources.scratch import stored

#: The threshold grid, computed as the reference's numbers are: some are not the nearest double of their decimal.
GRID = [0.05 + i * 0.05 for i in range(13)]
DEFAULT_THRESHOLD = 0.5


def softmax_prob(a: Column, b: Column) -> Column:
    """Probability of class 1 from logits (a, b), in stable form."""
    top = F.greatest(a, b)
    return F.exp(b - top) / (F.exp(a - top) + F.exp(b - top))


def argmax(a: Column, b: Column) -> Column:
    """The class of the larger logit, the first on ties."""
    return F.when(b > a, 1).otherwise(0)


def predict(prob: Column, threshold: Column | float) -> Column:
    """1 above the threshold, strictly."""
    return (prob > threshold).cast("int")


def _cells(pred: Column) -> list[Column]:
    y = F.col("label")
    return [F.count_if((y == a) & (pred == b)).alias(name) for name, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]


def confusion(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """tn, fp, fn, tp."""
    return scored.agg(*_cells(predict(F.col("prob"), threshold)))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_metrics(cells: DataFrame) -> DataFrame:
    """Rows of tn, fp, fn, tp with precision, recall, f1; 0 where nothing can be divided."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.select("*", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def metrics(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    return with_metrics(confusion(scored, threshold))


def auc_roc(scored: DataFrame) -> DataFrame:
    """auc_roc: ties share their rank; 0 if a class is missing (E5).

    Scores are counted first, so only distinct scores are ordered. They are dealt into ranges that hold about as many of them
    each, wherever they crowd; the negatives of lower ranges (a sum for each) are added as offsets.
    """
    counted = scored.groupBy("prob").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    placed = stored(counted.repartitionByRange("prob").withColumn("range", F.spark_partition_id()), "auc-scores")
    sums = placed.groupBy("range").agg(F.sum("neg").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lower"))
    inside = Window.partitionBy("range").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    below = placed.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(offsets), "range")
    total = below.agg(
        F.sum(F.col("pos") * (F.col("lower") + F.col("below") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    return total.select(_ratio(F.col("won"), F.col("p") * F.col("n")).alias("auc_roc"))


def sweep(scored: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """threshold, tn, fp, fn, tp, precision, recall, f1 for each threshold of a grid.

    A histogram: each row falls into one class, the number of thresholds below its score, so rows aren't multiplied, and one small partial
    aggregate is shuffled. Sums over the classes from the top give what is predicted above each threshold. Rows without a score count nowhere.
    """
    ordered = sorted(set(grid))
    known = scored.where(F.col("prob").isNotNull())
    above = F.size(F.filter(F.array(*map(F.lit, ordered)), lambda t: F.col("prob") > t))
    counts = known.groupBy(above.alias("k")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    # Class k holds the rows above threshold k, the k-th from below; class 0 those above none. There are len(grid) + 1 classes, with rows or without.
    classes = scored.sparkSession.createDataFrame([(0, None), *enumerate(ordered, 1)], "k int, threshold double").join(F.broadcast(counts), "k", "left")
    down = Window.orderBy(F.desc("k"))
    whole = Window.partitionBy()
    n = {c: F.coalesce(c, F.lit(0)) for c in ("pos", "neg")}
    summed = classes.select("k", "threshold", *[F.sum(x).over(w).alias(f"{c}_{name}") for c, x in n.items() for name, w in (("above", down), ("all", whole))])
    cells = summed.where("k > 0").select(
        "threshold",
        (F.col("neg_all") - F.col("neg_above")).alias("tn"),
        F.col("neg_above").alias("fp"),
        (F.col("pos_all") - F.col("pos_above")).alias("fn"),
        F.col("pos_above").alias("tp"),
    )
    return with_metrics(cells)


def best_threshold(scored: DataFrame, optimize_for: str = "f1", grid: list[float] = GRID) -> DataFrame:
    """threshold, score of the best threshold, the lowest on ties; the default with score 0 if every score is 0."""
    score = F.col("f1") if optimize_for == "f1" else 0.3 * F.col("f1") + 0.7 * F.col("recall")
    top = sweep(scored, grid).select("threshold", score.alias("score")).agg(F.max_by("threshold", F.struct("score", -F.col("threshold"))).alias("t"), F.max("score").alias("s"))
    none = F.coalesce(F.col("s"), F.lit(0.0)) <= 0
    return top.select(F.when(none, F.lit(DEFAULT_THRESHOLD)).otherwise(F.col("t")).alias("threshold"), F.coalesce("s", F.lit(0.0)).alias("score"))


def aggressive_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    """threshold, recall after a second try 0.1 lower if recall is under 0.65; it is taken if recall gains over 0.1."""
    lower = max(0.05, threshold - 0.10)
    both = with_metrics(scored.agg(*_cells(predict(F.col("prob"), threshold)))).select(F.col("recall").alias("first"))
    again = with_metrics(scored.agg(*_cells(predict(F.col("prob"), lower)))).select(F.col("recall").alias("second"))
    taken = (F.col("first") < 0.65) & (F.col("second") > F.col("first") + 0.10)
    return both.crossJoin(again).select(F.when(taken, lower).otherwise(threshold).alias("threshold"), F.when(taken, F.col("second")).otherwise(F.col("first")).alias("recall"))


def detection_breakdown(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """vulnerable, detected, missed and their percentages."""
    c = confusion(scored, threshold).withColumn("vulnerable", F.col("tp") + F.col("fn"))
    percent = lambda x: _ratio(x * 100, F.col("vulnerable"))
    return c.select("vulnerable", F.col("tp").alias("detected"), F.col("fn").alias("missed"), percent(F.col("tp")).alias("detected_percent"), percent(F.col("fn")).alias("missed_percent"))


def path_risk_accuracy(predicted: DataFrame) -> DataFrame:
    """accuracy of (pred, label), 0 without rows."""
    return predicted.agg(F.coalesce(F.avg((F.col("pred") == F.col("label")).cast("double")), F.lit(0.0)).alias("accuracy"))


def compare_scenarios(scenarios: dict[str, DataFrame]) -> DataFrame:
    """metric and one column for each scenario, from one-row tables of metrics."""
    out = None
    for name, df in scenarios.items():  # a handful of one-row tables
        long = df.unpivot([], ["precision", "recall", "f1"], "metric", "value").withColumn("scenario", F.lit(name))
        out = long if out is None else out.unionByName(long)
    return out.groupBy("metric").pivot("scenario", list(scenarios)).agg(F.first("value"))


def best_epoch(history: DataFrame) -> DataFrame:
    """The first epoch with the largest val_f1 of each run."""
    order = Window.partitionBy("run").orderBy(F.desc("val_f1"), "epoch")
    return history.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
