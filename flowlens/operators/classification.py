"""Classification metrics from one counting pass over the predictions.

Every function takes ``by`` columns (run, split, feature space, ...), so a whole report is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.schema import CATEGORIES


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def f_score(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def binary_confusion(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"),
    )


def binary_metrics(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1 and far; far averages both error rates and is null when a class is absent."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    far = (F.try_divide(fp.cast("double"), fp + tn) + F.try_divide(fn.cast("double"), fn + tp)) / 2
    return binary_confusion(df, truth, pred, by).select(
        *by, ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), precision.alias("precision"),
        recall.alias("recall"), f_score(precision, recall).alias("f1"), far.alias("far"),
    )


def pair_counts(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Rows per (truth, prediction): the only pass over the data for all metrics below."""
    return df.groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def category_confusion(df: DataFrame, category: str, pred: str, by: list[str] = ()) -> DataFrame:
    """One row per category code (0..9, zero-filled) with counts of Normal and Attack predictions."""
    cells = [
        F.count_if((F.col(category) == c) & (F.col(pred) == v)).alias(f"c{c}_{v}")
        for c in range(len(CATEGORIES)) for v in (0, 1)
    ]
    rows = [
        F.struct(F.lit(c).alias("category"), F.col(f"c{c}_0").alias("normal"), F.col(f"c{c}_1").alias("attack"))
        for c in range(len(CATEGORIES))
    ]
    return df.groupBy(*by).agg(*cells).select(*by, F.inline(F.array(*rows)))


def class_totals(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per label seen in truth or prediction: true positives, support and number predicted."""
    n, t, p = F.col("n"), F.col("t"), F.col("p")
    zero = F.lit(0).cast("long")
    as_truth = F.struct(t.alias("class"), F.when(t == p, n).otherwise(zero).alias("tp"),
                        n.alias("support"), zero.alias("predicted"))
    as_pred = F.struct(p.alias("class"), zero.alias("tp"), zero.alias("support"), n.alias("predicted"))
    return (
        pairs.select(*by, F.inline(F.array(as_truth, as_pred)))
        .groupBy(*by, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )


def per_class_metrics(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    """f1, precision and recall per label; ``dense_position`` numbers the labels that occur."""
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    position = F.row_number().over(Window.partitionBy(*by or [F.lit(0)]).orderBy("class")) - 1  # rows = labels
    return class_totals(pair_counts(df, truth, pred, by), by).select(
        *by, "class", position.alias("dense_position"), "tp", "support", "predicted",
        precision.alias("precision"), recall.alias("recall"), f_score(precision, recall).alias("f1"),
    )


def averaged_metrics(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    """accuracy with macro and micro averages of the per-class metrics."""
    return _averages(per_class_metrics(df, truth, pred, by), by)


# the averaged battery, in report order
AVERAGES = ["accuracy", "f1_macro", "f1_micro", "precision_macro", "precision_micro", "recall_macro", "recall_micro"]


def _average_columns() -> list[Column]:
    tp, support, predicted = (F.sum(c) for c in ("tp", "support", "predicted"))
    p_micro, r_micro = ratio(tp, predicted), ratio(tp, support)
    columns = [
        ratio(tp, support), F.avg("f1"), f_score(p_micro, r_micro), F.avg("precision"), p_micro, F.avg("recall"), r_micro
    ]
    return [c.alias(name) for c, name in zip(columns, AVERAGES)]


def _averages(classes: DataFrame, by: list[str]) -> DataFrame:
    return classes.groupBy(*by).agg(*_average_columns())


def category_scores(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Long form (by..., metric, value) of accuracy, averages and the per-class metrics."""
    return _long_battery(per_class_metrics(df, truth, pred, by), by, "dense_position")


def _long_battery(classes: DataFrame, by: list[str], position: str) -> DataFrame:
    """Averages and per-class rows from one aggregate over the class table."""
    exact = "accuracy" in classes.columns
    folded = classes.groupBy(*by).agg(
        *_average_columns(), F.collect_list(F.struct(position, "f1", "precision", "recall")).alias("_classes"),
        *([F.first("accuracy").alias("_exact")] if exact else []),
    )
    if exact:
        folded = folded.withColumn("accuracy", F.col("_exact"))

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.alias("metric"), value.alias("value"))

    averages = F.array(*[entry(F.lit(m), F.col(m)) for m in AVERAGES])
    per_class = F.flatten(F.transform("_classes", lambda c: F.array(*[
        entry(F.concat_ws("_", F.lit(m), c[position].cast("string")), c[m]) for m in ("f1", "precision", "recall")
    ])))
    return folded.select(*by, F.inline(F.concat(averages, per_class)))


def binary_scores(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Long form (by..., metric, value) of the binary metrics."""
    return long_metrics(
        binary_metrics(df, truth, pred, by), by, ["accuracy", "precision", "recall", "f1", "far"]
    )


def long_metrics(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(list(by), metrics, "metric", "value")


def indicator_metrics(df: DataFrame, truth: str, pred: str, width: int, by: list[str] = ()) -> DataFrame:
    """The averaged battery on indicator rows: accuracy is an exact row match, micro runs over all cells."""
    classes = _indicator_classes(df, truth, pred, width, by)
    averages = [c for c, name in zip(_average_columns(), AVERAGES) if name != "accuracy"]
    return classes.groupBy(*by).agg(F.first("accuracy").alias("accuracy"), *averages)


def _indicator_classes(df: DataFrame, truth: str, pred: str, width: int, by: list[str]) -> DataFrame:
    """Per-position totals and metrics of two indicator columns, with the share of exactly equal rows, by one
    wide aggregate (no exploded rows)."""
    def cell(column, i):
        return F.get(F.col(column), F.lit(i)).cast("long")

    sums = []
    for i in range(width):
        t, p = cell(truth, i), cell(pred, i)
        sums += [F.sum(t * p).alias(f"tp{i}"), F.sum(t).alias(f"t{i}"), F.sum(p).alias(f"p{i}")]
    same = F.transform(F.col(truth), lambda v: v.cast("int")) == F.transform(F.col(pred), lambda v: v.cast("int"))
    folded = df.groupBy(*by).agg(F.avg(same.cast("double")).alias("accuracy"), *sums)
    rows = F.array(*[
        F.struct(F.lit(i).alias("class"), F.col(f"tp{i}").alias("tp"), F.col(f"t{i}").alias("support"),
                 F.col(f"p{i}").alias("predicted"))
        for i in range(width)
    ])
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return folded.select(*by, "accuracy", F.inline(rows)).withColumns(
        {"precision": precision, "recall": recall}
    ).withColumn("f1", f_score(F.col("precision"), F.col("recall")))


def indicator_scores(df: DataFrame, truth: str, pred: str, width: int, by: list[str] = ()) -> DataFrame:
    """Long form of the indicator battery, with the per-position metrics."""
    return _long_battery(_indicator_classes(df, truth, pred, width, by), by, "class")
