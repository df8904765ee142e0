"""Model metrics as plain aggregates (no collect, no per-row Python).

Each metric is one aggregate job over the scored rows, optionally per group
(``by``), so many folds or models are evaluated together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.scalars import round_even
from tillsight.operators.quantiles import running_total_before
from tillsight.functions.scalars import with_scalars


def regression_metrics(pred: DataFrame, label: str = "units_sold", prediction: str = "prediction",
                       by: Sequence[str] = ()) -> DataFrame:
    """R2 (4 dp; null where all labels are equal), RMSE (2 dp), MAE (2 dp).

    SST = n * var_pop(y) uses Spark's mergeable central moments, so no
    second pass for the mean is needed."""
    e = F.col(label) - F.col(prediction)
    g = pred.groupBy(*by) if by else pred
    out = g.agg(F.sum(e * e).alias("_sse"), F.count(F.lit(1)).alias("_n"),
                F.var_pop(F.col(label)).alias("_vp"), F.avg(F.abs(e)).alias("_mae"))
    return out.select(
        *by,
        round_even(F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_vp") * F.col("_n")), 4).alias("R2"),
        round_even(F.sqrt(F.col("_sse") / F.col("_n")), 2).alias("RMSE"),
        round_even(F.col("_mae"), 2).alias("MAE"))


def binary_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                   score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on 0/0) and ROC AUC (NaN with one
    class), all to 4 dp.

    AUC is the rank-sum statistic with tied scores sharing the average rank:
    P(score_pos > score_neg) + 0.5 P(tie). The rows are grouped once, by
    distinct score, and everything is a sum over that table; the negatives
    below each score are a bucketed prefix sum (``running_total_before``), so
    no task holds all distinct scores of a group. Scores must be non-null."""
    y, p = F.col(label), F.col(prediction)
    per_score = (scored.groupBy(*by, F.col(score).alias("_s"))
                 .agg(F.count(F.lit(1)).alias("_rows"),
                      F.sum(F.when(y == 1, 1).otherwise(0)).alias("_pos"),
                      F.sum(F.when(y == 0, 1).otherwise(0)).alias("_neg"),
                      F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).alias("_tp"),
                      F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).alias("_fp"),
                      F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).alias("_fn"),
                      F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).alias("_tn")))
    below = running_total_before(per_score, "_s", "_neg", "_negb", by=by)
    j = (below.groupBy(*by)
         .agg(F.sum(F.col("_pos") * (F.col("_negb") + F.col("_neg") * 0.5)).alias("_u"),
              F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"),
              *[F.sum(c).alias(c) for c in ("_rows", "_tp", "_fp", "_fn", "_tn")])
         .withColumn("_auc", F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_u") / (F.col("_P") * F.col("_N")))
                     .otherwise(F.lit(float("nan")))))
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return j.select(
        *by,
        round_even((tp + F.col("_tn")) / F.col("_rows"), 4).alias("Accuracy"),
        round_even(prec, 4).alias("Precision"),
        round_even(rec, 4).alias("Recall"),
        round_even(f1, 4).alias("F1"),
        F.when(F.isnan("_auc"), F.lit(float("nan"))).otherwise(round_even("_auc", 4)).alias("ROC_AUC"))


def class_weights(df: DataFrame, label: str = "churned") -> DataFrame:
    """Balanced weights n / (k * n_class) per label value (k = classes)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    tot = Window.partitionBy()
    return counts.select(label, (F.sum("_c").over(tot) / (F.count(F.lit(1)).over(tot) * F.col("_c")))
                         .alias("weight"))


def balanced_weights(df: DataFrame, label: str = "churned") -> DataFrame:
    """Attach the balanced class weight to every row (the weight table has
    one row per class: a proven-small broadcast)."""
    return df.join(F.broadcast(class_weights(df, label)), label)


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std per column (a zero std leaves 0 / the
    centred value, as scikit-learn does), from one aggregate row."""
    stats = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"),
                                                F.stddev_pop(c).alias(f"_s_{c}"))])
    j = with_scalars(df, stats)
    for c in cols:
        s = F.col(f"_s_{c}")
        j = j.withColumn(f"{c}{suffix}", (F.col(c) - F.col(f"_m_{c}"))
                         / F.when(s == 0, F.lit(1.0)).otherwise(s))
    return j.drop(*[f"_{k}_{c}" for c in cols for k in ("m", "s")])
