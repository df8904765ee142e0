"""Sales forecasting with MLlib: linear, random forest and boosted trees,
compared on a chronological split, then walk-forward CV of the best model.

The forest is MLlib's; the linear fits solve cross products summed once by
Spark (``ml.linear``), the boosted trees are grown on binned columns in one job
(``ml.boosting``). The training table is the daily feature table (one row per
day, or per day and key for a panel); it is written once and reused by every
fit. Only fitted-model parameters and the metric rows (one per model or fold)
reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.ml import linear as LN
from tillsight.ml.boosting import fit_boosted
from tillsight.ml.parallel import fit_all
from tillsight.operators.daily import chronological_split, walk_forward_splits
from tillsight.operators.metrics import regression_metrics
from tillsight.schema import FORECAST_FEATURES, TARGET
from tillsight.session import materialize

FEATURES_COL = "features"


def feature_vector(features: DataFrame, cols: Sequence[str] = FORECAST_FEATURES,
                   out: str = FEATURES_COL) -> DataFrame:
    """Assemble the 18 model features (avg_order_value is excluded: it is a
    same-day quantity and would leak the target)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(
        features.withColumns({c: F.col(c).cast("double") for c in cols}))


def forecast_linear(train: DataFrame, label: str = TARGET):
    """Ordinary least squares (no penalty), from one pass of cross products."""
    return LN.fit_linear(train, label)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the (small, per-day) training table over the cluster's
    default parallelism: it comes out of a series window in one partition,
    and every MLlib pass would otherwise run as a single task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def forecast_forest(train: DataFrame, label: str = TARGET, trees: int = 300, depth: int = 8,
                    seed: int = 42):
    """Random forest; every feature is a split candidate at every node. Node
    ids are cached between levels and the histogram budget is raised, so
    deep forests need fewer passes over the data."""
    return RandomForestRegressor(featuresCol=FEATURES_COL, labelCol=label, numTrees=trees,
                                 maxDepth=depth, featureSubsetStrategy="all", seed=seed,
                                 maxMemoryInMB=1024, cacheNodeIds=True).fit(train)


def forecast_boosted(train: DataFrame, label: str = TARGET, rounds: int = 400, depth: int = 5,
                     step: float = 0.03, rows: float = 0.8, cols: float = 0.8, seed: int = 42):
    """Gradient-boosted trees grown level by level: 400 rounds, depth 5,
    learning rate 0.03, 80 % of the rows and of the columns drawn for each
    tree, leaf values shrunk by a penalty of 1."""
    return fit_boosted(train, label, rounds=rounds, depth=depth, step=step, rows=rows, cols=cols, penalty=1.0, least=1, seed=seed)


def forecast_boosted_no_sampling(train: DataFrame, label: str = TARGET, rounds: int = 400, depth: int = 5,
                                 step: float = 0.03, leaves: int = 31, least: int = 20, seed: int = 42):
    """Gradient-boosted trees grown leaf by leaf, the best split first: up to
    31 leaves of at least 20 rows within depth 5, no sampling, no penalty."""
    return fit_boosted(train, label, rounds=rounds, depth=depth, leaves=leaves, step=step, rows=1.0, cols=1.0, penalty=0.0,
                       least=least, seed=seed)


def default_models(trees: int = 300, rounds: int = 400) -> dict:
    """Model name -> fit function (train frame -> fitted model)."""
    return {
        "Linear Regression": forecast_linear,
        "Random Forest": lambda d: forecast_forest(d, trees=trees),
        "Boosted Trees": lambda d: forecast_boosted(d, rounds=rounds),
        "Boosted Trees (no sampling)": lambda d: forecast_boosted_no_sampling(d, rounds=rounds),
    }


def _prepared(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    return materialize(spread(feature_vector(chronological_split(features, keys=keys))))


def model_comparison(features: DataFrame, models: dict | None = None,
                     keys: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """Fit every model on the train split, score the test split, and return
    (metrics table sorted by R2 desc, fitted models). All test predictions
    are evaluated in one aggregate job grouped by model."""
    models = models or default_models()
    data = _prepared(features, keys)
    train = data.filter(F.col("split") == "train")
    test = data.filter(F.col("split") == "test")
    names = list(models)
    # the models' fits are independent: submitted together
    fitted = dict(zip(names, fit_all(lambda name: models[name](train), names)))
    scored = None
    for name, m in fitted.items():
        s = m.transform(test).select(F.lit(name).alias("model"), F.col(TARGET),
                                     F.col("prediction").cast("double").alias("prediction"))
        scored = s if scored is None else scored.unionByName(s)
    table = regression_metrics(scored, by=["model"]).orderBy(F.desc("R2"), F.asc("model"))
    return table, fitted


def best_model(comparison: DataFrame, metric: str = "R2") -> DataFrame:
    """The row with the highest metric, ties to the first name (an aggregate
    ``min_by``, no sort); a row without the metric only wins against its like."""
    order = F.struct(F.col(metric).isNull(), -F.col(metric), F.col("model"))
    return comparison.agg(F.min_by(F.struct(*comparison.columns), order).alias("b")).select("b.*")


def walk_forward_cv(features: DataFrame, fit, n_folds: int = 5, min_train_days: int = 90,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Refit ``fit`` on each expanding fold and evaluate its test block.

    Linear fits of all folds come from one pass over the days
    (``linear.walk_forward``). For other models the fold table is built once
    (``walk_forward_splits``) and written; each fold is one fit (submitted
    together); the test predictions of all folds are evaluated in a single
    grouped aggregate. Output: R2, RMSE, MAE, fold, train_days, test_days."""
    if fit is forecast_linear:
        return LN.walk_forward(feature_vector(features), n_folds, min_train_days, keys)
    folds = materialize(spread(feature_vector(walk_forward_splits(features, n_folds, min_train_days, keys))))
    n = [r["fold"] for r in folds.select("fold").distinct().collect()]

    def fold_fit(k):
        tr = folds.filter((F.col("fold") == k) & (F.col("role") == "train"))
        te = folds.filter((F.col("fold") == k) & (F.col("role") == "test"))
        return fit(tr).transform(te).select("fold", F.col(TARGET),
                                            F.col("prediction").cast("double").alias("prediction"))

    scored = None
    for s in fit_all(fold_fit, sorted(n)):     # the folds' fits run concurrently
        scored = s if scored is None else scored.unionByName(s)
    sizes = (folds.groupBy("fold")
                  .agg(F.count_distinct(F.when(F.col("role") == "train", F.col("date"))).alias("train_days"),
                       F.count_distinct(F.when(F.col("role") == "test", F.col("date"))).alias("test_days")))
    if scored is None:
        return features.sparkSession.createDataFrame(
            [], "R2 double, RMSE double, MAE double, fold int, train_days long, test_days long")
    return regression_metrics(scored, by=["fold"]).join(sizes, "fold").select(
        "R2", "RMSE", "MAE", "fold", "train_days", "test_days")


def cv_summary(cv: DataFrame) -> DataFrame:
    """Mean and sample std of fold R2."""
    return cv.agg(F.avg("R2").alias("cv_mean_r2"), F.stddev_samp("R2").alias("cv_std_r2"))


SCENARIO_COLS = ("day_of_week", "is_weekend", "is_month_start", "is_month_end")


def scenarios(month_flags: bool = True) -> list[tuple]:
    """Every weekday x month-start x month-end combination (28 rows)."""
    flags = (0, 1) if month_flags else (0,)
    return [(d, int(d >= 5), s, e) for d in range(7) for s in flags for e in flags]


def what_if(model, features: DataFrame, cases: list[tuple] | None = None,
            cols: Sequence[str] = FORECAST_FEATURES) -> DataFrame:
    """The newest feature row with its calendar flags replaced by each case
    (day_of_week, is_weekend, is_month_start, is_month_end), scored in one
    ``transform``; delta = prediction - last known units. The cases are a
    literal array expanded with ``inline`` on the single newest row."""
    from tillsight.operators.daily import last_row

    cases = cases if cases is not None else scenarios()
    arr = F.array(*[F.struct(*[F.lit(int(v)).alias(c) for v, c in zip(case, SCENARIO_COLS)])
                    for case in cases])
    rows = last_row(features).drop(*SCENARIO_COLS).select("*", F.inline(arr))
    pred = model.transform(feature_vector(rows, cols))
    return pred.select(*SCENARIO_COLS, F.col("units_sold").alias("last_units_sold"),
                       F.col("prediction").alias("predicted_units_sold"),
                       (F.col("prediction") - F.col("units_sold")).alias("delta"))


def save_model(model, path: str, meta: dict | None = None) -> str:
    """ML persistence (overwrite; a single model as a one-stage pipeline, which
    records its class, a whole chain as it is) plus a one-row JSON metadata
    table."""
    import json

    from pyspark.sql import SparkSession

    chain = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    chain.write().overwrite().save(path)
    if meta is not None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
             .write.mode("overwrite").json(path.rstrip("/") + "_meta")
    return path


def load_model(path: str):
    """The model or chain that ``save_model`` wrote, whatever its class."""
    chain = PipelineModel.load(path)
    return chain.stages[0] if len(chain.stages) == 1 else chain


def load_meta(spark, path: str) -> dict:
    import json

    row = spark.read.json(path.rstrip("/") + "_meta").first()
    return json.loads(row["meta"]) if row else {}


__all__ = ["feature_vector", "forecast_linear", "forecast_forest", "forecast_boosted",
           "model_comparison", "best_model", "walk_forward_cv", "cv_summary", "what_if", "scenarios",
           "save_model", "load_model", "load_meta", "PipelineModel"]
