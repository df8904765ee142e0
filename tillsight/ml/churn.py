"""Churn classification: split, class weights, two MLlib models, metrics,
scoring of every customer, feature importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.scalars import round_even
from tillsight.ml.parallel import fit_all
from tillsight.ml.stages import RiskLevels, fit_scaler
from tillsight.operators.metrics import balanced_weights, binary_metrics, standardize
from tillsight.operators.ranking import global_rank
from tillsight.operators.reporting import risk_level
from tillsight.schema import CHURN_FEATURES
from tillsight.session import materialize
from tillsight.functions.scalars import with_scalars

LABEL = "churned"

#: Rows of one task of a fit, about. The forest holds counts and node ids of each
#: row for every tree (some 4 KB for 300 trees).
FIT_ROWS = 100_000


def stratified_split(df: DataFrame, label: str = LABEL, train_frac: float = 0.75, seed: int = 42,
                     key: str = "CustomerID") -> DataFrame:
    """Add ``split`` = train/test: of each class, the ``train_frac`` of the rows
    (rounded half up) with the smallest hash of (key, seed).

    Where some class has a single row, the classes are not told apart. The
    keys are unique; a null label is a class of its own. The rank in a class
    comes from one bucketed rank of class + hash over all rows
    (``global_rank``), so that no class is sorted in one task; the broadcast
    table has one row a class."""
    hashed = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    u = F.conv(F.substring(hashed, 1, 9), 16, 10).cast("double") / float(16 ** 9)
    rows = materialize(df.withColumn("_cls", F.coalesce(F.col(label).cast("double"), F.lit(-1.0))))
    everything = Window.partitionBy()
    classes = (rows.groupBy("_cls").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_apart", F.min("_n").over(everything) > 1)
               .withColumn("_before", F.sum("_n").over(Window.orderBy("_cls")) - F.col("_n"))
               .select("_cls", F.when(F.col("_apart"), F.col("_cls")).otherwise(0.0).alias("_base"),
                       F.when(F.col("_apart"), F.col("_before")).otherwise(0).alias("_skip"),
                       F.when(F.col("_apart"), F.col("_n")).otherwise(F.sum("_n").over(everything)).alias("_of")))
    ranked = global_rank(rows.join(F.broadcast(classes), "_cls").withColumn("_at", F.col("_base") + u),
                         "_at", key, out="_rank")
    inside = F.col("_rank") - F.col("_skip") <= F.floor(F.col("_of") * F.lit(train_frac) + F.lit(0.5))
    return ranked.select(*df.columns, F.when(inside, F.lit("train")).otherwise(F.lit("test")).alias("split"))


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(
        df.withColumns({c: F.col(c).cast("double") for c in cols}))


def churn_logistic(train: DataFrame, n_train: int, label: str = LABEL):
    """L2 logistic regression, C = 1 on the summed loss, balanced weights,
    on standardized features. MLlib minimizes the *mean* weighted loss, so
    C = 1 maps to regParam = 1 / sum(weights) = 1 / n with balanced weights."""
    return LogisticRegression(featuresCol="features_z", labelCol=label, weightCol="weight",
                              regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                              standardization=False, maxIter=1000).fit(train)


def churn_forest(train: DataFrame, label: str = LABEL, trees: int = 300, depth: int = 6, seed: int = 42):
    """Random forest, balanced weights, sqrt(#features) candidates per split."""
    return RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight",
                                  numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt",
                                  seed=seed, maxMemoryInMB=1024, cacheNodeIds=True).fit(train)


def prepare(feats: DataFrame, cols: Sequence[str] = CHURN_FEATURES, label: str = LABEL,
            seed: int = 42) -> DataFrame:
    """Split, weight (from the train rows' class counts), raw and
    standardized feature vectors. Scaling statistics come from the train
    rows only, like a scaler fitted on the training split."""
    split = stratified_split(feats, label, seed=seed)
    train = split.filter(F.col("split") == "train")
    weights = (train.groupBy(label).agg(F.count(F.lit(1)).alias("_c")))
    tot = train.agg(F.count(F.lit(1)).alias("_n"))
    w = with_scalars(weights, tot).select(label, (F.col("_n") / (F.lit(2.0) * F.col("_c"))).alias("weight"))
    stats = train.agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"),
                                                   F.stddev_pop(c).alias(f"_s_{c}"))])
    out = with_scalars(split.join(F.broadcast(w), label, "left"), stats)
    for c in cols:
        s = F.col(f"_s_{c}")
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"_m_{c}")) / F.when(s == 0, 1.0).otherwise(s))
    out = out.drop(*[f"_{k}_{c}" for c in cols for k in ("m", "s")])
    out = assemble(out, cols, "features")
    return assemble(out, [f"{c}_z" for c in cols], "features_z")


def _p1(col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col))[1]


def churn_comparison(feats: DataFrame, trees: int = 300, seed: int = 42) -> tuple[DataFrame, dict, DataFrame]:
    """Fit both models on the train split and evaluate the test split in one
    grouped metric job. Returns (table sorted by ROC_AUC desc, models,
    prepared data). The fits have more tasks, not larger ones, for more rows."""
    feats = materialize(feats)
    cores = feats.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-feats.count() // (FIT_ROWS * cores)))
    data = materialize(prepare(feats, seed=seed).repartition(tasks))
    train = data.filter(F.col("split") == "train")
    if tasks > cores:  # a scan may have joined the files to fewer parts again
        train = train.repartition(tasks)
    test = data.filter(F.col("split") == "test")
    n_train = train.count()
    fits = {"Logistic Regression": lambda: churn_logistic(train, n_train),
            "Random Forest": lambda: churn_forest(train, trees=trees, seed=seed)}
    # the two fits are independent: submitted together
    models = dict(zip(fits, fit_all(lambda name: fits[name](), list(fits))))
    scored = None
    for name, m in models.items():
        s = m.transform(test).select(F.lit(name).alias("model"), F.col(LABEL).alias("label"),
                                     F.col("prediction").cast("int").alias("prediction"),
                                     _p1().alias("score"))
        scored = s if scored is None else scored.unionByName(s)
    table = binary_metrics(scored, by=["model"]).orderBy(F.desc("ROC_AUC"), F.asc("model"))
    return table, models, data


def churn_score(model, data: DataFrame) -> DataFrame:
    """Probability (4 dp) and risk level for every customer, most at risk
    first (ties by CustomerID)."""
    scored = model.transform(data)
    return (scored.select("CustomerID", "recency", "frequency", "monetary", "avg_basket_size",
                          "purchase_frequency_per_month", LABEL,
                          round_even(_p1(), 4).alias("churn_probability"))
                  .withColumn("risk_level", risk_level(F.col("churn_probability")))
                  .orderBy(F.desc("churn_probability"), F.asc("CustomerID")))


def churn_pipeline(model, data: DataFrame, cols: Sequence[str] = CHURN_FEATURES) -> PipelineModel:
    """Scaler (of the train rows), vectors, classifier and risk levels as one
    saved chain, for customers the fit has never seen. ``model`` and ``data``
    come from ``churn_comparison``."""
    scaler = fit_scaler(data.filter(F.col("split") == "train"), cols)
    raw = VectorAssembler(inputCols=list(cols), outputCol="features")
    scaled = VectorAssembler(inputCols=[f"{c}_z" for c in cols], outputCol="features_z")
    return PipelineModel(stages=[scaler, raw, scaled, model, RiskLevels([(0.3, "Low"), (0.6, "Medium"), (float("inf"), "High")])])


def score_customers(pipeline: PipelineModel, feats: DataFrame, cols: Sequence[str] = CHURN_FEATURES, key: str = "CustomerID") -> DataFrame:
    """Probability and risk level of any customers with the model's features,
    most at risk first (ties by ``key``). No label and no split is needed."""
    return pipeline.transform(feats.select(key, *cols)).select(key, *cols, "churn_probability", "risk_level").orderBy(
        F.desc("churn_probability"), F.asc(key))


def churn_importance(model, cols: Sequence[str] = CHURN_FEATURES) -> DataFrame:
    """Forest importances, or absolute logistic coefficients, sorted."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    else:
        vals = [abs(x) for x in model.coefficients.toArray().tolist()]
    return spark.createDataFrame(list(zip(cols, [float(v) for v in vals])),
                                 "feature string, importance double").orderBy(F.desc("importance"))


__all__ = ["stratified_split", "churn_logistic", "churn_forest", "prepare", "churn_comparison",
           "churn_score", "churn_importance", "balanced_weights", "standardize"]
