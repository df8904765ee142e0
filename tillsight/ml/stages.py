"""Persistable stages around MLlib's models, so that a whole scoring chain
(scaler, model, labels or risk levels) is one saved ``PipelineModel``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.scalars import round_even
from tillsight.ml.tabled import TableModel


class Scaler(TableModel):
    """Adds ``{column}_z`` = (x - mean) / population deviation (a deviation of
    0 leaves the centred value), and the column as a double."""

    SCHEMA = "name string, mean double, deviation double"

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({c: F.col(c).cast("double") for c, _, _ in self.rows})
        return out.withColumns({f"{c}_z": (F.col(c) - F.lit(m)) / F.lit(s or 1.0) for c, m, s in self.rows})


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """Mean and deviation of each column, from one aggregate row."""
    row = df.agg(*(x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first()
    return Scaler([(c, float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0)) for c in cols])


class ClusterLabels(TableModel):
    """Adds ``segment``, the name of each row's ``cluster`` (null without one)."""

    SCHEMA = "cluster int, segment string"

    def _transform(self, df: DataFrame) -> DataFrame:
        names = [x for c, name in self.rows for x in (F.lit(c), F.lit(name))]
        found = F.try_element_at(F.create_map(*names), F.col("cluster")) if names else F.lit(None).cast("string")
        return df.withColumn("segment", found)


class RiskLevels(TableModel):
    """Adds ``churn_probability`` (4 dp) from the classifier's ``probability``
    and ``risk_level``, the first level whose upper end holds it."""

    SCHEMA = "upto double, level string"

    def _transform(self, df: DataFrame) -> DataFrame:
        level = F.lit(None).cast("string")
        for upto, name in reversed(self.rows):
            level = F.when(F.col("churn_probability") <= F.lit(upto), F.lit(name)).otherwise(level)
        return df.withColumn("churn_probability", round_even(vector_to_array("probability")[1], 4)).withColumn("risk_level", level)
