"""The churn fits have tasks of bounded size."""
from tillsight.ml import churn as CH


def test_fits_of_more_rows_have_more_tasks(spark, monkeypatch):
    cores, parts, forest = spark.sparkContext.defaultParallelism, [], CH.churn_forest
    rows = [(i, i * 7 % 50, i % 9 + 1, float(i * 13 % 101), 1.0 + i % 5, 1.0, int(i % 3 == 0)) for i in range(8 * cores)]
    feats = spark.createDataFrame(rows, "CustomerID long, recency long, frequency long, monetary double, avg_basket_size double, "
                                        "purchase_frequency_per_month double, churned int")
    monkeypatch.setattr(CH, "FIT_ROWS", 3)
    monkeypatch.setattr(CH, "churn_forest", lambda train, **kw: parts.append(train.rdd.getNumPartitions()) or forest(train, **kw))
    table, _, data = CH.churn_comparison(feats, trees=2)
    assert parts == [3 * cores] and data.count() == len(rows) and table.count() == 2
