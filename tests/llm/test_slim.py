"""Each stage of the pipeline starts with executors that gave back their heap."""
import corpus_pipeline
from tillsight.llm import common


def collected(spark):
    """Full collections of the JVM so far."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_garbage_of_all_cores_is_collected(spark):
    before = collected(spark)
    common.slim(spark)
    assert collected(spark) > before


def test_stage_starts_without_earlier_garbage(spark):
    seen = []

    @corpus_pipeline.fresh
    def step(session, docs, sf_dir):
        seen.append(collected(session))
        return docs

    before = collected(spark)
    docs = spark.range(3)
    assert step(spark, docs, "none") is docs and seen[0] > before
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
