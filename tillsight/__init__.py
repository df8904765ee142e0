"""tillsight: retail transaction analytics as Spark DataFrame jobs.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects, stays
lazy, and is meant to be chained with ``DataFrame.transform``.
"""

from tillsight.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
