"""intentloom: few-shot text-classification data work as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns), so steps chain
with ``df.transform``.  Random order everywhere is a seeded md5 of the row key,
which makes every sample reproducible on any number of partitions and checkable
against plain SQL.
"""

from intentloom.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
