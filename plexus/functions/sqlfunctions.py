"""SQL-callable helpers over model expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """plexus_glob(pattern, text) and plexus_parent(id) as SQL functions: expressions of the JVM, no Python per row."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION plexus_glob(pattern STRING, text STRING) RETURNS BOOLEAN RETURN text RLIKE concat('(?s)^', replace(replace(regexp_replace(pattern, '([\\\\^$.|+(){}\\[\\]])', '\\\\$1'), '*', '.*'), '?', '.'), '$')")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION plexus_parent(id STRING) RETURNS STRING RETURN CASE WHEN instr(id, '.') > 0 THEN regexp_extract(id, '(?s)^(.*)\\.[^.]*$', 1) END")
