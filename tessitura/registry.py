"""Query name -> how Spark runs it, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessitura.plans import detection, fusion, music, queries, synthesis, tempi, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = queries.QUERIES | music.QUERIES | fusion.QUERIES | detection.QUERIES | tempi.QUERIES | synthesis.QUERIES | transcripts.QUERIES
ORACLE_SQL: dict[str, str] = queries.ORACLE_SQL | music.ORACLE_SQL | fusion.ORACLE_SQL | detection.ORACLE_SQL | tempi.ORACLE_SQL | synthesis.ORACLE_SQL | transcripts.ORACLE_SQL
FLAGSHIP = queries.chord_segments
