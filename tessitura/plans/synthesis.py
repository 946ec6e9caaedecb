"""Queries on sound from notes, with the SQL that gives the same rows, sample by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import scalars
from tessitura.operators import synthesis
from tessitura.plans.queries import DET
from tessitura.sources import adapters

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {DET}, n AS (SELECT track_id, slice_idx, role, 440.0::DOUBLE * pow(2.0, (midi - 69) / 12.0::DOUBLE) AS freq, amp * confidence AS amp FROM det WHERE role IN ('bass', 'chord', 'melody')
    QUALIFY row_number() OVER (PARTITION BY track_id, slice_idx, role ORDER BY midi, event_id) <= CASE role WHEN 'bass' THEN 4 WHEN 'chord' THEN 6 ELSE 3 END),
  h AS (SELECT track_id, slice_idx, role, freq, amp FROM n UNION ALL SELECT track_id, slice_idx, role, freq * 3, amp / 3 FROM n WHERE freq * 3 < 1000),
  s AS (SELECT track_id, role AS stem, slice_idx * 16 + i AS k, sum(amp * sin(2 * pi() * freq * i / 2000) * (0.5 - 0.5 * cos(2 * pi() * i / 40))) AS v FROM h, (SELECT unnest(range(40)) AS i) GROUP BY ALL),
  m AS (SELECT * FROM s UNION ALL SELECT track_id, 'combined', k, sum(v * CASE stem WHEN 'bass' THEN 0.9::DOUBLE WHEN 'chord' THEN 0.7::DOUBLE ELSE 1 END) FROM s GROUP BY track_id, k),
  p AS (SELECT *, v / max(abs(v)) OVER (PARTITION BY track_id, stem) * (0.9::DOUBLE * 32767) AS x FROM m), b AS (SELECT track_id, stem, k // 16 AS block, sum(trunc(x)) AS total, sum(abs(trunc(x))) AS size, CASE WHEN count(*) < 16 THEN greatest(max(trunc(x)), 0) ELSE max(trunc(x)) END AS top FROM p GROUP BY ALL)
SELECT track_id, stem, block, total::BIGINT AS total, size::BIGINT AS size, top::BIGINT AS top FROM b""")
def resynthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the samples of each block of what the notes of slices sound like at 2 kHz, of windows of 40 samples."""
    det = adapters.detections(spark, sf_dir)
    freq = scalars.midi_to_freq(F.col("midi"))
    notes = det.select("track_id", "slice_idx", "role", "midi", "event_id", freq.alias("freq"), "amp", "confidence", F.array(F.struct((freq * 3).alias("freq"), (F.col("amp") / 3).alias("amp"))).alias("harmonics"))
    blocks = synthesis.resynthesised(notes, 2000.0, 40, 16, ("midi", "event_id"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return blocks.select("track_id", "stem", "block", add(F.col("samples")).alias("total"), add(F.transform("samples", lambda x: F.abs(x))).alias("size"), F.array_max("samples").cast("long").alias("top"))
