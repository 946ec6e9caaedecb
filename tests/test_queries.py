"""Every query with SQL gives the SQL's rows in DuckDB; chords give the expected names."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessitura import registry
from tessitura.operators import harmony, playability, tempo
from tessitura.sources import documents

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    got, want = registry.QUERIES[name](spark, DATA), db.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda rows: sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in rows)
    columns = sorted(got.columns)
    assert text(map(tuple, got.select(*columns).collect())) == text(want.select(*columns).fetchall())


@pytest.mark.parametrize("midis,strict,plain", [
    ([60, 64, 67], "C", "C"), ([60, 63, 67], "Cm", "Cm"), ([60, 64, 67, 71], "Cmaj7", "C"), ([60, 64, 67, 70], "C7", "C"), ([60, 63, 67, 70], "Cmin7", "Cm"),
    ([62, 65, 69], "Dm", "Dm"), ([67, 71, 74, 77], "G7", "G"), ([60, 65, 67], "Csus4", "C5"), ([60, 62, 67], "Csus2", "C5"), ([60, 64, 68], "Caug", "Caug"),
    ([60, 63, 66], "Cdim", "Cdim"), ([60, 64, 67, 69], "C", "C"), ([60, 64, 67, 70, 74], "C7", "C"), ([57, 60, 64, 67], "Amin7", "Am"), ([60], None, None),
    ([], None, None), (None, None, None), ([None, 60, 64, 67], "C", "C"), ([49, 50, 71, 78, 79], "Gmaj7", "Bm"),
])
def test_chord_names(spark, midis, strict, plain):
    rows = spark.createDataFrame([(midis,)], "midis array<int>")
    r = harmony.chord(harmony.strict_chord(rows, "midis", "strict"), "midis", "plain").first()
    assert ((r["strict"] or {"name": None})["name"], (r["plain"] or {"name": None})["name"]) == (strict, plain)


def test_entry_imports_and_has_the_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("notes,span,most,prefer,kept", [
    ([60], 12, 5, "outer", [60]), ([67, 60, 64, 60], 12, 5, "outer", [60, 64, 67]), ([40, 60, 64, 67], 12, 5, "outer", [60, 64, 67]),
    ([60, 61, 62, 63, 64, 65, 66], 12, 5, "outer", [60, 61, 62, 63, 66]), ([60, 61, 62, 63, 64, 65, 66], 12, 5, "lowest", [60, 61, 62, 63, 64]),
    ([60, 61, 62, 63, 64, 65, 66], 12, 5, "highest", [62, 63, 64, 65, 66]), ([48, 50, 70, 72], 5, 5, "highest", [70, 72]), ([48, 50, 70, 72], 5, 5, "lowest", [48, 50]), ([], 12, 5, "outer", []),
])
def test_hand_span(spark, notes, span, most, prefer, kept):
    rows = spark.createDataFrame([(notes,)], "midis array<int>")
    assert rows.select(playability.hand_span(F.col("midis"), span, most, prefer).alias("k")).first()["k"] == kept


def test_downbeat_of_a_click_track(spark):
    clicks = [(1, 700_000 + 500_000 * k) for k in range(20)] + [(1, 333_000), (2, 5_000_000)]
    rows = spark.createDataFrame(clicks, "track_id long, t_us long")
    assert {tuple(r) for r in tempo.first_downbeat(rows, 120.0).collect()} == {(1, 700_000), (2, 5_000_000)}
    assert tempo.first_downbeat(rows.limit(0), 120.0).count() == 0
    best = tempo.best_lag(tempo.autocorrelation(rows.where("t_us <> 333000"), 100_000, 8)).collect()
    assert [(r["track_id"], r["lag"]) for r in best] == [(1, 5)]


def test_segment_lines_read_back(spark, tmp_path):
    lines = registry.QUERIES["segment_lines"](spark, DATA)
    path = str(tmp_path / "lines")
    documents.write_segment_lines(lines.select("line").unionByName(spark.createDataFrame([("# BPM: 67",), ("-" * 80,), ("",)], "line string")), path)
    want = registry.QUERIES["chord_segments"](spark, DATA)
    back = documents.read_segment_lines(spark, path).select(F.rint(F.col("time") * 100).cast("long").alias("cents"), "chord")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.select(F.expr("(start_us + 5000) div 10000").alias("cents"), "chord").collect()))
    documents.write_json(want, str(tmp_path / "json"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in want.schema)
    again = documents.read_json(spark, str(tmp_path / "json"), schema).select(*want.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, want.collect()))
