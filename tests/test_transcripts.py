"""Text tables written and read, of each layout."""

from pyspark.sql import functions as F

from tessitura.sources import transcripts

NEW = """# Transcription: a: b.mp3
# Duration: 12.50s
# BPM: 67
# Time Signature: 3/4
# Total Bars: 76
# First Downbeat: 0.120s
# BPM Confidence: 0.83
# BPM: fast

Bar.Beat   Time     Chord      Bass         Chords                   Melody
----------------------------------------------------------------------------------------------------
1.1        0.00     D          C2 D2        F#4 A4 x H5              B4 F#4
1.2.50     0.43     Dm?        -            -                        -

# a comment
x.1        1.00     D          C2           -                        -
1.x        1.00     D          C2           -                        -
2          1.66                F2           -                        Bb4
2.1        late     A          A2           -                        F#4
2.3        4.09     Am"""
OLD = """# BPM: 67 | Time Signature: 4/4
Time     Chord        Bass         Chords                       Melody
----
0.00     C            C2           E3 G3                        -
0.10     C            -            E3                           c5 C5"""
SHORT = """Bar.Beat   Time     Chord      Bass     Melody Notes
--------
1.1        0.00     D          C2       -
1.1        0.43     D          D3       B4 F#4"""
PLAIN = """anything
----
0.00     C          C2 z         E3 G3                        C5
bad      C          C2           E3                           C5
----
0.20     C          -            -                            -"""


def files(spark, tmp_path):
    for name, text in (("new", NEW), ("old", OLD), ("short", SHORT), ("plain", PLAIN), ("empty", "")):
        (tmp_path / f"{name}.txt").write_text(text)
    rows = transcripts.read_files(spark, str(tmp_path))
    return rows.withColumn("source_file", F.regexp_extract("source_file", r"(\w+)\.txt", 1))


def test_headers(spark, tmp_path):
    got = {r["source_file"]: tuple(r)[1:] for r in transcripts.headers(files(spark, tmp_path)).collect()}
    none = ("", 0.0, 120.0, "4/4", 0, 0.0, 0.0)
    assert got["new"] == ("a: b.mp3", 12.5, 67.0, "3/4", 76, 0.12, 0.83) and got["old"] == got["short"] == none


def test_slices_of_each_layout(spark, tmp_path):
    got = {}
    for r in transcripts.slices(files(spark, tmp_path)).orderBy("source_file", "line").collect():
        got.setdefault(r["source_file"], []).append(tuple(r)[2:])
    assert got == {
        "new": [
            (0.0, 1, 1, 0.0, "D", ["C2", "D2"], ["F#4", "A4"], ["B4", "F#4"]), (0.43, 1, 2, 0.5, "Dm?", [], [], []),
            (1.66, 2, 1, 0.0, "-", ["F2"], [], ["Bb4"]), (4.09, 2, 3, 0.0, "Am", [], [], []),
        ],
        "old": [(0.0, 1, 1, 0.0, "C", ["C2"], ["E3", "G3"], []), (0.1, 1, 1, 0.0, "C", [], ["E3"], ["C5"])],
        "short": [(0.0, 1, 1, 0.0, "D", ["C2"], [], []), (0.43, 1, 1, 0.0, "D", ["D3"], [], ["B4", "F#4"])],
    }


def test_fixed_columns(spark, tmp_path):
    got = [tuple(r)[2:] for r in transcripts.plain_slices(files(spark, tmp_path)).where("source_file = 'plain'").orderBy("line").collect()]
    assert got == [(0.0, ["C2", "z"], ["E3", "G3"], ["C5"]), (0.2, [], [], [])]


def test_what_is_written_is_read(spark, tmp_path):
    known = spark.createDataFrame([(1, "s.wav", 12_504_000, 66.7, "4/4", 9, 1_500_499, 0.456)], "track_id int, song string, d long, bpm double, sig string, bars int, f long, c double")
    lines = known.select("track_id", transcripts.header_lines(*map(F.col, ["song", "d", "bpm", "sig", "bars", "f", "c"])).alias("head"))
    line = transcripts.slice_line(F.lit("3.2.25"), F.lit(61_230_000), F.lit("Am"), F.array(F.lit("A2")), F.array(F.lit("C4"), F.lit("E4")), F.array().cast("array<string>"))
    transcripts.write_files(lines.select("track_id", F.concat("head", F.array(line)).alias("lines")), str(tmp_path / "out"))
    back = transcripts.read_files(spark, str(tmp_path / "out" / "*"))
    # a text file has a line break after its last line, which is a blank line here
    assert tuple(transcripts.headers(back).first())[1:] == ("s.wav", 12.5, 67.0, "4/4", 9, 1.5, 0.46)
    assert [tuple(r)[2:] for r in transcripts.slices(back).collect()] == [(61.23, 3, 2, 0.25, "Am", ["A2"], ["C4", "E4"], [])]
    assert transcripts.slices(back.limit(0)).count() == transcripts.headers(back.limit(0)).count() == 0
