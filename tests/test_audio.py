"""WAV files read in parts, and the passes from files to notes."""

import struct

import numpy as np
import pytest

from tessitura.operators import detection
from tessitura.sources.audio import WavFrames


def wav(path, x, rate=8000, kind=1, bits=16, extra=b""):
    """x (samples, channels) as a file."""
    x = np.asarray(x)
    x = x if x.ndim > 1 else x[:, None]
    raw = b"".join(struct.pack("<i", int(v))[:3] for v in x.reshape(-1)) if bits == 24 else x.astype({(1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}[kind, bits]).tobytes()
    width = x.shape[1] * bits // 8
    fmt = struct.pack("<HHIIHH", kind, x.shape[1], rate, rate * width, width, bits)
    body = extra + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(raw)) + raw
    path.write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    return str(path)


def read(spark, path, **options):
    spark.dataSource.register(WavFrames)
    return spark.read.format("wav_frames").options(**options).load(path)


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(1)


@pytest.mark.parametrize("kind,bits,channels,scale", [(1, 16, 1, 32768), (1, 32, 1, 2**31), (1, 24, 1, 2**23), (1, 8, 1, 1), (3, 32, 1, 1), (3, 64, 1, 1), (1, 16, 2, 1), (1, 24, 3, 2**-8)])
def test_kinds_of_samples(spark, tmp_path, rng, kind, bits, channels, scale):
    x = rng.normal(0, 1, (50, channels)).astype("f4").astype(float) if kind == 3 else rng.integers(0, 256, (50, channels)) if bits == 8 else rng.integers(-(2 ** (bits - 1)), 2 ** (bits - 1), (50, channels))
    got = read(spark, wav(tmp_path / "a.wav", x, kind=kind, bits=bits, extra=b"LIST\x03\x00\x00\x00abc\x00"), size=50).collect()
    assert len(got) == 1 and got[0]["sample_rate"] == 8000 and np.allclose(got[0]["samples"], x.astype(float).mean(axis=1) / scale, rtol=1e-12)


@pytest.mark.parametrize("part", [100, 999, 8 << 20])
def test_one_long_file_is_many_tasks(spark, tmp_path, rng, part):
    x = rng.integers(-30000, 30000, 5000)
    path = wav(tmp_path / "a.wav", x)
    for options in ({"size": 256, "hop": 100}, {"size": 64, "hop": 64, "pad": "true"}, {"size": 7, "hop": 300}):
        df = read(spark, path, part=part, **options)
        assert df.rdd.getNumPartitions() == max(1, -(-(5000 * 2 + 44) // part))
        size, hop = options["size"], options["hop"]
        want = {k: x[k * hop : k * hop + size] / 32768 for k in range(5000) if k * hop < 5000 and ("pad" in options or k * hop + size <= 5000)}
        got = {r["frame_idx"]: (r["start"], r["samples"]) for r in df.collect()}
        assert set(got) == set(want) and all(got[k] == (k * hop, [*want[k], *[0.0] * (size - len(want[k]))]) for k in want)


@pytest.mark.parametrize("part", [500, 8 << 20])
def test_frames_around_multiples_of_a_time(spark, tmp_path, rng, part):
    x = rng.integers(-30000, 30000, 4001)
    got = {r["frame_idx"]: (r["start"], r["samples"]) for r in read(spark, wav(tmp_path / "a.wav", x), size=1000, every=0.1, part=part).collect()}
    padded = np.concatenate((x / 32768, np.zeros(1000)))
    assert got == {k: (s, padded[s : s + 1000].tolist()) for k in range(6) for s in [max(0, k * 800 - 500)]}


def test_folders_and_files_that_are_none(spark, tmp_path, rng):
    wav(tmp_path / "a.wav", rng.integers(-9, 9, 100))
    (tmp_path / "sub").mkdir()
    wav(tmp_path / "sub" / "b.WAV", rng.integers(-9, 9, 250))
    wav(tmp_path / "empty.wav", np.zeros(0))
    (tmp_path / "notes.txt").write_text("x")
    rows = read(spark, str(tmp_path), size=100).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["frame_idx"]) for r in rows) == [("a.wav", 0), ("b.WAV", 0), ("b.WAV", 1)]
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    with pytest.raises(Exception, match="no WAV file"):
        read(spark, str(tmp_path / "bad.wav")).collect()
    with pytest.raises(Exception, match="FileNotFound|no.wav"):
        read(spark, str(tmp_path / "no.wav")).collect()


def test_from_a_file_to_notes(spark, tmp_path):
    rate = 22050
    t = np.arange(rate * 2) / rate
    tone = lambda m: sum(0.5**n * np.sin(2 * np.pi * (n + 1) * 440 * 2 ** ((m - 69) / 12) * t) for n in range(3))
    x = np.where(t < 1, tone(60) + tone(64), tone(57) + tone(65)) * 4000
    path = wav(tmp_path / "a.wav", x.astype(int), rate=rate)
    slices = read(spark, path, size=8192, every=0.25, part=20_000).selectExpr("1 as track_id", "frame_idx", "samples")
    found = {}
    for r in detection.chord_notes(slices, "samples", rate).where("role = 'chord'").collect():
        found.setdefault(r["frame_idx"], set()).add(r["midi"])
    assert found[2] >= {60, 64} and found[6] >= {57, 65} and not found[2] & {57, 65}
    blocks = read(spark, path, size=8192, pad="true").selectExpr("1 as track_id", "frame_idx", "samples")
    times = spark.createDataFrame([(1, 500_000, "a"), (1, 1_500_000, "b"), (1, 1_999_000, "c"), (1, 9_000_000, "d"), (2, 5, "e")], "track_id int, t_us long, name string")
    frames = {r["name"]: r["frame"] for r in detection.frames_at(blocks, times, rate, 8192).collect()}
    exact = np.concatenate((x.astype(int) / 32768, np.zeros(8192)))
    assert all(len(f) == 8192 for f in frames.values()) and not any(frames["d"]) and not any(frames["e"])
    for name, s in (("a", 0.5), ("b", 1.5), ("c", 1.999)):
        at = int(s * rate) - 4096
        assert frames[name] == exact[at : at + 8192].tolist()
    melody = detection.melody_notes(blocks, times.where("name in ('a', 'b')"), rate).collect()
    assert {(r["name"], r["role"]) for r in melody} and all(r["freq"] >= 300 for r in melody)


def test_tones_claim_their_harmonics():
    freq, amp = np.array([100.0, 150.0, 200.0, 301.0, 350.0, 450.0]), np.array([5.0, 4, 3, 2, 1, 6])
    got = detection.claimed_tones(freq, amp, 10)
    assert [(t["freq"], [(h["freq"], h["number"]) for h in t["harmonics"]]) for t in got] == [(100.0, [(200.0, 2), (301.0, 3)]), (150.0, [(450.0, 3)]), (350.0, [])]
    assert [t["freq"] for t in detection.claimed_tones(freq, amp, 1)] == [100.0] and detection.claimed_tones(freq[:0], amp[:0], 3) == []
