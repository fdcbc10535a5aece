"""Feature construction from signals and beats against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.functions import loudness as L
from resona.operators import spectral as S

RNG = np.random.default_rng(2)


def periodogram_plain(x, window):
    hann = np.hanning(window)
    power = np.abs(np.fft.fft(x * hann, window)) ** 2 / (hann @ hann)
    power[1:-2] *= 2
    return (power / (2 * np.pi))[: window // 2 + 1]


def phon_plain(db):
    curves = L.band_loudness()
    out = np.full_like(db, 3.0)
    for b in range(24):
        for t in range(db.shape[1]):
            for level in range(5):
                if db[b, t] > curves[b][level]:
                    share = (db[b, t] - curves[b][level]) / (curves[b][level + 1] - curves[b][level])
                    out[b, t] = L.PHON[level] + share * (L.PHON[level + 1] - L.PHON[level])
    return out


def sonogram_plain(signal, samplerate, window):
    frames = (len(signal) - window) // (window // 2) + 1
    power = np.stack([periodogram_plain(signal[i * window // 2 : i * window // 2 + window], window) for i in range(frames)]).T
    axis = np.linspace(0, samplerate / 2, window // 2 + 1)
    edges = [0, *L.BARK]
    bands = np.stack([power[(axis >= lo) & (axis < hi)].sum(axis=0) for lo, hi in zip(edges, edges[1:])])
    db = 10 * np.log10(np.maximum(L.spreading() @ bands, 1))
    phon = phon_plain(db)
    return np.where(phon >= 40, 2 ** ((phon - 40) / 10), (phon / 40) ** 2.642)


SIZE, WINDOW, RATE = 512, 64, 44100


@pytest.fixture(scope="module")
def waves(spark):
    signals = {"a": RNG.normal(size=SIZE * 3 + 100) * 0.1, "b": RNG.normal(size=SIZE + 7) * 0.01}
    rows = [(k, i, float(v)) for k, s in signals.items() for i, v in enumerate(s)]
    return signals, spark.createDataFrame(rows, "id string, sample long, value double").repartition(4)


def test_constants():
    curves = L.band_loudness()
    assert curves.shape == (24, 6)
    assert np.allclose(curves[0], [24, 37, 51, 70, 88, 105])  # 100 Hz is in the table
    assert np.allclose(curves[-1], [35, 50, 70, 90, 105, 115])
    assert np.allclose(L.spreading()[0, 0], 10 ** ((15.81 + 7.5 * 0.474 - 17.5 * (1 + 0.474**2) ** 0.5) / 10))


def test_segments_skip_and_step(spark):
    rows = spark.range(0, 1000).select(F.lit(1).alias("id"), F.col("id").alias("sample"), F.lit(1.0).alias("value"))

    def found(**options):
        cut = S.segments(rows, 100, 10.0, **options)
        return {r["segment"]: r["start"] for r in S.segment_positions(cut, 100, 10.0).collect()}

    assert found(skip=1) == {i: 100 * (i + 1) for i in range(8)}
    assert found(skip=0, step=3) == {0: 0, 1: 300, 2: 600, 3: 900}
    assert found(skip=2, step=2) == {0: 200, 1: 400, 2: 600}
    assert found(skip=1, step=2, min_duration=1e6) == {i: 100 * i for i in range(10)}
    short = rows.filter("sample < 50")
    assert S.segments(short, 100, 10.0).count() == 0


def test_sonogram_chain(spark, waves):
    signals, samples = waves
    cut = S.segments(samples, SIZE, RATE)
    spectra = S.spectrogram(cut, SIZE, WINDOW)
    got = {(r["id"], r["segment"], r["frame"]): r["bands"] for r in S.sonogram(spectra, RATE, WINDOW).collect()}
    frames = (SIZE - WINDOW) // (WINDOW // 2) + 1
    assert len(got) == 4 * frames
    for track, segment in [("a", 0), ("a", 2), ("b", 0)]:
        part = signals[track][segment * SIZE : (segment + 1) * SIZE] * S.HEARING_THRESHOLD
        expected = sonogram_plain(part, RATE, WINDOW)
        mine = np.array([got[(track, segment, f)] for f in range(frames)]).T
        assert np.allclose(mine, expected, rtol=1e-8, atol=1e-10)


def test_rhythm_features(spark, waves):
    signals, samples = waves
    features = S.rhythm_features(samples, RATE, (SIZE, WINDOW), skip=1)
    frames = (SIZE - WINDOW) // (WINDOW // 2) + 1
    bins = 2 * SIZE // WINDOW - 2
    fft = 1 << int(np.ceil(np.log2(frames)))
    segments = []
    for s in range(3):
        sono = sonogram_plain(signals["a"][s * SIZE : (s + 1) * SIZE] * S.HEARING_THRESHOLD, RATE, WINDOW)
        segments.append((sono, np.abs(np.fft.fft(sono, fft))[:, 1 : bins + 1] / 256))
    hertz = RATE / SIZE * np.arange(1, bins + 1)
    rp = np.median([m / (hertz / 4 + 4 / hertz) for _, m in segments], axis=0)
    rh = np.median([m.sum(axis=0) for _, m in segments], axis=0)
    mine = {(r["band"], r["bin"]): r["rp"] for r in features["rp"].filter("id = 'a'").collect()}
    assert np.allclose([[mine[(b, k + 1)] for k in range(bins)] for b in range(24)], rp)
    mine = {r["bin"]: r["rh"] for r in features["rh"].filter("id = 'a'").collect()}
    assert np.allclose([mine[k + 1] for k in range(bins)], rh)
    ssd = {r["band"]: r for r in features["ssd"].filter("id = 'a'").collect()}
    assert np.allclose([ssd[b]["mean"] for b in range(24)], np.mean([s.mean(axis=1) for s, _ in segments], axis=0))
    assert np.allclose([ssd[b]["median"] for b in range(24)], np.mean([np.median(s, axis=1) for s, _ in segments], axis=0))
    mvd = {r["bin"]: r for r in features["mvd"].filter("id = 'a'").collect()}
    assert np.allclose([mvd[k + 1]["var"] for k in range(bins)], np.mean([m.var(axis=0) for _, m in segments], axis=0))
    trh = {r["bin"]: r for r in features["trh"].filter("id = 'a'").collect()}
    assert np.allclose([trh[k + 1]["max"] for k in range(bins)], np.max([m.sum(axis=0) for _, m in segments], axis=0))
    assert features["tssd"].filter("id = 'a'").count() == 24 * 7
    vector = S.as_vectors(features["rp"], ["bin", "band"], "rp", "rp").filter("id = 'a'").collect()[0]["rp"]
    assert np.allclose(vector, rp.T.ravel())  # all bands of a bin together, bin after bin


def test_unknown_rate_and_too_many_bins(spark, waves):
    with pytest.raises(ValueError):
        S.rhythm_features(waves[1], 48000)


def test_mel_filters():
    filters = L.mel_filters(22050, 512, 40)
    axis = np.linspace(0, 11025, 257)
    assert filters.shape == (40, 257) and (filters >= 0).all()
    centres = axis[filters.argmax(axis=1)]
    assert (np.diff(centres) >= 0).all()
    low = L.mel_filters(22050, 4096, 20, 0.0, 1000.0)
    peaks = np.linspace(0, 11025, 2049)[low.argmax(axis=1)]
    assert np.allclose(np.diff(peaks), 1000 / 21, atol=6)  # evenly spaced below 1000 Hz


def test_beats(spark):
    frames = RNG.random((200, 12))
    frames[20:40] *= 0.01
    frames /= frames.max(axis=1, keepdims=True)
    frames[30:35] = 0
    beats = sorted(RNG.choice(np.arange(5, 180), 12, replace=False).tolist())
    f = spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(frames)], "id int, frame long, vec array<double>").repartition(5)
    b = spark.createDataFrame([(1, int(x)) for x in beats], "id int, frame long").repartition(3)
    clear = frames.copy()
    limit = frames.sum() / len(frames) / 2
    for row in clear:
        if row.sum() > limit:
            row[row == row.max()] = 1
            row[row < 0.8] = 0
        else:
            row[:] = 0
    for width in (7, 4096):
        means = {r["beat"]: r["vec"] for r in S.beat_means(f, b, 12, width).collect()}
        notes = {r["beat"]: r["note"] for r in S.notes_of_beats(f, b, 12, width).collect()}
        previous = 0
        for i, beat in enumerate(beats):
            part = frames[previous:beat].mean(axis=0)
            norm = np.abs(part).sum()
            assert np.allclose(means[i], part / norm if norm else part)
            assert notes[i] == int(clear[previous:beat].sum(axis=0).argmax())
            previous = beat
    histogram = {r["bin"]: r["n"] for r in S.beat_histogram(b, rate=10.0).collect()}
    bpm = np.floor(60 / (np.diff(beats) / 10.0)).astype(int)
    assert histogram == {int(k): int((np.minimum(bpm, 249) == k).sum()) for k in set(np.minimum(bpm, 249))}
    assert sum(histogram.values()) == len(beats) - 1
    coarse = {r["bin"]: r["n"] for r in S.beat_histogram(b, bins=5, rate=10.0).collect()}
    assert coarse[4] == int((bpm >= 4).sum())  # nothing is lost beyond the last bin


def test_a_long_track_is_many_keys(spark):
    """One track with most of all rows: the largest task of the join that brings facts has a small share of them."""
    size = 64
    long = spark.range(size * 200).select(F.lit("long").alias("id"), F.col("id").alias("sample"))
    rest = spark.range(size * 30).select(F.concat(F.lit("t"), F.col("id") % 10).alias("id"), F.floor(F.col("id") / 10).alias("sample"))
    samples = long.unionByName(rest).withColumn("value", F.col("sample") / 7)
    ranged, facts = S.with_ranges(samples, "sample", size, (F.max("sample") + 1).alias("n"))
    assert facts.filter("id = 'long'").count() == 200 and facts.filter("id = 'long' and n = 12800").count() == 200
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cut = S.segments(samples, size, 44100.0, skip=0, min_duration=0.0)
        parts = [r["n"] for r in cut.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        # eight partitions: a join on the bare id would put all of the long track in one
        assert sum(parts) == size * 200 + 10 * 3 * size and max(parts) < 0.3 * sum(parts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
