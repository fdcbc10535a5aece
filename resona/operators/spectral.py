"""Feature construction as grouped jobs over samples, frames, beats and segments.

samples   (id, sample, value)           one row per sample, missing ones are silence
spectra   (id, segment, frame, power)   power: array of window/2 + 1 bins
sonogram  (id, segment, frame, bands)   bands: array, one value per critical band
modulation(id, segment, band, bin, value)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.functions import kernels, loudness, vectors
from resona.operators.reuse import shared
from resona.operators.statistics import SEVEN, median_per_group, positions, seven_statistics

# fixed values: segment and window length per sample rate, and the hearing threshold factor
SIZES = {11025: (1 << 16, 256), 22050: (1 << 17, 512), 44100: (1 << 18, 1024)}
HEARING_THRESHOLD = 0.0875 * (1 << 15)
MIN_DURATION = 45.0
MODULATION_BINS = 60


def mix_channels(samples: DataFrame) -> DataFrame:
    """Mean over the channels of a sample."""
    return samples.groupBy("id", "sample").agg(F.avg("value").alias("value"))


def segments(
    samples: DataFrame,
    size: int,
    samplerate: float,
    skip: int = 1,
    step: int = 1,
    min_duration: float = MIN_DURATION,
) -> DataFrame:
    """Samples of the analysed segments with `segment` and `offset` in it.

    `skip` segments are left out at both ends and every `step`-th is taken, except for tracks
    shorter than `min_duration` seconds, which are taken whole. A last incomplete one is dropped.

    Which segments are taken is decided on a row per segment; samples meet those on (id, range), so a track with
    half of all samples is as many keys as it has segments.
    """
    ranged, facts = with_ranges(samples, "sample", size, (F.max("sample") + 1).alias("_n"))
    short = (F.col("_n") / samplerate) < min_duration
    facts = facts.withColumns({"_skip": F.when(short, 0).otherwise(skip), "_step": F.when(short, 1).otherwise(step)})
    inside = F.floor((F.col("_n") - F.col("_skip") * 2 * size) / size)
    count = F.floor((inside - 1) / F.col("_step")) + 1
    taken = (
        facts.withColumns({"_place": F.col("_range") - F.col("_skip"), "_count": count})
        .withColumn("segment", F.floor(F.col("_place") / F.col("_step")))
        .filter(
            (F.col("_place") >= 0)
            & (F.col("_place") % F.col("_step") == 0)
            & (F.col("segment") < F.col("_count"))
        )
        .select("id", "_range", "segment")
    )
    return ranged.join(taken, ["id", "_range"]).select(
        "id", "segment", (F.col("sample") % size).cast("int").alias("offset"), "value", (F.col("sample") - F.col("sample") % size).alias("start")
    )


def with_ranges(rows: DataFrame, place: str, width: int, *facts: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with the `_range` of `width` places they lie in, and per (id, _range) facts of the whole track.

    Facts are one row per track, copied to the track's ranges: joined on both columns, rows of a long track are many keys.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(place) / width))
    ranges = ranged.select("id", "_range").distinct()
    return ranged, ranges.join(rows.groupBy("id").agg(*facts), "id")


def segment_positions(segmented: DataFrame, size: int, samplerate: float) -> DataFrame:
    """Start, end (samples) and start time of each analysed segment."""
    start = F.min("start")
    return segmented.groupBy("id", "segment").agg(
        start.alias("start"), (start + size).alias("end"), (start / samplerate).alias("seconds")
    )


def periodogram(signal: np.ndarray, window: int) -> np.ndarray:
    """(frames, window/2 + 1) power of half-overlapping Hann windows."""
    hann = np.hanning(window)
    frames = np.lib.stride_tricks.sliding_window_view(signal, window)[:: window // 2]
    power = np.abs(np.fft.rfft(frames * hann)) ** 2 / (hann @ hann) / (2 * np.pi)
    power[:, 1:] *= 2  # both halves of the spectrum, the constant part is single
    return power


def spectrogram(segmented: DataFrame, size: int, window: int, gain: float = HEARING_THRESHOLD) -> DataFrame:
    """Power spectra per segment; a segment is a fixed number of samples and travels as one row."""

    @F.arrow_udf("array<array<double>>")
    def spectra(packed: pa.Array) -> pa.Array:
        cells = packed.flatten()
        offsets = cells.field("offset").to_numpy(zero_copy_only=False)
        values = cells.field("value").to_numpy(zero_copy_only=False) * gain
        ends = np.cumsum(packed.value_lengths().to_numpy(zero_copy_only=False))
        signals = np.zeros((len(packed), size))
        row = np.repeat(np.arange(len(packed)), np.diff(np.concatenate([[0], ends])))
        signals[row, offsets] = values
        return _nested([periodogram(signal, window) for signal in signals])

    packed = segmented.groupBy("id", "segment").agg(F.collect_list(F.struct("offset", "value")).alias("s"))
    rows = packed.select("id", "segment", spectra(F.col("s")).alias("p"))
    return rows.select("id", "segment", F.posexplode("p").alias("frame", "power"))


def _nested(matrices: list[np.ndarray]) -> pa.Array:
    """One list of equally long lists per matrix."""
    if not matrices:
        return pa.array([], pa.list_(pa.list_(pa.float64())))
    width = matrices[0].shape[1]
    rows = np.concatenate([[0], np.cumsum([len(m) for m in matrices])]).astype(np.int32)
    inner = np.arange(0, rows[-1] * width + 1, width, dtype=np.int32)
    values = pa.array(np.concatenate(matrices).ravel())
    return pa.ListArray.from_arrays(pa.array(rows), pa.ListArray.from_arrays(pa.array(inner), values))


def sonogram(
    spectra: DataFrame,
    samplerate: float,
    window: int,
    bands: int = 24,
    masking: bool = True,
    db: bool = True,
    to_phon: bool = True,
    to_sone: bool = True,
) -> DataFrame:
    """Spectra through bark bands, masking, decibel, phon and sone; row by row, no shuffle."""
    column = loudness.bark_bands(F.col("power"), samplerate, window, bands)
    out = spectra.select("id", "segment", "frame", column.alias("bands"))
    steps = [
        (masking, lambda c: loudness.mask(c, bands)),
        (db, loudness.decibel),
        (to_phon, lambda c: loudness.phon(c, bands)),
        (to_phon and to_sone, loudness.sone),
    ]
    for enabled, step in steps:
        if enabled:
            out = out.withColumn("bands", step(F.col("bands")))
    return out


def mel_bands(power: str, samplerate: float, window: int, bands: int = 80, low: float = 0.0, high: float | None = None) -> Column:
    """Mel filter bank over a spectrum column."""
    filters = loudness.mel_filters(samplerate, window, bands, low, high)

    @F.arrow_udf("array<double>")
    def apply(column: pa.Array) -> pa.Array:
        spectra, good = kernels.dense(column, filters.shape[1])
        out = spectra @ filters.T
        return pa.array([row if ok else None for row, ok in zip(out, good)], pa.list_(pa.float64()))

    return apply(F.col(power))


def modulation(sonograms: DataFrame, bins: int = MODULATION_BINS) -> DataFrame:
    """Magnitudes of the modulation frequencies 1..bins per band, per segment.

    The frames of a segment (a fixed number) travel as one row.
    """

    @F.arrow_udf("array<double>")
    def magnitudes(packed: pa.Array) -> pa.Array:
        frames = packed.flatten().field("bands")
        width = int(frames.value_lengths()[0].as_py()) if len(frames) else 0
        values = kernels.dense(frames, width)[0]
        ends = np.cumsum(packed.value_lengths().to_numpy(zero_copy_only=False))
        out = []
        for part in np.split(values, ends[:-1]) if len(ends) else []:
            size = 1 << int(np.ceil(np.log2(len(part))))
            if bins >= size:
                raise ValueError(f"{bins} modulation bins need more than {len(part)} frames")
            out.append((np.abs(np.fft.fft(part.T, size))[:, 1 : bins + 1] / 256).ravel())
        return pa.array(out, pa.list_(pa.float64()))

    ordered = F.array_sort(F.collect_list(F.struct("frame", "bands")))
    packed = sonograms.groupBy("id", "segment").agg(ordered.alias("s"))
    rows = packed.select("id", "segment", magnitudes(F.col("s")).alias("m"))
    cells = rows.select("id", "segment", F.posexplode("m").alias("at", "value"))
    return cells.select(
        "id",
        "segment",
        F.floor(F.col("at") / bins).cast("int").alias("band"),
        (F.col("at") % bins + 1).cast("int").alias("bin"),
        "value",
    )


# Features out of modulation and sonogram ----------------------------------------------------------


def rhythm_histogram_segments(modulated: DataFrame) -> DataFrame:
    """Sum over the bands per segment and bin."""
    return modulated.groupBy("id", "segment", "bin").agg(F.sum("value").alias("value"))


def rhythm_histogram(modulated: DataFrame) -> DataFrame:
    """(id, bin, rh): median over the segments."""
    return median_per_group(rhythm_histogram_segments(modulated), ["id", "bin"], "value", "rh")


def weighted(modulated: DataFrame, segment_size: int, samplerate: float) -> DataFrame:
    weight = loudness.fluctuation_weight(F.col("bin"), segment_size, samplerate)
    return modulated.withColumn("value", F.col("value") * weight)


def rhythm_pattern(modulated: DataFrame, segment_size: int, samplerate: float) -> DataFrame:
    """(id, band, bin, rp): weighted by fluctuation strength, median over the segments."""
    return median_per_group(weighted(modulated, segment_size, samplerate), ["id", "band", "bin"], "value", "rp")


def rhythm_histogram_weighted(modulated: DataFrame, segment_size: int, samplerate: float) -> DataFrame:
    """(id, segment, bin, rh2): sum over the bands after the weighting."""
    return rhythm_histogram_segments(weighted(modulated, segment_size, samplerate)).withColumnRenamed("value", "rh2")


def by_band(sonograms: DataFrame) -> DataFrame:
    return sonograms.select("id", "segment", "frame", F.posexplode("bands").alias("band", "value"))


def spectrum_descriptor_segments(band_rows: DataFrame) -> DataFrame:
    """Seven statistics over the frames per segment and band."""
    return seven_statistics(band_rows, ["id", "segment", "band"], "value", bounded=True)


def spectrum_descriptor(band_rows: DataFrame) -> DataFrame:
    """(id, band, seven statistics): mean over the segments."""
    per_segment = spectrum_descriptor_segments(band_rows)
    return per_segment.groupBy("id", "band").agg(*[F.avg(s).alias(s) for s in SEVEN])


def temporal_spectrum_descriptor(band_rows: DataFrame) -> DataFrame:
    """Seven statistics over the segments of each entry of the descriptor."""
    long = _long(spectrum_descriptor_segments(band_rows), ["id", "segment", "band"])
    return seven_statistics(long, ["id", "band", "statistic"], "value")


def temporal_rhythm_histogram(modulated: DataFrame) -> DataFrame:
    """Seven statistics over the segments per bin."""
    return seven_statistics(rhythm_histogram_segments(modulated), ["id", "bin"], "value")


def modulation_variance(modulated: DataFrame) -> DataFrame:
    """(id, bin, seven statistics over the bands): mean over the segments."""
    per_segment = seven_statistics(modulated, ["id", "segment", "bin"], "value", bounded=True)
    return per_segment.groupBy("id", "bin").agg(*[F.avg(s).alias(s) for s in SEVEN])


def _long(df: DataFrame, keys: list[str]) -> DataFrame:
    entries = [F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in SEVEN]
    return df.select(*keys, F.inline(F.array(*entries)))


def as_vectors(cells: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Cells of a feature (a fixed number per track) as one vector per id, ordered by `order`."""
    packed = F.array_sort(F.collect_list(F.struct(*order, value)))
    return cells.groupBy("id").agg(F.transform(packed, lambda c: c[value]).alias(out))


def rhythm_features(samples: DataFrame, samplerate: int = 44100, sizes: tuple[int, int] | None = None, **skip) -> dict[str, DataFrame]:
    """Samples to per-track cells of rp, rh, ssd, tssd, trh and mvd."""
    if sizes is None and samplerate not in SIZES:
        raise ValueError(f"sample rate {samplerate} is not one of {sorted(SIZES)}")
    size, window = sizes or SIZES[samplerate]
    cut = segments(samples, size, samplerate, **skip)
    sonograms = sonogram(spectrogram(cut, size, window), samplerate, window)
    bins = min(MODULATION_BINS, 2 * size // window - 2)
    modulated = modulation(sonograms, bins)
    bands = by_band(sonograms)
    return {
        "rp": rhythm_pattern(modulated, size, samplerate),
        "rh": rhythm_histogram(modulated),
        "ssd": spectrum_descriptor(bands),
        "tssd": temporal_spectrum_descriptor(bands),
        "trh": temporal_rhythm_histogram(modulated),
        "mvd": modulation_variance(modulated),
    }


# Beats --------------------------------------------------------------------------------------------


def beat_segments(beats: DataFrame, width: int = 4096) -> DataFrame:
    """(id, beat, low, high): the frames from the previous beat up to this one."""
    placed = positions(beats.select("id", "frame"), "id", "frame", width)
    return placed.select(
        "id",
        F.col("position").cast("int").alias("beat"),
        F.coalesce("previous", F.lit(0)).cast("bigint").alias("low"),
        F.col("frame").cast("bigint").alias("high"),
    )


def frames_in_beats(frames: DataFrame, segments_of_beats: DataFrame, width: int = 4096) -> DataFrame:
    """Frames with the beat they belong to.

    Beat spans are cut at multiples of `width`, so frames meet them on (id, range): an equal
    join in which each frame has one match and a long track is many keys.
    """
    spans = segments_of_beats.filter(F.col("high") > F.col("low"))
    ranges = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))
    spans = spans.withColumn("_range", F.explode(ranges))
    ranged = frames.withColumn("_range", F.floor(F.col("frame") / width))
    met = ranged.join(spans, ["id", "_range"])
    return met.filter((F.col("frame") >= F.col("low")) & (F.col("frame") < F.col("high"))).drop("_range")


def beat_means(frames: DataFrame, beats: DataFrame, d: int = 12, width: int = 4096) -> DataFrame:
    """(id, beat, vec): mean of the beat's frames, scaled to sum (of magnitudes) 1 unless zero."""
    met = frames_in_beats(frames, beat_segments(beats, width), width)
    means = met.groupBy("id", "beat").agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(d)]).alias("m"))
    norm = vectors.total(F.transform("m", lambda v: F.abs(v)))
    unit = F.when(norm != 0, F.transform("m", lambda v: v / norm)).otherwise(F.col("m"))
    return means.select("id", "beat", unit.alias("vec"))


def clear_frames(frames: DataFrame, width: int = 4096) -> DataFrame:
    """Chroma frames with only clear notes: the largest value as 1 and others from 0.8 up;
    frames with no more energy than half the track's mean are all zero."""
    energy = vectors.total(F.col("vec"))
    ranged, limits = with_ranges(frames, "frame", width, (F.avg(energy) / 2).alias("_limit"))
    top = F.array_max("vec")
    clear = F.transform("vec", lambda v: F.when(v == top, 1.0).when(v >= 0.8, v).otherwise(0.0))
    silent = F.transform("vec", lambda v: F.lit(0.0))
    joined = ranged.join(limits, ["id", "_range"])
    return joined.withColumn("vec", F.when(energy > F.col("_limit"), clear).otherwise(silent)).select(*frames.columns)


def notes_of_beats(frames: DataFrame, beats: DataFrame, d: int = 12, width: int = 4096) -> DataFrame:
    """(id, beat, note): the pitch class with most energy of the beat's clear frames (the first
    of equals; 0 for a beat without any)."""
    spans = shared(beat_segments(beats, width))
    met = frames_in_beats(clear_frames(frames, width), spans, width)
    sums = met.groupBy("id", "beat").agg(F.array(*[F.sum(F.col("vec")[i]) for i in range(d)]).alias("s"))
    note = (F.array_position("s", F.array_max("s")) - 1).cast("int")
    found = sums.select("id", "beat", note.alias("note"))
    return spans.select("id", "beat").join(found, ["id", "beat"], "left").na.fill(0, ["note"])


def beat_histogram(beats: DataFrame, bins: int = 250, rate: float = 1.0, width: int = 4096) -> DataFrame:
    """(id, bin, n): beats per minute out of the intervals between beats, in bins of 1; the last bin has all faster ones."""
    placed = positions(beats.select("id", "frame"), "id", "frame", width)
    seconds = (F.col("frame") - F.col("previous")) / rate
    bpm = F.floor(F.try_divide(F.lit(60.0), seconds)).cast("int").alias("bin")
    binned = placed.select("id", bpm).filter(F.col("bin") >= 0)
    return binned.select("id", F.least("bin", F.lit(bins - 1)).alias("bin")).groupBy("id", "bin").agg(F.count("*").alias("n"))
