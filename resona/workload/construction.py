"""Feature construction from event, line item and track tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from resona.functions import loudness, symbols, vectors
from resona.operators import spectral as S
from resona.operators import statistics as ST
from resona.operators.statistics import SEVEN
from resona.workload import tables as B
from resona.workload.tables import rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Waveforms: a user's events, one sample per hour, channels mixed by their mean -------------------

SIZE, WINDOW, RATE, NOMINAL, GAIN, BINS = 128, 32, 8.0, 44100, 1000.0, 6
_START = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
_HOUR = f"timestampdiff(HOUR, {_START}, ts)"


def _samples(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    hour = F.expr(_HOUR)
    return S.mix_channels(events.select(F.col("user_id").alias("id"), hour.alias("sample"), "value"))


def _cut(spark, sf_dir):
    return S.segments(_samples(spark, sf_dir), SIZE, RATE, skip=1, step=1)


def _spectra(spark, sf_dir, gain=1.0):
    return S.spectrogram(_cut(spark, sf_dir), SIZE, WINDOW, gain)


def _sonogram(spark, sf_dir):
    return S.sonogram(_spectra(spark, sf_dir, GAIN), NOMINAL, WINDOW)


def _modulated(spark, sf_dir):
    return S.modulation(_sonogram(spark, sf_dir), BINS)


_SAMPLES = """samples AS (SELECT user_id AS id, (epoch(ts)::BIGINT // 3600) - 473352 AS sample, avg(value) AS value
    FROM (SELECT user_id, date_trunc('second', ts) AS ts, value FROM events) GROUP BY ALL)"""
_CUT = _SAMPLES + f""", lengths AS (SELECT id, max(sample) + 1 AS n FROM samples GROUP BY id),
rules AS (SELECT id, n, CASE WHEN n / {RATE} < 45 THEN 0 ELSE 1 END AS skip FROM lengths),
cut AS (SELECT id, (sample // {SIZE} - skip)::BIGINT AS segment, (sample % {SIZE})::INT AS "offset", value, sample - sample % {SIZE} AS start
    FROM samples JOIN rules USING (id) WHERE sample // {SIZE} >= skip AND sample // {SIZE} - skip < (n - skip * 2 * {SIZE}) // {SIZE})"""


def _spectra_sql(gain):
    half = WINDOW // 2
    frames = (SIZE - WINDOW) // half + 1
    return _CUT + f""", placed AS (SELECT id, segment, f.frame::INT AS frame, value * {gain} *
      (0.5 - 0.5 * cos(2 * pi() * ("offset" - f.frame * {half}) / {WINDOW - 1})) AS x, "offset" - f.frame * {half} AS n
    FROM cut JOIN (SELECT unnest(range({frames})) AS frame) f ON "offset" BETWEEN f.frame * {half} AND f.frame * {half} + {WINDOW - 1}),
grid AS (SELECT id, segment, f.frame::INT AS frame, k.k FROM (SELECT DISTINCT id, segment FROM cut),
    (SELECT unnest(range({frames})) AS frame) f, (SELECT unnest(range({half + 1})) AS k) k),
sums AS (SELECT id, segment, frame, k.k, sum(x * cos(2 * pi() * k.k * n / {WINDOW})) AS re, sum(x * sin(2 * pi() * k.k * n / {WINDOW})) AS im
    FROM placed, (SELECT unnest(range({half + 1})) AS k) k GROUP BY ALL),
hann AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / {WINDOW - 1}), 2)) AS u FROM unnest(range({WINDOW})) AS t(i)),
spectra AS (SELECT g.id, g.segment, g.frame, g.k,
    coalesce((re * re + im * im) / u / (2 * pi()) * CASE WHEN g.k = 0 THEN 1 ELSE 2 END, 0) AS power
    FROM grid g LEFT JOIN sums USING (id, segment, frame, k), hann)"""


def _values(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(repr(float(v)) if isinstance(v, float) else str(int(v)) for v in r) + ")" for r in rows) + ")"


def _sonogram_sql():
    edges = [0, *loudness.BARK]
    bands = _values([(b, float(lo), float(hi)) for b, (lo, hi) in enumerate(zip(edges, edges[1:]))])
    levels = [float(p) for p in loudness.PHON]
    curves = loudness.band_loudness()
    table_rows = _values(
        [
            (b, level, float(curves[b][level]), float(curves[b][level + 1]), levels[level], levels[level + 1])
            for b in range(24)
            for level in range(5)
        ]
    )
    return _spectra_sql(GAIN) + f""", edges AS (SELECT * FROM {bands} t(band, lo, hi)),
frames AS (SELECT DISTINCT id, segment, frame FROM spectra),
bark AS (SELECT f.id, f.segment, f.frame, e.band, coalesce(sum(power) FILTER (k * {NOMINAL / WINDOW} >= lo AND k * {NOMINAL / WINDOW} < hi), 0) AS v
    FROM frames f JOIN spectra USING (id, segment, frame), edges e GROUP BY ALL),
masked AS (SELECT id, segment, frame, e.band, sum(v * pow(10, (15.81 + 7.5 * (e.band - bark.band + 0.474)
    - 17.5 * sqrt(1 + pow(e.band - bark.band + 0.474, 2))) / 10)) AS v FROM bark, edges e GROUP BY ALL),
decibels AS (SELECT id, segment, frame, band, 10 * log10(greatest(v, 1)) AS v FROM masked),
steps AS (SELECT * FROM {table_rows} t(band, level, low, high, p0, p1)),
phons AS (SELECT d.id, d.segment, d.frame, d.band, coalesce(arg_max(p0 + (v - low) / (high - low) * (p1 - p0), level) , 3.0) AS v
    FROM decibels d LEFT JOIN steps s ON s.band = d.band AND d.v > s.low GROUP BY ALL),
sones AS MATERIALIZED (SELECT id, segment, frame, band::INT AS band, CASE WHEN v >= 40 THEN pow(2, (v - 40) / 10) ELSE pow(v / 40, 2.642) END AS v FROM phons)"""


def _modulated_sql():
    return _sonogram_sql() + f""", modulated AS MATERIALIZED (SELECT id, segment, band, k.k::INT AS bin, sqrt(pow(sum(v * cos(2 * pi() * k.k * frame / 8)), 2)
    + pow(sum(v * sin(2 * pi() * k.k * frame / 8)), 2)) / 256 AS value FROM sones, (SELECT unnest(range(1, {BINS + 1})) AS k) k GROUP BY ALL)"""


QUERIES["channel_mix"] = lambda spark, sf_dir: rounded(_samples(spark, sf_dir), "value")
SQL["channel_mix"] = f"WITH {_SAMPLES} SELECT id, sample, round(value, 6) AS value FROM samples"

QUERIES["segment_samples"] = lambda spark, sf_dir: rounded(_cut(spark, sf_dir), "value")
SQL["segment_samples"] = f'WITH {_CUT} SELECT id, segment, "offset", round(value, 6) AS value, start FROM cut'

QUERIES["segment_positions"] = lambda spark, sf_dir: S.segment_positions(_cut(spark, sf_dir), SIZE, RATE)
SQL["segment_positions"] = f"""WITH {_CUT} SELECT id, segment, min(start) AS start, min(start) + {SIZE} AS "end",
min(start) / {RATE}::DOUBLE AS seconds FROM cut GROUP BY id, segment"""


def spectrogram(spark, sf_dir):
    rows = _spectra(spark, sf_dir).select("id", "segment", "frame", F.posexplode("power").alias("bin", "power"))
    return rounded(rows, "power", digits=5)


QUERIES["spectrogram"] = spectrogram
SQL["spectrogram"] = f"WITH {_spectra_sql(1.0)} SELECT id, segment, frame, k::INT AS bin, round(power, 5) AS power FROM spectra"

QUERIES["sonogram"] = lambda spark, sf_dir: rounded(S.by_band(_sonogram(spark, sf_dir)), "value", digits=5)
SQL["sonogram"] = f"WITH {_sonogram_sql()} SELECT id, segment, frame, band, round(v, 5) AS value FROM sones"

QUERIES["modulation_spectrum"] = lambda spark, sf_dir: rounded(_modulated(spark, sf_dir), "value")
SQL["modulation_spectrum"] = f"WITH {_modulated_sql()} SELECT id, segment, band, bin, round(value, 6) AS value FROM modulated"

QUERIES["rhythm_pattern"] = lambda spark, sf_dir: rounded(S.rhythm_pattern(_modulated(spark, sf_dir), SIZE, RATE), "rp")
SQL["rhythm_pattern"] = f"""WITH {_modulated_sql()} SELECT id, band, bin,
round(median(value / (bin * {RATE / SIZE} / 4 + 4 / (bin * {RATE / SIZE}))), 6) AS rp FROM modulated GROUP BY id, band, bin"""

QUERIES["rhythm_histogram"] = lambda spark, sf_dir: rounded(S.rhythm_histogram(_modulated(spark, sf_dir)), "rh")
SQL["rhythm_histogram"] = f"""WITH {_modulated_sql()}, h AS (SELECT id, segment, bin, sum(value) AS v FROM modulated GROUP BY ALL)
SELECT id, bin, round(median(v), 6) AS rh FROM h GROUP BY id, bin"""

QUERIES["rhythm_histogram_segments"] = lambda spark, sf_dir: rounded(
    S.rhythm_histogram_weighted(_modulated(spark, sf_dir), SIZE, RATE), "rh2"
)
SQL["rhythm_histogram_segments"] = f"""WITH {_modulated_sql()} SELECT id, segment, bin,
round(sum(value / (bin * {RATE / SIZE} / 4 + 4 / (bin * {RATE / SIZE}))), 6) AS rh2 FROM modulated GROUP BY id, segment, bin"""


def _seven_sql(value):
    return f"""avg({value}) AS mean, var_pop({value}) AS var, list({value}) AS all_values,
    median({value}) AS median, min({value}) AS min, max({value}) AS max"""


def _seven_finish(keys, source):
    """Skewness and kurtosis from moments about the mean, since engines differ in theirs."""
    moment = "list_sum(list_transform(all_values, lambda x: pow(x - mean, {p}))) / len(all_values)"
    return f"""SELECT {keys}, mean, var,
    CASE WHEN var > pow(1e-15 * mean, 2) THEN ({moment.format(p=3)}) / pow(var, 1.5) ELSE 0 END AS skew,
    CASE WHEN var > pow(1e-15 * mean, 2) THEN ({moment.format(p=4)}) / (var * var) ELSE 0 END AS kurtosis, median, min, max FROM {source}"""


def _seven_cte(name, keys, source, value):
    return f"""{name}_0 AS (SELECT {keys}, {_seven_sql(value)} FROM {source} GROUP BY {keys}),
{name} AS MATERIALIZED ({_seven_finish(keys, name + "_0")})"""


def _round_seven(wrap="round({s}, {d}) AS {s}", digits=4):
    return ", ".join(wrap.format(s=s, d=digits) for s in SEVEN)


def _descriptor(spark, sf_dir):
    """Band rows of a line item table: supplier, year as segment, line number as band."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id"),
        F.year("l_shipdate").cast("bigint").alias("segment"),
        F.col("l_linenumber").alias("band"),
        (F.sqrt("l_extendedprice") / 100).alias("value"),
    )


_BAND = """rows_ AS (SELECT l_suppkey AS id, year(l_shipdate)::BIGINT AS segment,
l_linenumber AS band, sqrt(l_extendedprice) / 100 AS value FROM lineitem)"""


def seven_statistics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), (F.sqrt("l_extendedprice") / 100).alias("value"))
    return rounded(ST.seven_statistics(li, ["id"], "value"), *SEVEN)


QUERIES["seven_statistics"] = seven_statistics
SQL["seven_statistics"] = "WITH src AS (SELECT l_suppkey AS id, sqrt(l_extendedprice) / 100 AS value FROM lineitem), " + _seven_cte(
    "s", "id", "src", "value"
) + f" SELECT id, {_round_seven(digits=6)} FROM s"

QUERIES["spectrum_descriptor_segments"] = lambda spark, sf_dir: rounded(
    S.spectrum_descriptor_segments(_descriptor(spark, sf_dir)), *SEVEN, digits=4
)
SQL["spectrum_descriptor_segments"] = f"WITH {_BAND}, " + _seven_cte("s", "id, segment, band", "rows_", "value") + (
    f" SELECT id, segment, band, {_round_seven()} FROM s"
)
QUERIES["spectrum_descriptor"] = lambda spark, sf_dir: rounded(
    S.spectrum_descriptor(_descriptor(spark, sf_dir)), *SEVEN, digits=4
)
SQL["spectrum_descriptor"] = f"WITH {_BAND}, " + _seven_cte("s", "id, segment, band", "rows_", "value") + (
    f" SELECT id, band, {_round_seven('round(avg({s}), {d}) AS {s}')} FROM s GROUP BY id, band"
)
_LONG = " UNION ALL ".join(f"SELECT id, segment, band, '{s}' AS statistic, {s} AS value FROM s" for s in SEVEN)
QUERIES["temporal_spectrum_descriptor"] = lambda spark, sf_dir: rounded(
    S.temporal_spectrum_descriptor(_descriptor(spark, sf_dir)), *SEVEN, digits=6
)
SQL["temporal_spectrum_descriptor"] = (
    f"WITH {_BAND}, "
    + _seven_cte("s", "id, segment, band", "rows_", "value")
    + f", long AS ({_LONG}), "
    + _seven_cte("t", "id, band, statistic", "long", "value")
    + f" SELECT id, band, statistic, {_round_seven(digits=6)} FROM t"
)


def _price_modulation(spark, sf_dir):
    """Modulation rows: supplier, month, line number as band, quantity as bin."""
    li = table(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint")
    keys = [
        F.col("l_suppkey").alias("id"),
        month.alias("segment"),
        F.col("l_linenumber").alias("band"),
        F.col("l_quantity").cast("int").alias("bin"),
    ]
    return li.groupBy(*keys).agg(F.sqrt(F.sum("l_extendedprice")).alias("value"))


_PRICE = """rows_ AS (SELECT l_suppkey AS id, (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS segment,
l_linenumber AS band, l_quantity::INT AS bin, sqrt(sum(l_extendedprice)) AS value FROM lineitem GROUP BY ALL)"""
QUERIES["temporal_rhythm_histogram"] = lambda spark, sf_dir: rounded(
    S.temporal_rhythm_histogram(_price_modulation(spark, sf_dir)), *SEVEN, digits=6
)
SQL["temporal_rhythm_histogram"] = (
    f"WITH {_PRICE}, h AS (SELECT id, segment, bin, sum(value) AS value FROM rows_ GROUP BY ALL), "
    + _seven_cte("s", "id, bin", "h", "value")
    + f" SELECT id, bin, {_round_seven(digits=6)} FROM s"
)
QUERIES["modulation_variance"] = lambda spark, sf_dir: rounded(
    S.modulation_variance(_price_modulation(spark, sf_dir)), *SEVEN, digits=6
)
SQL["modulation_variance"] = f"WITH {_PRICE}, " + _seven_cte("s", "id, segment, bin", "rows_", "value") + (
    f" SELECT id, bin, {_round_seven('round(avg({s}), {d}) AS {s}', 6)} FROM s GROUP BY id, bin"
)


def median_per_group(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(ST.median_per_group(li, ["l_returnflag"], "l_extendedprice"), "median", digits=4)


QUERIES["median_per_group"] = median_per_group
SQL["median_per_group"] = "SELECT l_returnflag, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY l_returnflag"

# Psychoacoustic scales on track vectors ------------------------------------------------------------


def _energies(spark, sf_dir):
    return B.tracks(spark, sf_dir).select("id", F.transform(F.slice("rp", 1, 24), lambda v: F.abs(v) * 1e6).alias("e"))


_ENERGY = "e AS (SELECT vec_id AS id, b::INT AS band, abs(embedding[b + 1]::DOUBLE) * 1e6 AS v FROM embeddings, unnest(range(24)) AS u(b))"


def _scale(column):
    def run(spark, sf_dir):
        out = _energies(spark, sf_dir).select("id", F.posexplode(column(F.col("e"))).alias("band", "value"))
        return rounded(out, "value")

    return run


QUERIES["decibel_scale"] = _scale(loudness.decibel)
SQL["decibel_scale"] = f"WITH {_ENERGY} SELECT id, band, round(10 * log10(greatest(v, 1)), 6) AS value FROM e"
QUERIES["sone_scale"] = _scale(lambda e: loudness.sone(loudness.decibel(e)))
SQL["sone_scale"] = f"""WITH {_ENERGY}, d AS (SELECT id, band, 10 * log10(greatest(v, 1)) AS v FROM e)
SELECT id, band, round(CASE WHEN v >= 40 THEN pow(2, (v - 40) / 10) ELSE pow(v / 40, 2.642) END, 6) AS value FROM d"""
QUERIES["spectral_masking"] = _scale(lambda e: F.transform(loudness.mask(e), lambda v: v / 1e6))
SQL["spectral_masking"] = f"""WITH {_ENERGY} SELECT e.id, i.band, round(sum(v * pow(10, (15.81 + 7.5 * (i.band - e.band + 0.474)
- 17.5 * sqrt(1 + pow(i.band - e.band + 0.474, 2))) / 10)) / 1e6, 6) AS value FROM e, (SELECT unnest(range(24))::INT AS band) i GROUP BY e.id, i.band"""
QUERIES["phon_scale"] = _scale(lambda e: loudness.phon(loudness.decibel(e)))
SQL["phon_scale"] = f"""WITH {_ENERGY}, d AS (SELECT id, band, 10 * log10(greatest(v, 1)) AS v FROM e),
steps AS (SELECT * FROM {_values([(b, lv, float(loudness.band_loudness()[b][lv]), float(loudness.band_loudness()[b][lv + 1]), float(loudness.PHON[lv]), float(loudness.PHON[lv + 1])) for b in range(24) for lv in range(5)])} t(band, level, low, high, p0, p1))
SELECT d.id, d.band, round(coalesce(arg_max(p0 + (v - low) / (high - low) * (p1 - p0), level), 3.0), 6) AS value
FROM d LEFT JOIN steps s ON s.band = d.band AND d.v > s.low GROUP BY d.id, d.band"""


def bark_band_sums(spark, sf_dir):
    """Line items as spectrum lines: price as frequency, quantity as power."""
    li = table(spark, sf_dir, "lineitem")
    frequency = F.col("l_extendedprice") / 6
    lines = li.select(F.col("l_suppkey").alias("id"), loudness.bark_band_of(frequency).alias("band"), "l_quantity")
    return lines.filter(F.col("band").isNotNull()).groupBy("id", "band").agg(F.sum("l_quantity").alias("power"))


QUERIES["bark_band_sums"] = bark_band_sums
_EDGES = [0, *loudness.BARK]
SQL["bark_band_sums"] = f"""SELECT l_suppkey AS id, band::INT AS band, sum(l_quantity) AS power FROM lineitem
JOIN {_values([(b, float(lo), float(hi)) for b, (lo, hi) in enumerate(zip(_EDGES, _EDGES[1:]))])} t(band, lo, hi)
ON l_extendedprice / 6 >= lo AND l_extendedprice / 6 < hi GROUP BY ALL"""


def mel_bands(spark, sf_dir):
    """Track vectors as spectra of 33 bins through 8 mel bands."""
    spectra = B.tracks(spark, sf_dir).select("id", F.transform(F.slice("rp", 1, 33), lambda v: F.abs(v) * 1e4).alias("power"))
    out = spectra.select("id", F.posexplode(S.mel_bands("power", 22050, 64, 8)).alias("band", "value"))
    return rounded(out, "value")


QUERIES["mel_bands"] = mel_bands
_MEL = loudness.mel_filters(22050, 64, 8)
SQL["mel_bands"] = f"""SELECT vec_id AS id, f.band::INT AS band, round(sum(abs(embedding[f.bin + 1]::DOUBLE) * 1e4 * f.w), 6) AS value
FROM embeddings, {_values([(b, k, float(_MEL[b][k])) for b in range(8) for k in range(33)])} f(band, bin, w) GROUP BY vec_id, f.band"""

# Gaussians of frames ---------------------------------------------------------------------------------


def gaussian_of_frames(spark, sf_dir):
    """13-wide frames: the tracks of a class."""
    frames = B.tracks(spark, sf_dir).select(F.col("label").alias("id"), F.slice("rp", 1, 13).alias("vec"))
    g = ST.gaussian_of_frames(frames, 13)
    return rounded(g.select("id", "frames", F.posexplode("gaussian").alias("cell", "value")), "value")


QUERIES["gaussian_of_frames"] = gaussian_of_frames
SQL["gaussian_of_frames"] = """WITH v AS (SELECT label AS id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT id, count(*) AS frames FROM v GROUP BY id)
SELECT id, frames, i::INT AS cell, round(avg(e[i + 1]), 6) AS value FROM v JOIN n USING (id), unnest(range(13)) AS u(i) GROUP BY id, frames, i
UNION ALL SELECT id, frames, (13 + 13 * i + j)::INT, round(covar_samp(e[i + 1], e[j + 1]), 6) FROM v JOIN n USING (id),
unnest(range(13)) AS u(i), unnest(range(13)) AS w(j) GROUP BY id, frames, i, j"""


def variance_of_frames(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    frames = li.select(F.col("l_suppkey").alias("id"), F.array("l_quantity", "l_discount", "l_tax").alias("vec"))
    g = ST.gaussian_of_frames(frames, 3)
    return rounded(g.select("id", "frames", F.posexplode("var").alias("dimension", "var")), "var")


QUERIES["variance_of_frames"] = variance_of_frames
SQL["variance_of_frames"] = " UNION ALL ".join(
    f"SELECT l_suppkey AS id, count(*) AS frames, {i}::INT AS dimension, round(var_pop({c}), 6) AS var FROM lineitem GROUP BY l_suppkey"
    for i, c in enumerate(["l_quantity", "l_discount", "l_tax"])
)

# Beats: clicks are beats, all events are chroma frames ------------------------------------------------

_SECOND = f"timestampdiff(SECOND, {_START}, ts)"


def _beats(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return events.select(F.col("user_id").alias("id"), F.expr(_SECOND).alias("frame"))


def _frames(spark, sf_dir):
    level = F.floor(F.col("value") * 100).cast("bigint")
    vec = F.array(*[F.sqrt(((level + 37 * k) % 100) / 100.0) for k in range(12)])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.expr(_SECOND).alias("frame"), vec.alias("vec"))


WIDTH = 86400 * 3

_SECONDS = "(epoch(date_trunc('second', ts))::BIGINT - 1704067200)"
_SPANS = f"""beats AS (SELECT user_id AS id, {_SECONDS} AS frame FROM events WHERE event_type = 'click'),
spans AS (SELECT id, (row_number() OVER w - 1)::INT AS beat, coalesce(lag(frame) OVER w, 0) AS low, frame AS high FROM beats
    WINDOW w AS (PARTITION BY id ORDER BY frame)),
frames AS (SELECT user_id AS id, {_SECONDS} AS frame,
    list_transform(range(0, 12), lambda k: sqrt(((floor(value * 100)::BIGINT + 37 * k) % 100) / 100.0::DOUBLE)) AS vec FROM events)"""

QUERIES["beat_segments"] = lambda spark, sf_dir: S.beat_segments(_beats(spark, sf_dir), WIDTH)
SQL["beat_segments"] = f"WITH {_SPANS} SELECT * FROM spans"


def beat_chroma(spark, sf_dir):
    out = S.beat_means(_frames(spark, sf_dir), _beats(spark, sf_dir), 12, WIDTH)
    return rounded(out.select("id", "beat", F.posexplode("vec").alias("pitch", "value")), "value", digits=6)


QUERIES["beat_chroma"] = beat_chroma
SQL["beat_chroma"] = f"""WITH {_SPANS}, m AS (SELECT f.id, beat, p, avg(vec[p + 1]) AS v FROM frames f JOIN spans s
ON f.id = s.id AND f.frame >= low AND f.frame < high, unnest(range(12)) AS u(p) GROUP BY f.id, beat, p),
t AS (SELECT id, beat, sum(abs(v)) AS norm FROM m GROUP BY id, beat)
SELECT id, beat, p::INT AS pitch, round(CASE WHEN norm != 0 THEN v / norm ELSE v END, 6) AS value FROM m JOIN t USING (id, beat)"""


def beat_notes(spark, sf_dir):
    return S.notes_of_beats(_frames(spark, sf_dir), _beats(spark, sf_dir), 12, WIDTH)


QUERIES["beat_notes"] = beat_notes
SQL["beat_notes"] = f"""WITH {_SPANS}, limits AS (SELECT id, avg(list_sum(vec)) / 2 AS lim FROM frames GROUP BY id),
clear AS (SELECT f.id, frame, CASE WHEN list_sum(vec) > lim THEN list_transform(vec, lambda v:
    CASE WHEN v = list_max(vec) THEN 1.0::DOUBLE WHEN v >= 0.8 THEN v ELSE 0 END) ELSE list_transform(vec, lambda v: 0.0::DOUBLE) END AS vec
    FROM frames f JOIN limits USING (id)),
sums AS (SELECT c.id, beat, p, sum(vec[p + 1]) AS v FROM clear c JOIN spans s ON c.id = s.id AND frame >= low AND frame < high,
    unnest(range(12)) AS u(p) GROUP BY c.id, beat, p),
best AS (SELECT id, beat, list(v ORDER BY p) AS s FROM sums GROUP BY id, beat)
SELECT id, beat, coalesce(list_position(s, list_max(s)) - 1, 0)::INT AS note FROM spans LEFT JOIN best USING (id, beat)"""

# a beat interval of h hours counts as h seconds
# (so a few intervals are faster than the last bin)
QUERIES["beat_histogram"] = lambda spark, sf_dir: S.beat_histogram(_beats(spark, sf_dir), 250, 3600.0, WIDTH)
SQL["beat_histogram"] = f"""WITH {_SPANS}, g AS (SELECT id, frame - lag(frame) OVER (PARTITION BY id ORDER BY frame) AS gap FROM beats),
b AS (SELECT id, floor(60.0::DOUBLE / (gap / 3600.0::DOUBLE))::INT AS bin FROM g WHERE gap > 0)
SELECT id, least(bin, 249) AS bin, count(*) AS n FROM b GROUP BY ALL"""

# Notes and chroma to key A, vector building -------------------------------------------------------------


def _pitch(spark, sf_dir):
    pitch = F.transform("rp", lambda v: F.pmod(F.floor(v * 48).cast("int"), F.lit(12)))
    return B.tracks(spark, sf_dir).withColumn("pitch", pitch)


def note_letters(spark, sf_dir):
    return _pitch(spark, sf_dir).select("id", symbols.letter_code(F.col("pitch")).alias("notes"))


def transpose_notes(spark, sf_dir):
    moved = symbols.transpose_notes(F.col("pitch"), F.col("key"))
    return _pitch(spark, sf_dir).select("id", "key", symbols.letter_code(moved).alias("notes"))


def transpose_chroma(spark, sf_dir):
    moved = symbols.transpose_chroma(vectors.rows_of(F.slice("rp", 1, 60), 12), F.col("key"))
    rows = B.tracks(spark, sf_dir).select("id", F.posexplode(moved).alias("pitch", "row"))
    return rows.select("id", "pitch", F.posexplode("row").alias("beat", "value"))


QUERIES["note_letters"] = note_letters
SQL["note_letters"] = "WITH " + B.TRACKS_SQL + " z AS (SELECT 1) SELECT id, notes FROM tracks"
QUERIES["transpose_notes"] = transpose_notes
_SHIFT = "(12 - list_position(['A','A#','B','C','C#','D','D#','E','F','F#','G','G#'], key) + 1) % 12"
SQL["transpose_notes"] = "WITH " + B.TRACKS_SQL + f""" p AS (SELECT id, key, {_SHIFT} AS shift,
list_transform(rp, lambda v: ((floor(v * 48)::INT % 12) + 12) % 12) AS pitch FROM tracks)
SELECT id, key, list_aggregate(list_transform(pitch, lambda n: substr('ABCDEFGHIJKL', ((n + shift) % 12)::INT + 1, 1)), 'string_agg', '') AS notes FROM p"""
QUERIES["transpose_chroma"] = transpose_chroma
SQL["transpose_chroma"] = "WITH " + B.TRACKS_SQL + f""" p AS (SELECT id, rp, {_SHIFT} AS shift FROM tracks)
SELECT id, ((r + shift) % 12)::INT AS pitch, b::INT AS beat, rp[r * 5 + b + 1] AS value FROM p, unnest(range(12)) AS u(r), unnest(range(5)) AS w(b)"""


def mfcc_vector(spark, sf_dir):
    """Mean, and the upper triangle of a 3x3 covariance, as one vector."""
    cat = B.tracks(spark, sf_dir)
    flat = F.concat(F.slice("rp", 1, 3), F.slice("rp", 4, 9))
    out = cat.select("id", F.posexplode(vectors.gaussian_to_euclid(flat, 3)).alias("cell", "value"))
    return out


QUERIES["upper_triangle_vector"] = mfcc_vector
SQL["upper_triangle_vector"] = """SELECT vec_id AS id, (place - 1)::INT AS cell, embedding[t.place_of]::DOUBLE AS value
FROM embeddings, (VALUES (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 8), (8, 9), (9, 12)) t(place, place_of)"""


def transposed_matrix(spark, sf_dir):
    cat = B.tracks(spark, sf_dir)
    return cat.select("id", F.posexplode(vectors.transpose_flat(F.slice("rp", 1, 60), 12)).alias("cell", "value"))


QUERIES["transposed_matrix"] = transposed_matrix
SQL["transposed_matrix"] = """SELECT vec_id AS id, (b * 12 + r)::INT AS cell, embedding[r * 5 + b + 1]::DOUBLE AS value
FROM embeddings, unnest(range(12)) AS u(r), unnest(range(5)) AS w(b)"""
