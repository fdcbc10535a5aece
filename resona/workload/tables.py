"""How the supplied tables stand in for the engine's inputs.

`tracks` reads every row of `embeddings` as one track: the 64 numbers are its rhythm pattern,
parts of them its other features. All of it is row-local.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.functions import symbols, vectors

GAUSSIAN_FRAMES = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rp = F.col("rp")
    raw = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", vectors.doubles(F.col("embedding")).alias("rp")
    )
    pitch = F.transform(rp, lambda v: F.pmod(F.floor(v * 48).cast("int"), F.lit(12)))
    beats = F.col("label") % 4 + 2
    return raw.select(
        "id",
        "label",
        "rp",
        F.slice(rp, 1, 16).alias("rh"),
        F.slice(rp, 17, 16).alias("bh"),
        vectors.frames_gaussian(rp, GAUSSIAN_FRAMES, 2).alias("mfcc"),
        symbols.letter_code(pitch).alias("notes"),
        F.transform(F.slice(rp, F.lit(1), beats * 12), lambda v: F.abs(v)).alias("chroma"),
        F.element_at(F.array(*[F.lit(k) for k in symbols.OCTAVE]), pitch[0] + 1).alias("key"),
        F.when(F.col("label") % 2 == 0, "major").otherwise("minor").alias("scale"),
        (F.lit(90.0) + rp[0] * 100).alias("bpm"),
    )


def query_list(catalogue: DataFrame) -> DataFrame:
    """One query per class, the track with its lowest id; columns of the catalogue."""
    picked = catalogue.groupBy("label").agg(F.min("id").alias("id")).select("id")
    return catalogue.join(F.broadcast(picked), "id", "left_semi")  # one id per class


def first_query(catalogue: DataFrame) -> DataFrame:
    """The track with the lowest id of all."""
    picked = catalogue.agg(F.min("id").alias("id"))
    return catalogue.join(F.broadcast(picked), "id", "left_semi")  # one row


# The same in SQL ---------------------------------------------------------------------------

TRACKS_SQL = """
raw AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS rp FROM embeddings),
parts AS (SELECT *, rp[1:16] AS rh, rp[17:32] AS bh,
    list_transform(range(0, 32), lambda i: rp[2*i + 1]) AS xs,
    list_transform(range(0, 32), lambda i: rp[2*i + 2]) AS ys,
    list_transform(rp, lambda v: ((floor(v * 48)::INT % 12) + 12) % 12) AS pitch,
    label % 4 + 2 AS beats FROM raw),
moments AS (SELECT *, list_sum(xs) / 32 AS mx, list_sum(ys) / 32 AS my FROM parts),
tracks AS (SELECT id, label, rp, rh, bh, mx, my,
    list_sum(list_transform(xs, lambda v: (v - mx) * (v - mx))) / 31 AS cxx,
    list_sum(list_transform(range(1, 33), lambda i: (xs[i] - mx) * (ys[i] - my))) / 31 AS cxy,
    list_sum(list_transform(ys, lambda v: (v - my) * (v - my))) / 31 AS cyy,
    list_aggregate(list_transform(pitch, lambda n: substr('ABCDEFGHIJKL', n + 1, 1)), 'string_agg', '') AS notes,
    beats, list_transform(rp[1:12 * beats], lambda v: abs(v)) AS chroma,
    ['A','A#','B','C','C#','D','D#','E','F','F#','G','G#'][pitch[1] + 1] AS key,
    CASE WHEN label % 2 = 0 THEN 'major' ELSE 'minor' END AS scale,
    90.0::DOUBLE + rp[1] * 100 AS bpm FROM moments),
"""

QUERIES_SQL = """
queries AS (SELECT * FROM tracks WHERE id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
"""

FIRST_SQL = """
queries AS (SELECT * FROM tracks WHERE id = (SELECT min(vec_id) FROM embeddings)),
"""

# One row per (query, track) and the eight distances.
_DISTANCES = {
    "rp": "list_distance(c.rp, q.rp)",
    "rh": "list_distance(c.rh, q.rh)",
    "bh": "list_distance(c.bh, q.bh)",
    "notes": "levenshtein(c.notes, q.notes)::DOUBLE",
    "mfcc": "list_distance([c.mx, c.my, c.cxx, c.cxy, c.cyy], [q.mx, q.my, q.cxx, q.cxy, q.cyy])",
    "js": """greatest(0.0, 0.5 * ln(
        (0.5*(c.cxx + q.cxx) + 0.25*(c.mx - q.mx)*(c.mx - q.mx))
        * (0.5*(c.cyy + q.cyy) + 0.25*(c.my - q.my)*(c.my - q.my))
        - pow(0.5*(c.cxy + q.cxy) + 0.25*(c.mx - q.mx)*(c.my - q.my), 2))
        - 0.25 * ln(c.cxx*c.cyy - c.cxy*c.cxy) - 0.25 * ln(q.cxx*q.cyy - q.cxy*q.cxy))""",
    "skl": """greatest(0.0, 0.25 * (
        (c.cxx*q.cyy - 2*c.cxy*q.cxy + c.cyy*q.cxx) / (q.cxx*q.cyy - q.cxy*q.cxy)
        + (q.cxx*c.cyy - 2*q.cxy*c.cxy + q.cyy*c.cxx) / (c.cxx*c.cyy - c.cxy*c.cxy)
        + (c.mx - q.mx)*(c.mx - q.mx) * (c.cyy/(c.cxx*c.cyy - c.cxy*c.cxy) + q.cyy/(q.cxx*q.cyy - q.cxy*q.cxy))
        + (c.my - q.my)*(c.my - q.my) * (c.cxx/(c.cxx*c.cyy - c.cxy*c.cxy) + q.cxx/(q.cxx*q.cyy - q.cxy*q.cxy))
        - 2*(c.mx - q.mx)*(c.my - q.my) * (c.cxy/(c.cxx*c.cyy - c.cxy*c.cxy) + q.cxy/(q.cxx*q.cyy - q.cxy*q.cxy))
        - 4))""",
}

# Chroma: longer operand (the query on a tie) in front, 1-D 'same' lags summed over the twelve
# rows, first value taken off, high-pass written out as its impulse response, maximum.
CHROMA_SQL = """
chroma_pairs AS (SELECT q.id AS query_id, c.id AS id,
    CASE WHEN c.beats > q.beats THEN c.chroma ELSE q.chroma END AS a,
    CASE WHEN c.beats > q.beats THEN q.chroma ELSE c.chroma END AS b,
    greatest(c.beats, q.beats) AS la, least(c.beats, q.beats) AS lb FROM tracks c, queries q),
chroma_lags AS (SELECT query_id, id, la, k, list_sum(list_transform(range(0, 12 * lb), lambda j: 
      CASE WHEN (j % lb) + k + {start} BETWEEN 0 AND la - 1
           THEN a[(j // lb) * la + (j % lb) + k + {start} + 1] * b[j + 1] ELSE 0 END)) AS c
    FROM chroma_pairs, unnest(range(0, la)) AS u(k)),
chroma_lines AS (SELECT query_id, id, list(c ORDER BY k) AS line FROM chroma_lags GROUP BY query_id, id),
chroma_steps AS (SELECT query_id, id, list_transform(range(1, len(line) + 1), lambda i: 
    CASE WHEN i = 1 THEN 0 ELSE line[i] - line[i - 1] END) AS steps FROM chroma_lines),
chroma_d AS (SELECT query_id, id, list_max(list_transform(range(1, len(steps) + 1), lambda n: 
    list_sum(list_transform(range(1, n + 1), lambda j: 0.8632712640026805 * pow(0.726542528005361, n - j) * steps[j])))) AS d_chroma
    FROM chroma_steps),
"""


def distances_sql(names: list[str], source: str = QUERIES_SQL) -> str:
    """CTEs up to `d`: (query_id, id, label, d_*)."""
    plain = [f"{_DISTANCES[n]} AS d_{n}" for n in names if n != "chroma"]
    pairs = "pairs AS (SELECT q.id AS query_id, c.id AS id, c.label, q.label AS query_label" + "".join(
        ", " + p for p in plain
    ) + " FROM tracks c, queries q)"
    body = "WITH " + TRACKS_SQL + source
    if "chroma" in names:
        body += CHROMA_SQL.format(start="(lb - 1) // 2 - (lb - 1)")
        return body + pairs + ", d AS (SELECT * FROM pairs JOIN chroma_d USING (query_id, id))"
    return body + pairs + ", d AS (SELECT * FROM pairs)"


def scaled_sql(names: list[str], weights: dict[str, float] | None = None, source: str = QUERIES_SQL) -> str:
    """CTEs up to `scored`: scaled over the complete rows, and the mean score."""
    weights = weights or {}
    ranges = ", ".join(f"min(d_{n}) AS lo_{n}, max(d_{n}) AS hi_{n}" for n in names)
    scaled = ", ".join(_scaled(n, weights.get(n, 1.0)) for n in names)
    mean = " + ".join(f"scaled_{n}" for n in names)
    return f"""{distances_sql(names, source)},
ranges AS (SELECT query_id, {ranges} FROM d GROUP BY query_id),
scaled AS (SELECT d.*, {scaled} FROM d JOIN ranges USING (query_id)),
scored AS (SELECT *, ({mean}) / {len(names)} AS aggregated FROM scaled)"""


def _scaled(name: str, weight: float) -> str:
    share = f"(d_{name} - lo_{name}) / (hi_{name} - lo_{name})"
    share = f"1.0 - {share}" if name == "chroma" else share
    return f"CASE WHEN hi_{name} = lo_{name} THEN 0.0 ELSE ({share}) * {weight} END AS scaled_{name}"


def top_sql(k: int, columns: str, order: str = "aggregated", source: str = "scored") -> str:
    return f"""
SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id)::INT AS rank
FROM {source}) WHERE rank <= {k}"""


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})
