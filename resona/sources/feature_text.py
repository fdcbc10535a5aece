"""Readers and writers of feature text files, one line per track.

    .rp .rh   id,v1,v2,...              values and id may be quoted as b'..'
    .bh       id; bpm; [v1, ...]
    .notes    id; key; scale; [n1, ...]
    .chroma   id; [[..], .. 12 rows]
    .mfcckl   id; [means]; [[covariance]]
    .mfcc     id; [means]; [variances]; [upper triangle of the covariance]

A number is a decimal with or without sign, point and exponent (`-1`, `.5`, `5.0E-4`); writers print the shortest
decimal that reads back as the same double. Vector lengths are those of `LENGTHS` unless a width is given; `ANY_WIDTH` takes all.

A path may be a glob over many shards. Lines are split and parsed by column expressions.
`parse` keeps every line with a `reason` (null where it is fine); `good` and `quarantined`
part them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.functions import ids, symbols, vectors

# fixed values: vector lengths
LENGTHS = {"rp": 1440, "rh": 60, "bh": 250, "mfcckl": 182}
MFCC_WIDTH = 13
ANY_WIDTH = -1
PITCHES = 12


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    lines = spark.read.text(path).select("value", F.input_file_name().alias("path"))
    lines = lines.filter(F.length(F.trim("value")) > 0)
    return lines.repartition(partitions) if partitions else lines


def _field(pattern: str, group: int) -> Column:
    return F.regexp_extract("value", pattern, group)


def _fields(count: int) -> str:
    """id; then `count` fields without semicolons (an id may hold some)."""
    return r"^(.*)" + r";([^;]*)" * count + r"\s*$"


def _reason(*checks: tuple[Column, str]) -> Column:
    reason = F.lit(None).cast("string")
    for ok, text in reversed(checks):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)).otherwise(reason)
    return reason.alias("reason")


def _extracted(lines: DataFrame, **fields: Column) -> DataFrame:
    """Fields as columns beside the line and its file. A generator keeps the optimizer from repeating the parsing in
    every check and filter that looks at a field."""
    row = F.struct(*[c.alias(name) for name, c in fields.items()])
    return lines.select("value", "path", F.inline(F.array(row)))


def _numbers(name: str) -> tuple[Column, str]:
    finite = F.forall(name, lambda v: F.abs(v) < float("inf"))
    return vectors.all_numbers(F.col(name)) & finite, "not a number"


def _checked(rows: DataFrame, columns: list[Column | str], *checks: tuple[Column, str]) -> DataFrame:
    has_id = (F.length("id") > 0, "no id")
    return rows.select("id", *columns, _reason(has_id, *checks), "value", "path")


def _parse_rhythm(lines: DataFrame, name: str, width: int | None) -> DataFrame:
    fields = F.split(F.regexp_replace("value", r"b'|['\"]", ""), ",")
    # the id is the first field; with a known width, all that stands before the last numbers
    head = F.greatest(F.size("fields") - width, F.lit(0)) if width else F.lit(1)
    tail = F.slice("fields", head + 1, F.size("fields"))
    rows = _extracted(
        _extracted(lines, fields=fields),
        id=ids.clean_id(F.array_join(F.slice("fields", F.lit(1), head), "")),
        v=F.transform(tail, lambda v: F.trim(v).try_cast("double")),
    )
    checks = [_numbers("v")] + ([(F.size("v") == width, "wrong length")] if width else [])
    return _checked(rows, [F.col("v").alias(name)], *checks)


def _parse_beat_histogram(lines: DataFrame, width: int | None) -> DataFrame:
    pattern = _fields(2)
    rows = _extracted(
        lines,
        id=ids.clean_id(_field(pattern, 1)),
        bpm=F.trim(_field(pattern, 2)).try_cast("double"),
        bh=vectors.parse_numbers(_field(pattern, 3)),
    )
    checks = [(F.col("bpm").isNotNull(), "no bpm"), _numbers("bh")]
    checks += [(F.size("bh") == width, "wrong length")] if width else []
    return _checked(rows, ["bpm", "bh"], *checks)


def _parse_notes(lines: DataFrame) -> DataFrame:
    pattern = _fields(3)
    rows = _extracted(
        lines,
        id=ids.clean_id(_field(pattern, 1)),
        key=F.trim(_field(pattern, 2)),
        scale=F.trim(_field(pattern, 3)),
        n=F.from_json(_field(pattern, 4), "array<int>"),
    )
    in_octave = F.forall("n", lambda n: n.isNotNull() & n.between(0, 11))
    known = (F.col("n").isNotNull() & in_octave, "not a note list")
    return _checked(rows, ["key", "scale", symbols.letter_code(F.col("n")).alias("notes")], known)


def _parse_chroma(lines: DataFrame) -> DataFrame:
    pattern = r"^(.*);\s*(\[.*\])\s*$"
    matrix = F.regexp_replace(_field(pattern, 2), r"\s", "")
    rows = _extracted(
        lines,
        id=ids.clean_id(_field(pattern, 1)),
        opens=matrix.startswith("[["),
        pitches=F.size(F.split(matrix, r"\],\[")),
        chroma=vectors.parse_numbers(matrix),
    )
    whole = (F.col("pitches") == PITCHES) & (F.size("chroma") % PITCHES == 0)
    # a chroma matrix opens with a share of energy: zero, or a number of the order of one, however it is printed
    first = F.get("chroma", F.lit(0))
    starts = F.col("opens") & (first >= 0) & (first < 2)
    return _checked(rows, ["chroma"], (starts, "empty or not a chroma matrix"), _numbers("chroma"), (whole, "not twelve rows"))


def _parse_gaussian(lines: DataFrame, d: int) -> DataFrame:
    pattern = _fields(2)
    rows = _extracted(
        lines,
        id=ids.clean_id(_field(pattern, 1)),
        mean=vectors.parse_numbers(_field(pattern, 2)),
        cov=vectors.parse_numbers(_field(pattern, 3)),
    )
    sized = ((F.size("mean") == d) & (F.size("cov") == d * d), "wrong length")
    return _checked(rows, [F.concat("mean", "cov").alias("mfcc")], _numbers("mean"), _numbers("cov"), sized)


def _parse_euclid(lines: DataFrame, d: int) -> DataFrame:
    pattern = _fields(3)
    rows = _extracted(
        lines,
        id=ids.clean_id(_field(pattern, 1)),
        mean=vectors.parse_numbers(_field(pattern, 2)),
        var=vectors.parse_numbers(_field(pattern, 3)),
        cov=vectors.parse_numbers(_field(pattern, 4)),
    )
    # older files leave the diagonal out of the triangle
    triangle = F.size("cov").isin(d * (d + 1) // 2, d * (d - 1) // 2)
    sized = ((F.size("mean") == d) & (F.size("var") == d) & triangle, "wrong length")
    numbers = [_numbers(c) for c in ("mean", "var", "cov")]
    return _checked(rows, [F.concat("mean", "var", "cov").alias("mfcc_euclid")], *numbers, sized)


def parse(lines: DataFrame, kind: str, width: int | None = None) -> DataFrame:
    """Lines of one kind to typed columns, `reason`, the line and its file.

    `width` is the length of the vectors (of the means for `mfcckl` and `mfcc`), by default that of the format.
    """
    width = LENGTHS.get(kind) if width is None and not kind.startswith("mfcc") else width
    width = None if width == ANY_WIDTH else width
    if kind in ("rp", "rh"):
        return _parse_rhythm(lines, kind, width)
    if kind == "bh":
        return _parse_beat_histogram(lines, width)
    if kind == "notes":
        return _parse_notes(lines)
    if kind == "chroma":
        return _parse_chroma(lines)
    if kind == "mfcckl":
        return _parse_gaussian(lines, width or MFCC_WIDTH)
    if kind == "mfcc":
        return _parse_euclid(lines, width or MFCC_WIDTH)
    raise ValueError(kind)


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason", "value", "path")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("path", F.col("value").alias("line"), "reason")


def success_log(parsed: DataFrame) -> DataFrame:
    """Per file: lines read, kept and put aside."""
    return parsed.groupBy("path").agg(
        F.count("*").alias("lines"),
        F.count(F.when(F.col("reason").isNull(), 1)).alias("kept"),
        F.count("reason").alias("quarantined"),
    )


def read_features(
    spark: SparkSession, path: str, kind: str, width: int | None = None, partitions: int | None = None
) -> DataFrame:
    """Good rows of all files under the path or glob."""
    return good(parse(read_lines(spark, path, partitions), kind, width))


def read_part_files(spark: SparkSession, mean: str, var: str, cov: str) -> DataFrame:
    """Euclidean MFCC from three files `id; [..]`, kept where the mean is there."""

    def part(path: str, name: str) -> DataFrame:
        pattern = _fields(1)
        return read_lines(spark, path).select(
            ids.clean_id(_field(pattern, 1)).alias("id"), vectors.parse_numbers(_field(pattern, 2)).alias(name)
        )

    joined = part(mean, "mean").join(part(var, "var"), "id", "left").join(part(cov, "cov"), "id", "left")
    return joined.select("id", F.concat("mean", "var", "cov").alias("mfcc_euclid"))


# Writers -------------------------------------------------------------------------------------


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ","), F.lit("]"))


def to_lines(df: DataFrame, kind: str, width: int | None = None) -> DataFrame:
    """Rows back to text lines of their kind (notes as numbers); `width` is the length of the means of `mfcckl` and `mfcc`."""
    if kind in ("rp", "rh"):
        line = F.concat_ws(",", F.col("id"), F.array_join(F.col(kind).cast("array<string>"), ","))
    elif kind == "bh":
        line = F.concat_ws("; ", F.col("id"), F.col("bpm").cast("string"), _list(F.col("bh")))
    elif kind == "notes":
        numbers = F.transform(F.split("notes", "(?!$)"), lambda c: F.instr(F.lit(symbols.LETTERS), c) - 1)
        line = F.concat_ws("; ", F.col("id"), F.col("key"), F.col("scale"), _list(numbers))
    elif kind == "chroma":
        rows = F.transform(vectors.rows_of(F.col("chroma"), PITCHES), _list)
        line = F.concat_ws("; ", F.col("id"), _list(rows))
    elif kind == "mfcckl":
        d = MFCC_WIDTH if width is None else width
        cov = F.transform(vectors.rows_of(F.slice("mfcc", d + 1, d * d), d), _list)
        line = F.concat_ws("; ", F.col("id"), _list(F.slice("mfcc", 1, d)), _list(cov))
    elif kind == "mfcc":
        # mean and variance of n numbers, then the triangle with or without its diagonal: n * (n + 1) / 2 or n * (n - 1) / 2
        vector, d = F.col("mfcc_euclid"), MFCC_WIDTH if width is None else width
        parts = [F.slice(vector, 1, d), F.slice(vector, d + 1, d), F.slice(vector, F.lit(2 * d + 1), F.size(vector))]
        line = F.concat_ws("; ", F.col("id"), *[_list(p) for p in parts])
    else:
        raise ValueError(kind)
    return df.select(line.alias("value"))


def write_features(features: dict[str, DataFrame], folder: str, mode: str = "append") -> None:
    """One output folder per feature type."""
    for kind, df in features.items():
        to_lines(df, kind).write.mode(mode).text(f"{folder}/feature={kind}")
