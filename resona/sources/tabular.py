"""Parquet, JSON, CSV, databases, class files, playlists, result lists, audio listings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.functions import ids, vectors

MERGED_SCHEMA = (
    "id string, chroma array<double>, mfcc array<double>, key string, scale string, notes string, "
    "rp array<double>, rh array<double>, bpm double, bh array<double>"
)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_catalogue(df: DataFrame, path: str, mode: str = "overwrite", sort_by: str | None = "id") -> None:
    """Parquet; sorted within files by id, so that a lookup skips row groups."""
    (df.sortWithinPartitions(sort_by) if sort_by else df).write.mode(mode).parquet(path)


def save_bucketed(df: DataFrame, table: str, buckets: int, id_col: str = "id", path: str | None = None) -> None:
    """A table bucketed by id: joins of two such tables need no shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, id_col).sortBy(id_col)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_sharded(df: DataFrame, path: str, id_col: str = "id", mode: str = "overwrite") -> None:
    """Folders by the last two characters of the id."""
    df.withColumn("shard", ids.shard_of(F.col(id_col))).write.mode(mode).partitionBy("shard").parquet(path)


def read_json(spark: SparkSession, path: str, schema: str = MERGED_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header; text columns unless a schema says otherwise."""
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).csv(path)


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A ranked list as tab-separated text with a header."""
    write_csv(df, path, sep="\t", mode=mode)


def read_database(spark: SparkSession, url: str, tables: Sequence[str], **options: str) -> dict[str, DataFrame]:
    """Tables of a relational database."""
    return {t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for t in tables}


def read_numeric_csv(
    spark: SparkSession,
    path: str,
    id_cols: int | Sequence[int] = 0,
    sep: str = ",",
    ids_only: bool = False,
) -> DataFrame:
    """Headerless numbers with id columns anywhere; negative positions count from the end."""
    raw = spark.read.option("sep", sep).csv(path)
    names = raw.columns
    wanted = [id_cols] if isinstance(id_cols, int) else list(id_cols)
    places = [i % len(names) for i in wanted]
    labels = ["id"] if len(places) == 1 else [f"id_{i}" for i in range(len(places))]
    id_columns = [F.col(names[p]).alias(label) for p, label in zip(places, labels)]
    if ids_only:
        return raw.select(*id_columns)
    values = [F.col(n).try_cast("double") for i, n in enumerate(names) if i not in places]
    return raw.select(*id_columns, F.array(*values).alias("features"))


def read_many(spark: SparkSession, paths: Sequence[str], reader=read_numeric_csv, **options) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [reader(spark, p, **options) for p in paths])


def write_per_feature(features: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """All features under one folder, one sub-folder per feature type."""
    for name, df in features.items():
        df.write.mode(mode).parquet(f"{path}/feature={name}")


# Class files -----------------------------------------------------------------------------------


def read_classes(
    spark: SparkSession, path: str, sep: str = "\t", cut_path: bool = False, cut_ext: bool = False
) -> DataFrame:
    """`id <tab> class` without header."""
    df = spark.read.schema("id string, class string").option("sep", sep).csv(path)
    key = ids.base_name(F.col("id")) if cut_path else F.col("id")
    return df.withColumn("id", ids.strip_extension(key) if cut_ext else key)


def read_class_table(
    spark: SparkSession, path: str, sep: str = "\t", positive: str = "x", cut_ext: bool = False
) -> DataFrame:
    """Header of classes, one line per id, marked cells; other than blank or mark is an error value (null)."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    first, *classes = raw.columns
    key = ids.strip_extension(ids.base_name(F.col(f"`{first}`"))) if cut_ext else F.col(f"`{first}`")

    def mark(name: str):
        cell = F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))
        return F.when(cell.isin(positive, "1"), 1).when(cell.isin("", "0"), 0).alias(name)

    return raw.select(key.alias("id"), *[mark(c) for c in classes])


def write_class_list(df: DataFrame, path: str, column: str = "class", mode: str = "overwrite") -> None:
    write_csv(df.select("id", column), path, sep="\t", header=False, mode=mode)


def write_class_table(df: DataFrame, path: str, positive: str = "x", mode: str = "overwrite") -> None:
    """0/1 columns as marks."""
    marks = [F.when(F.col(f"`{c}`") == 1, positive).otherwise("").alias(c) for c in df.columns if c != "id"]
    df.select("id", *marks).write.mode(mode).option("sep", "\t").option("header", True).option(
        "emptyValue", ""
    ).csv(path)


# Playlists, result lists, audio ------------------------------------------------------------------

PLAYLIST_SCHEMA = "playlists array<struct<tracks: array<struct<track_uri: string>>>>"
URI_PREFIX = 14


def playlist_track_ids(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Distinct track ids of playlist slices, the URI without its prefix.

    A slice is one document over many lines, or (`multi_line=False`) one line.
    """
    slices = spark.read.schema(PLAYLIST_SCHEMA).option("multiLine", multi_line).json(path)
    uris = slices.select(F.explode("playlists").alias("p")).select(F.explode("p.tracks.track_uri").alias("uri"))
    return uris.select(F.substring("uri", F.lit(URI_PREFIX + 1), F.length("uri")).alias("id")).distinct()


RESULT_COLUMNS = "idx string, id string, key string, scale string, bpm double, " + ", ".join(
    f"scaled_{n} double" for n in ("rp", "rh", "bh", "notes", "chroma", "skl", "js", "mfcc")
) + ", aggregated double"


def _list_of(named: str) -> Column:
    """The query a row belongs to: the name of its file, or of the file's folder (`name=value`: the value)."""
    if named == "file":
        return ids.strip_extension(ids.base_name(F.input_file_name()))
    if named == "folder":
        return F.url_decode(F.regexp_extract(F.input_file_name(), r"(?:[^/=]*=)?([^/]*)/[^/]*$", 1))
    raise ValueError(named)


def read_result_lists(
    spark: SparkSession, path: str, schema: str = RESULT_COLUMNS, named: str = "file", sep: str = ",", stream: bool = False
) -> DataFrame:
    """Many ranked lists as one table (or one stream of files), with the file or folder each row comes from as `query`."""
    reader = spark.readStream if stream else spark.read
    reader = reader.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep)
    if named == "folder":
        reader = reader.option("recursiveFileLookup", True)
    return reader.csv(path).withColumn("query", _list_of(named))


def list_audio(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files below a folder by extension, hidden ones left out; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ).select("path", "length", "modificationTime")
    return files.filter(ids.is_audio(F.col("path")))


def features_as_columns(df: DataFrame, column: str, width: int, prefix: str) -> DataFrame:
    """A vector as single columns, for tools that want a flat table."""
    source = vectors.doubles(F.col(column))
    return df.select("id", *[source[i].alias(f"{prefix}_{i}") for i in range(width)])
