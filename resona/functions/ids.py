"""Track ids: cleaning, shards, classes taken from paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: audio extensions
EXTENSIONS = ["mp3", "wav", "m4a", "aiff", "aif", "au", "flac", "ogg"]

_EXTENSION = r"\.(?:" + "|".join(EXTENSIONS) + r")\b"


def clean_id(raw: Column, root: str = "audio/") -> Column:
    """Path to id: root, byte-literal quoting, extension and separators removed.

    Different paths can meet in one id; `operators.catalogue.duplicate_keys` finds those.
    """
    unrooted = F.regexp_replace(raw, root, "") if root else raw
    unquoted = F.regexp_replace(unrooted, r"b'", "")
    return F.regexp_replace(F.regexp_replace(unquoted, r"\.mp3", ""), r"[;.,\s\"'/]", "")


def strip_prefix(raw: Column, pattern: str) -> Column:
    return F.regexp_replace(raw, "^" + pattern, "")


def strip_bucket(raw: Column, length: int = 3) -> Column:
    """Without the leading shard folder, e.g. `ab/`."""
    return F.substring(raw, F.lit(length + 1), F.length(raw))


def base_name(raw: Column) -> Column:
    return F.regexp_extract(raw, r"([^/]+)/*$", 1)


def strip_extension(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\.[^./]+$", "")


def is_audio(path: Column) -> Column:
    return F.lower(path).rlike(_EXTENSION + "$") & ~base_name(path).startswith(".")


def class_from_path(path: Column, level: int = 0) -> Column:
    """The `level`-th folder of a relative path, the usual place of a genre or work title."""
    return F.element_at(F.split(path, "/"), level + 1)


def class_from_prefix(name: Column, separator: str = "_") -> Column:
    return F.element_at(F.split(name, separator), 1)


def batch_of(key: Column, batches: int) -> Column:
    """Stable batch number 0..batches-1."""
    return F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")


def shard_of(key: Column, length: int = 2) -> Column:
    """The last characters of an id."""
    return F.substring(key, -length, length)
