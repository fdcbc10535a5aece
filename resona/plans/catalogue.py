"""From feature files to a clean, enriched catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from resona.operators import catalogue as C
from resona.sources import feature_text

KINDS = ("chroma", "mfcckl", "notes", "rp", "rh", "bh")


def ingest(
    spark: SparkSession,
    folder: str,
    kinds: Sequence[str] = KINDS,
    how: str = "inner",
    repeated: str = "all",
    widths: dict[str, int] | None = None,
) -> DataFrame:
    """All shards `out*.<kind>` below the folder as one wide row per track.

    Lines of another length than the format's (or the one `widths` names for a kind) are left out.
    """
    widths = widths or {}
    parts = [feature_text.read_features(spark, f"{folder}/out*.{kind}", kind, widths.get(kind)) for kind in kinds]
    return C.assemble(parts, how=how, repeated=repeated)


def build(
    catalogues: Sequence[DataFrame],
    metadata: DataFrame | None = None,
    size: int | None = None,
    id_col: str = "id",
) -> DataFrame:
    """Union, drop equal rows, keep the ids seen once, add metadata, cut to a size if asked."""
    merged = C.union_catalogues(*catalogues)
    clean = C.unique_rows(merged, [id_col])
    if metadata is not None:
        clean = C.enrich(clean, metadata, id_col)
    return C.subset(clean, size, id_col) if size is not None else clean
