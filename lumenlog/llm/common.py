"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import store as materialize  # noqa: F401

#: A-Z to a-z, 0-9, a-z and every byte of a non-ASCII character as they are, the rest to a space.
WORD_FOLD = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
#: A-Z to a-z, every other byte as it is.
LOWER_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(doc_id).cast("string")) % mod


def binary_values(column) -> list:
    """The texts of an Arrow string array as bytes objects, without decoding them."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist() if pa.types.is_string(column.type) else column.cast(pa.large_binary()).to_pylist()
