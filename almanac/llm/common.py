"""What the operators of this subpackage share: checkpoints, shared folders, row helpers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac import checkpoint_dir, cut, release, ship  # noqa: F401

#: White space of every contract: 0x09-0x0D and 0x20.
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new local path inside the shared folder, for model files that every worker maps.

    The folder has to be mounted on every machine (a file: URI); object stores have no mmap."""
    url = urlparse(checkpoint_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped model files need a mounted shared folder, not {url.scheme}:")
    path = os.path.join(url.path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def sliced(batches, rows: int = 500):
    """The rows of Arrow batches in runs of at most ``rows``, so that few whole texts become Python objects at a time.

    Spark itself bounds a batch's bytes (spark.sql.execution.arrow.maxBytesPerBatch); no setting of the session is touched."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def per_text(df: DataFrame, run: Callable[[list], list[tuple]], fields: str, text: str = "text", key: str = "doc_id", rows: int = 500) -> DataFrame:
    """key and ``fields``: run() gets at most ``rows`` texts and returns a tuple of fields for each.

    The keys pass through as Arrow, so null keys and full 64-bit ids stay as they are."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    ship(df.sparkSession)
    own = StructType([StructField("k", df.schema[key].dataType), *StructType.fromDDL(fields).fields])
    kinds = to_arrow_schema(own)

    def batches(source):
        for b in sliced(source, rows):
            columns = list(zip(*run(b.column(1).to_pylist()), strict=True)) or [()] * (len(kinds) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(kinds.field(0).type), *[pa.array(c, kinds.field(i + 1).type) for i, c in enumerate(columns)]], schema=kinds)

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(batches, own).withColumnRenamed("k", key)
