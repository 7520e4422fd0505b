"""Readers: text in, types by explicit casts; file order kept where it is data."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.aggregates import union_relaxed


def text_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file with a header, every column as text (columns change type late in a file)."""
    return spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a given schema; columns are found by name, what doesn't parse is null."""
    names = StructType.fromDDL(schema)
    raw = text_csv(spark, path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in names])


def chosen(manifest: list[str], *needles: str) -> list[tuple[int, str]]:
    """(rank, path) of the manifest's paths that contain any needle, in its order."""
    return [(i, p) for i, p in enumerate(manifest) if p and any(n in p for n in needles)]


def volumes(spark: SparkSession, folder: str, manifest: list[str], *needles: str, per_file: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All chosen volumes as text, with file_rank and line_no, which together are the register's order.

    Each file is read whole by one task (a volume is a book), so that its lines can be counted; files run apart."""
    frames = []
    for rank, path in chosen(manifest, *needles):
        df = text_csv(spark, f"{folder}/{path}").withColumns({"file_rank": F.lit(rank), "line_no": F.monotonically_increasing_id()})
        frames.append(per_file(df) if per_file else df)
    return union_relaxed(frames)


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small text file, in order."""
    return [x for x in spark.read.text(path, wholetext=True).first()[0].splitlines() if x]


def positional_tsv(spark: SparkSession, path: str, names: list[str], trim: bool = True) -> DataFrame:
    """A headerless tab-separated file without quoting: columns by place, surplus ones cut, empty ones null.

    Fails if the first line has fewer fields than names."""
    lines = spark.read.text(path)
    first = lines.first()
    if first is not None and len(first[0].split("\t")) < len(names):
        raise ValueError(f"{path}: {len(first[0].split(chr(9)))} fields in the first line, {len(names)} expected")
    fields = F.split("value", "\t", -1)
    clean = (lambda c: F.nullif(F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", ""), F.lit(""))) if trim else (lambda c: c)
    return lines.select(*[clean(F.get(fields, F.lit(i))).alias(n) for i, n in enumerate(names)])


def page_heads(spark: SparkSession, path: str) -> DataFrame:
    """volume, page, head: from files that hold one JSON object {page: text}."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("volume"), F.from_json("value", "map<string,string>").alias("m"))
    return raw.select("volume", F.explode("m").alias("page", "head")).select("volume", F.col("page").try_cast("int").alias("page"), "head")


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV as text."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else text_csv(spark, path)


# ---------------------------------------------------------------- shapefiles


def parse_shp(data: bytes) -> list[list[list[tuple[float, float]]] | None]:
    """The rings of each polygon record; None for a null shape."""
    out, at = [], 100
    while at + 12 <= len(data):
        (length,) = struct.unpack_from(">i", data, at + 4)
        (kind,) = struct.unpack_from("<i", data, at + 8)
        if kind in (5, 15, 25):
            parts, points = struct.unpack_from("<2i", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            xy = list(zip(flat[::2], flat[1::2], strict=True))
            out.append([xy[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)])
        else:
            out.append(None)
        at += 8 + 2 * length
    return out


def parse_dbf(data: bytes, encoding: str = "utf-8") -> tuple[list[str], list[list[str | None]]]:
    """Field names, and each record's values as text."""
    rows, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    out = []
    for i in range(rows):
        at, row = head + i * size + 1, []
        for _, n in fields:
            row.append(data[at : at + n].decode(encoding, "replace").strip() or None)
            at += n
        out.append(row)
    return [n for n, _ in fields], out


def shapefile(spark: SparkSession, folder: str, tag: str | None = None) -> DataFrame:
    """The polygons of all .shp files of a folder with their .dbf columns (as text), rings and the file's name."""
    from .. import ship
    from ..operators.geometry import RINGS

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.(shp|dbf)$", 1).alias("layer"), F.regexp_extract("path", r"\.(shp|dbf)$", 1).alias("kind"), "content")

    def run(rows):
        import pandas as pd

        parts = {k: bytes(c) for k, c in zip(rows["kind"], rows["content"], strict=True)}
        names, values = parse_dbf(parts["dbf"]) if "dbf" in parts else ([], [])
        out = []
        for i, rings in enumerate(parse_shp(parts["shp"]) if "shp" in parts else []):
            if rings:
                attributes = dict(zip(names, values[i], strict=True)) if i < len(values) else {}
                out.append((rows["layer"].iloc[0], i, {k: v for k, v in attributes.items() if v is not None}, [[{"x": x, "y": y} for x, y in r] for r in rings]))
        return pd.DataFrame(out, columns=["layer", "feature", "attributes", "rings"])

    out = named.groupBy("layer").applyInPandas(run, StructType.fromDDL(f"layer string, feature int, attributes map<string,string>, rings {RINGS}"))
    return out.withColumn("tag", F.lit(tag)) if tag else out


def strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])
