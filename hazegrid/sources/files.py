"""CSV, JSON, GeoJSON and WKT readers."""

from __future__ import annotations

import csv
import json
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid import schemas
from hazegrid.functions import geometry as G
from hazegrid.functions.names import named


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, headers: Headers | None = None
) -> DataFrame:
    """CSV with a header row, columns found by the header's names.

    ``path`` is a file or a folder of files. Files may have their columns in any order;
    one that lacks a column of the schema has nulls there, and a column that the schema
    does not name is left out. Empty fields are null; NaN text too. A quoted text may
    hold line breaks. ``headers`` are those that ``csv_headers`` has found, if known.
    """
    return _by_header(spark, path, schema, False, headers)


def read_csv_folder(
    spark: SparkSession, path: str, schema: T.StructType | str, headers: Headers | None = None
) -> DataFrame:
    """Every ``*.csv`` file of a folder, appended by column name.

    Columns that the schema does not name are kept as text.
    """
    return _by_header(spark, path, schema, True, headers, pathGlobFilter="*.csv")


#: For each header, and whether records span lines: its files.
Headers = Mapping[tuple[tuple[str, ...], bool], Sequence[str]]


def csv_headers(spark: SparkSession, path: str, **options: str) -> Headers:
    """Files grouped by header and by whether a quoted text in them holds a line break.

    One pass over the lines, in one job for all files. A line with an odd number of quotes
    begins or ends a text that goes over several lines; a file without one can be split at
    any line. Per file, only its header reaches the driver.
    """
    lines = spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = lines.groupBy("file").agg(
        F.min_by("value", F.when((F.col("block") == 0) & (F.trim("value") != ""), F.col("place"))).alias("header"),
        F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)).alias("spans"),
    )
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for r in sorted(found.where("header IS NOT NULL").collect(), key=lambda r: r.file):
        if r.spans and r.header.count('"') % 2:
            # The header itself goes over several lines.
            names = tuple(_reader(spark, True).csv(unquote(r.file)).columns)
        else:
            names = _column_names(next(csv.reader([r.header.removeprefix("\ufeff")])))
        groups.setdefault((names, r.spans), []).append(unquote(r.file))
    return groups


def _column_names(header: Sequence[str]) -> tuple[str, ...]:
    """A nameless column is named by its place, and one of several of a name gets it added."""
    many = Counter(name.lower() for name in header)
    return tuple(f"_c{i}" if not n else f"{n}{i}" if many[n.lower()] > 1 else n for i, n in enumerate(header))


def _reader(spark: SparkSession, spans: bool) -> DataFrameReader:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", spans)


def _by_header(
    spark: SparkSession, path: str, schema: T.StructType | str, extra: bool, headers: Headers | None, **options: str
) -> DataFrame:
    """Read files of one header together, with that header's order of columns.

    Only files with line breaks inside their texts are read whole by a task each.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    groups = csv_headers(spark, path, **options) if headers is None else headers
    known = {f.name: f for f in wanted.fields}
    frames = []
    for (header, spans), files in groups.items():
        typed = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
        # One group is the whole folder, which is listed faster than its files.
        source = _reader(spark, spans).options(**options).schema(typed)
        df = source.csv(path if len(groups) == 1 else list(files))
        frames.append(df if extra else df.select(*[named(c) for c in header if c in known]))
    df = union_by_name([spark.createDataFrame([], wanted), *frames]) if frames else spark.createDataFrame([], wanted)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(named(c), F.lit(None)) for c in floats}) if floats else df


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Append tables with differing columns; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_json_records(
    spark: SparkSession, path: str, record: str, field: str = "Data", multi_line: bool = False, split: bool = False
) -> DataFrame:
    """Payloads ``{field: [record, ...]}`` to one row per record.

    ``record`` is the record's type, e.g. ``struct<code: string>``. One payload per
    line is splittable; set ``multi_line`` for one payload per file, and ``split`` where
    such a file is large (``split_records``).
    """
    if split:
        return split_records(spark, path, record, field)
    payload = spark.read.schema(f"{field} array<{record}>").json(path, multiLine=multi_line)
    return payload.select(F.explode(field).alias("r")).select("r.*")


#: Bytes of a file in which its first two records are looked for.
HEAD = 4 * 1024 * 1024


def split_records(spark: SparkSession, path: str, record: str, field: str) -> DataFrame:
    """The records of a file that is one payload, read by as many tasks as its size needs.

    The text between two records, with the beginning that all of them share (their first
    key), is found in the head of the file and then used as the line separator: byte
    ranges of the file are cut at it, and each piece is a record but for that beginning.
    All files of a folder have to be written in the same way, as one program does. A piece that
    is no whole record, as when the separator also occurs inside one, fails the job; read
    such a file with ``multi_line``. A file of fewer than two records is read as a whole.
    """
    between = _record_separator(_head_of(spark, path), field)
    if between is None:
        return read_json_records(spark, path, record, field, multi_line=True)
    opening = between[between.index("{") :]
    kind = T._parse_datatype_string(record)
    typed = T.StructType([*kind.fields, T.StructField("__broken", T.StringType())])
    piece = F.col("value")
    # The first piece of a file is led by what stands before the records.
    led = F.regexp_extract("value", rf'(?s)^\s*\{{.*?"{re.escape(field)}"\s*:\s*\[\s*(\{{.*)$', 1)
    first = (F.col("_metadata.file_block_start") == 0) & (led != "")
    text = F.concat(F.when(first, led).otherwise(F.concat(F.lit(opening), piece)), F.lit("}"))
    # What follows a record, as the last one's end of the payload, is not read.
    pieces = spark.read.text(path, lineSep=between).where(F.trim("value") != "")
    parsed = pieces.select(F.from_json(text, typed, {"columnNameOfCorruptRecord": "__broken"}).alias("r"), piece.alias("p"))
    message = F.concat(F.lit("not a whole record, read with multi_line: "), F.substring("p", 1, 200))
    whole = F.when(F.col("r.__broken").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return parsed.where(whole).select(*[F.col("r")[f.name].alias(f.name) for f in kind.fields])


def _head_of(spark: SparkSession, path: str) -> str:
    """The first characters of the first file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path").orderBy("path").limit(1).collect()
    if not files:
        return ""
    at = hadoop.Path(files[0]["path"])
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEAD)))
    finally:
        stream.close()
    return data.decode("utf-8", "ignore")


def _record_separator(head: str, field: str) -> str | None:
    """From the end of the first record to the first key of the second, both braces included."""
    start = re.search(rf'"{re.escape(field)}"\s*:\s*\[\s*(?=\{{)', head)
    if start is None:
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(head, start.end())
    except ValueError:  # the first record is larger than the head
        return None
    key = re.compile(r'\}\s*,\s*\{\s*"(?:[^"\\]|\\.)*"').match(head, end - 1)
    first = re.compile(r'\{\s*"(?:[^"\\]|\\.)*"').match(head, start.end())
    # The records have to begin alike.
    return key[0] if key and first and key[0].endswith(first[0]) else None


def read_feeds(
    spark: SparkSession,
    path: str,
    metrics: Sequence[str],
    site_fields: Sequence[str],
    channel_fields: Sequence[str] = ("name", "id", "created_at", "updated_at"),
    multi_line: bool = False,
) -> DataFrame:
    """Channel payloads to one row per feed entry.

    The header maps ``field1``, ``field2``, ... to metric names; the entries use
    the short names. Header keys holding ``field`` and a word character after it
    are metrics. Each entry's metrics are renamed through the map, so no pivot
    and no shuffle is needed. A metric a channel does not have is null.
    """
    payload = spark.read.schema(schemas.FEED).json(path, multiLine=multi_line)
    names = F.map_filter("channel", lambda k, _: k.rlike(r"field\w+"))
    entry = payload.select(
        "channel", "site", names.alias("names"), F.explode("feeds").alias("entry")
    )
    named = F.map_from_entries(
        F.transform(
            F.map_entries("names"),
            lambda e: F.struct(e["value"].alias("key"), F.try_element_at(F.col("entry"), e["key"]).alias("value")),
        )
    )
    return (
        entry.withColumn("values", named)
        .select(
            F.col("entry")["created_at"].alias("created_at"),
            *[F.try_element_at(F.col("values"), F.lit(m)).alias(m) for m in metrics],
            *[F.col("channel")[c].alias(f"channel_{c}") for c in channel_fields],
            *[F.col("site")[c].alias(c) for c in site_fields],
        )
    )


def _shapes(df: DataFrame) -> DataFrame:
    """``parts`` to ``rings``, ``holes`` and ``bbox``."""
    flat = df.withColumns({"rings": F.flatten("parts"), "holes": G.holes_of(F.col("parts"))})
    return flat.withColumn("bbox", G.bbox(F.col("rings"))).drop("parts")


def read_geojson(
    spark: SparkSession, path: str, properties: Sequence[str], multi_line: bool = False, split: bool = False
) -> DataFrame:
    """FeatureCollections to properties, ``rings``, ``holes`` and ``bbox``.

    ``split`` is for large files of one collection each (``split_records``).
    """
    feature = T._parse_datatype_string(schemas.GEOJSON)["features"].dataType.elementType
    shapes = read_json_records(spark, path, feature.simpleString(), "features", multi_line, split)
    parts = G.parts_from_geojson(F.col("geometry.type"), F.col("geometry.coordinates"))
    return _shapes(shapes.select(*[F.col("properties")[p].alias(p) for p in properties], parts.alias("parts")))


def read_wkt(
    spark: SparkSession, path: str, schema: T.StructType | str, geometry: str = "geometry"
) -> DataFrame:
    """CSV with a WKT column to a shape table (``rings``, ``holes``, ``bbox``)."""
    df = read_csv(spark, path, schema)
    return _shapes(df.withColumn("parts", G.parts_from_wkt(F.col(geometry))).drop(geometry))
