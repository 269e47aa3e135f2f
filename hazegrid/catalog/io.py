"""Readers and writers: rows are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog import register
from hazegrid.catalog import tables as D
from hazegrid.catalog.exprs import area_sql
from hazegrid.catalog.tables import with_tables
from hazegrid.functions import geometry as G
from hazegrid.session import new_path
from hazegrid.sources import files, tables

EVENT_ROWS = "event_id bigint, sensor_id bigint, pm double, time timestamp_ntz, note string"
EVENTS_SQL = with_tables(
    "readings",
    """SELECT event_id, sensor_id, pm, date_trunc('second', time) AS time,
              'a "' || source || '",' || chr(10) || ' or so' AS note FROM readings""",
)


def _rows(spark, d):
    note = F.concat(F.lit('a "'), F.col("source"), F.lit('",\n or so'))
    seconds = F.to_timestamp_ntz(F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    return D.readings(spark, d).select(
        "event_id", "sensor_id", "pm", seconds.alias("time"), note.alias("note")
    )


@register("csv_scan", "SELECT *, c_name || chr(10) || c_mktsegment AS c_label FROM customer")
def csv_scan(spark, d):
    """One text of two lines."""
    path, customers = new_path(spark, "csv-scan"), D.table(spark, d, "customer")
    labelled = customers.withColumn("c_label", F.concat_ws("\n", "c_name", "c_mktsegment"))
    tables.write_csv(labelled, path)
    return files.read_csv(spark, path, labelled.schema)


@register("csv_sink", EVENTS_SQL)
def csv_sink(spark, d):
    """Quotes, commas, line breaks and missing values survive the text form."""
    path = new_path(spark, "csv-sink")
    tables.write_csv(_rows(spark, d), path)
    return files.read_csv(spark, path, EVENT_ROWS)


@register(
    "csv_dir_union",
    f"SELECT *, CASE WHEN pm IS NULL THEN 'gap' END AS remark FROM ({EVENTS_SQL})",
)
def csv_dir_union(spark, d):
    """Files with another order of columns, NaN text for a gap, and one column more."""
    path = new_path(spark, "csv-folder")
    rows = _rows(spark, d)
    gaps = rows.where("pm IS NULL").select("note", F.lit("NaN").alias("pm"), "time", F.lit("gap").alias("remark"), "sensor_id", "event_id")
    tables.write_csv(gaps, path, "append")
    tables.write_csv(rows.where("pm IS NOT NULL"), path, "append")
    return files.read_csv_folder(spark, path, EVENT_ROWS)


@register(
    "csv_union_by_name",
    with_tables(
        "readings",
        """SELECT event_id, CASE WHEN source = 'AQ' THEN lat END AS lat, CASE WHEN source = 'EPA' THEN pm END AS pm,
                  CASE WHEN source = 'PA' THEN lon END AS lon FROM readings""",
    ),
)
def csv_union_by_name(spark, d):
    """Tables with differing columns are appended by column name."""
    r, frames = D.readings(spark, d), []
    for source, column in (("AQ", "lat"), ("EPA", "pm"), ("PA", "lon")):
        path = new_path(spark, f"csv-{source}")
        tables.write_csv(r.where(F.col("source") == source).select("event_id", column), path)
        frames.append(files.read_csv(spark, path, f"event_id bigint, {column} double"))
    return files.union_by_name(frames)


@register(
    "json_records_scan",
    with_tables("readings", "SELECT event_id, pm, source FROM readings"),
)
def json_records_scan(spark, d):
    """Payloads of at most 50 records, as a service pages them."""
    path = new_path(spark, "json-records")
    record = F.struct("event_id", "pm", "source")
    pages = (
        D.readings(spark, d)
        .groupBy(F.floor(F.col("event_id") / 50).alias("page"))
        .agg(F.collect_list(record).alias("Data"))
        .select(F.to_json(F.struct("Data")).alias("value"))
    )
    pages.write.text(path)
    return files.read_json_records(
        spark, path, "struct<event_id: bigint, pm: double, source: string>"
    )


@register(
    "json_records_split",
    with_tables("readings", "SELECT event_id, pm, source FROM readings"),
)
def json_records_split(spark, d):
    """All records in one payload of one file, read by several tasks."""
    path = new_path(spark, "json-payload")
    texts = D.readings(spark, d).select(F.to_json(F.struct("event_id", "pm", "source")).alias("value"))
    # One file on purpose: it begins and ends the payload. All tasks make records; the one that writes
    # passes them on as they come and holds none, so it only counts them to know the last.
    place, last = F.monotonically_increasing_id(), texts.agg(F.count("*")).scalar() - 1
    lines = texts.repartition(1).withColumn("place", place)
    led = F.when(F.col("place") == 0, '{"count": 1, "Data": [').otherwise(", ")
    ended = F.when(F.col("place") == last, "]}").otherwise("")
    lines.select(F.concat(led, "value", ended).alias("value")).write.option("lineSep", "\n").text(path)
    return files.read_json_records(spark, path, "struct<event_id: bigint, pm: double, source: string>", split=True)


@register(
    "json_dynamic_fields",
    with_tables(
        "readings",
        """SELECT strftime(time, '%Y-%m-%dT%H:%M:%SZ') AS created_at, event_id::VARCHAR AS "Entry",
                  CASE WHEN sensor_id % 2 = 0 THEN round(value * 100)::BIGINT::VARCHAR END AS "PM2.5 (ATM)",
                  CASE WHEN sensor_id % 2 = 1 THEN round(value * 100)::BIGINT::VARCHAR END AS "PM2.5 (CF=1)",
                  'Monitor ' || sensor_id AS channel_name, sensor_id::VARCHAR AS "ID" FROM readings""",
    ),
)
def json_dynamic_fields(spark, d):
    """Channels name their fields differently: the header says which metric is which."""
    path = new_path(spark, "json-feeds")
    hundredths = F.round(F.col("value") * 100).cast("bigint").cast("string")
    entry = F.create_map(
        F.lit("created_at"),
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("field1"),
        hundredths,
        F.lit("field2"),
        F.col("event_id").cast("string"),
    )
    metric = F.when(F.col("sensor_id") % 2 == 0, "PM2.5 (ATM)").otherwise("PM2.5 (CF=1)")
    name = F.concat(F.lit("Monitor "), F.col("sensor_id").cast("string"))
    header = F.create_map(
        F.lit("name"), name, F.lit("field1"), metric, F.lit("field2"), F.lit("Entry")
    )
    payloads = (
        D.readings(spark, d)
        .withColumn("page", F.floor(F.col("event_id") / 500))
        .groupBy("sensor_id", "page")
        .agg(F.collect_list(entry).alias("feeds"))
        .select(
            header.alias("channel"),
            "feeds",
            F.create_map(F.lit("ID"), F.col("sensor_id").cast("string")).alias("site"),
        )
    )
    payloads.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return files.read_feeds(
        spark, path, ["Entry", "PM2.5 (ATM)", "PM2.5 (CF=1)"], ["ID"], ["name"]
    )


_SHAPE_SQL = f"""SELECT e.pid AS id, xmin, ymin, xmax, ymax, rings, sides, area_3857_km2 FROM
    (SELECT pid, min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax,
            count(DISTINCT ring)::INTEGER AS rings, count(*)::INTEGER AS sides FROM shape_edges GROUP BY pid) e
    JOIN ({area_sql("shape_edges")}) a ON a.pid = e.pid"""
_SHAPE_EDGES = "SELECT * FROM area_edges UNION ALL SELECT * FROM block_edges"


def _all_shapes(spark, d):
    """Neighborhoods, of two parts, and blocks, of one."""
    areas = D.neighborhoods(spark, d).select(F.col("pri_neigh").alias("id"), "rings", "holes")
    blocks = D.blocks(spark, d).select(F.col("geoid10").alias("id"), "rings", F.lit(None).cast("array<boolean>").alias("holes"))
    return areas.union(blocks)


def _shape_rows(df):
    return df.select(
        "id",
        "bbox.*",
        F.size("rings").alias("rings"),
        F.size(G.edges(F.col("rings"))).alias("sides"),
        G.area_3857_km2(F.col("rings"), F.col("holes")).alias("area_3857_km2"),
    )


@register(
    "geojson_scan",
    with_tables("area_edges block_edges", _SHAPE_SQL, shape_edges=_SHAPE_EDGES),
    {"area_3857_km2": 4},
)
def geojson_scan(spark, d):
    """Shapes of several parts are MultiPolygon, the others Polygon."""
    path = new_path(spark, "geojson")
    rings = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    several = F.col("holes").isNotNull()
    kind = F.when(several, "MultiPolygon").otherwise("Polygon")
    text = F.when(several, F.to_json(F.array(F.slice(rings, 1, 2), F.slice(rings, 3, 2)))).otherwise(F.to_json(rings))
    feature = F.concat(
        F.lit('{"features": [{"properties": '),
        F.to_json(F.struct("id")),
        F.lit(', "geometry": {"type": "'),
        kind,
        F.lit('", "coordinates": '),
        text,
        F.lit("}}]}"),
    )
    _all_shapes(spark, d).select(feature.alias("value")).write.text(path)
    return _shape_rows(files.read_geojson(spark, path, ["id"]))


@register(
    "wkt_scan",
    with_tables("area_edges block_edges", _SHAPE_SQL, shape_edges=_SHAPE_EDGES),
    {"area_3857_km2": 4},
)
def wkt_scan(spark, d):
    """POLYGON and MULTIPOLYGON texts."""
    path = new_path(spark, "wkt")
    one, several = G.rings_to_wkt(F.col("rings")), G.rings_to_wkt(F.col("rings"), F.col("holes"))
    shapes = _all_shapes(spark, d).select("id", F.coalesce(several, one).alias("geometry"))
    tables.write_csv(shapes, path)
    return _shape_rows(files.read_wkt(spark, path, "id string, geometry string"))


def _by_source(spark, d, path):
    rows = D.readings(spark, d).select("event_id", "pm", "source")
    tables.write_partitioned(rows.where("source <> 'PA'"), path, "source")
    tables.write_partitioned(rows.where("source <> 'EPA'"), path, "source")


@register(
    "partitioned_sink",
    with_tables(
        "readings",
        """SELECT event_id, pm, source FROM readings WHERE source <> 'PA'
           UNION ALL SELECT event_id, pm, source FROM readings WHERE source <> 'EPA'""",
    ),
)
def partitioned_sink(spark, d):
    """Two writes: the second appends to a key that exists and creates another."""
    path = new_path(spark, "partitioned")
    _by_source(spark, d, path)
    return spark.read.parquet(path)


@register(
    "partition_scan",
    with_tables("readings", "SELECT event_id, pm, source FROM readings WHERE source = 'EPA'"),
)
def partition_scan(spark, d):
    path = new_path(spark, "partition")
    _by_source(spark, d, path)
    return tables.read_partition(spark, path, "source", "EPA")
