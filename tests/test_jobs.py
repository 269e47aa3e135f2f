"""Sources and jobs on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import joins as J
from hazegrid.plans import refresh, sites
from hazegrid.session import new_path, shared_folder
from hazegrid.sources import files, tables


def test_csv_with_quotes_bom_and_nan(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfname,v,addr\nx,1.5,"1 Main St, Rear"\ny,,plain\nz,NaN,q\n')
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "name string, v double, addr string").collect()
    assert [tuple(r) for r in rows] == [("x", 1.5, "1 Main St, Rear"), ("y", None, "plain"), ("z", None, "q")]


def test_csv_keeps_line_breaks(spark, tmp_path):
    rows = [(1, "a\nb"), (2, 'say "x",\r\nthen go'), (3, None), (4, "  blanks  "), (5, "\n\n"), (6, 'odd " quote')]
    tables.write_csv(spark.createDataFrame(rows, "id bigint, t string").coalesce(1), str(tmp_path / "out"))
    got = files.read_csv(spark, str(tmp_path / "out"), "id bigint, t string").collect()
    assert sorted(tuple(r) for r in got) == rows


def test_csv_files_of_a_folder(spark, tmp_path):
    """Odd names of files and columns; only the file with a broken text is read whole."""
    (tmp_path / "West Pullman.csv").write_text('id,note\n1,"two\nlines"\n2,"one, ""quoted"""\n')
    (tmp_path / "plain%41.csv").write_text("note,id\nx,3\n")
    (tmp_path / "wide.csv").write_text('id,"a\nb",,note,Note\n4,5,6,y,z\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bare.csv").write_text("id,note\n")
    (tmp_path / "other.txt").write_text("id,note\n9,no\n")
    groups = files.csv_headers(spark, str(tmp_path), pathGlobFilter="*.csv")
    spanning = {f.rsplit("/", 1)[1] for (_, spans), fs in groups.items() if spans for f in fs}
    assert spanning == {"West Pullman.csv", "wide.csv"}
    rows = files.read_csv_folder(spark, str(tmp_path), "id bigint, note string").select("id", "note").collect()
    assert {tuple(r) for r in rows} == {(1, "two\nlines"), (2, 'one, "quoted"'), (3, "x"), (4, None)}


def test_csv_folder_of_many_files_is_one_job(spark, tmp_path):
    for i in range(150):
        (tmp_path / f"{i}.csv").write_text(f"id,v\n{i},{i}.5\n" if i % 2 else f"v,id\n{i}.5,{i}\n")
    spark.sparkContext.setJobGroup("csv", "csv")
    df = files.read_csv_folder(spark, str(tmp_path), "id bigint, v double")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("csv")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Headers take one query (two stages of it are jobs of their own), listing the files one each.
    assert len(jobs) <= 6
    assert {tuple(r) for r in df.collect()} == {(i, i + 0.5) for i in range(150)}


def test_one_payload_is_read_by_several_tasks(spark, tmp_path):
    """However it is laid out; brackets inside texts and nested lists are no borders."""
    records = [{"code": f"c{i}", "note": 'a }, {"code" [x] "q" ' * (i % 3), "list": [{"k": i}, {"k": 2}], "n": i} for i in range(4000)]
    kind = "struct<code: string, note: string, list: array<struct<k: int>>, n: int>"
    want = sorted((r["code"], r["note"], r["n"], tuple(x["k"] for x in r["list"])) for r in records)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        for name, layout in (("tight", {"separators": (",", ":")}), ("plain", {}), ("deep", {"indent": 2})):
            path = tmp_path / f"{name}.json"
            path.write_text(json.dumps({"Header": [{"a": 1}], "Data": records, "More": {"x": [1]}}, **layout))
            df = files.read_json_records(spark, str(path), kind, split=True)
            assert df.rdd.getNumPartitions() > 4
            assert sorted((r["code"], r["note"], r["n"], tuple(x["k"] for x in r["list"])) for r in df.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    (tmp_path / "few").mkdir()
    for k, rows in enumerate(([], records[:1])):
        (tmp_path / f"few/{k}.json").write_text(json.dumps({"Data": rows}))
    assert [r["n"] for r in files.read_json_records(spark, str(tmp_path / "few"), kind, split=True).collect()] == [0]


def test_one_payload_is_written_without_a_sort(spark, tmp_path, monkeypatch):
    """The task that writes the file holds no records; ids may repeat, and a table may be empty."""
    from pyspark.sql import DataFrameWriter

    from hazegrid.catalog.io import json_records_split
    from hazegrid.catalog.tables import readings_of

    plans, text = [], DataFrameWriter.text

    def planned(self, path, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return text(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "text", planned)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for name, df, times in (("once", events, 1), ("twice", events.union(events), 2), ("none", events.limit(0), 0)):
        df.write.parquet(str(tmp_path / name / "events.parquet"))
        got = json_records_split(spark, str(tmp_path / name)).collect()
        assert len(got) == events.count() * times
        want = readings_of(df).select("event_id", "pm", "source").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert len(plans) == 3 and not any("Sort" in p for p in plans)


def test_a_payload_that_cannot_be_split_is_refused(spark, tmp_path):
    records = [{"k": 1, "list": [{"k": 2}, {"k": 3}], "n": i} for i in range(5)]
    (tmp_path / "a.json").write_text(json.dumps({"Data": records}))
    kind = "struct<k: int, n: int>"
    with pytest.raises(Exception, match="not a whole record"):
        files.read_json_records(spark, str(tmp_path / "a.json"), kind, split=True).collect()
    assert files.read_json_records(spark, str(tmp_path / "a.json"), kind, multi_line=True).count() == 5


def test_one_feature_collection_is_split(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"id": str(i)}, "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i, 1], [i, 0]]]}}
        for i in range(50)
    ]
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "name": "x", "features": features}))
    one, two = (files.read_geojson(spark, str(tmp_path / "g.geojson"), ["id"], **how).collect() for how in ({"split": True}, {"multi_line": True}))
    assert sorted(one) == sorted(two) and len(one) == 50


def test_csv_columns_go_by_their_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,lng,lat\n1,-87.5,41.5\n2,NaN,41.6\n")
    (tmp_path / "b.csv").write_text("lat,note,id\n41.7,hi,3\n")
    (tmp_path / "c.txt").write_text("id\n9\n")
    rows = files.read_csv_folder(spark, str(tmp_path), "id bigint, lat double, lng double").collect()
    got = sorted((r["id"], r["lat"], r["lng"], r["note"]) for r in rows)
    assert got == [(1, 41.5, -87.5, None), (2, 41.6, None, None), (3, 41.7, None, "hi")]
    one = files.read_csv(spark, str(tmp_path / "a.csv"), "id bigint, lat double, lng double")
    assert one.columns == ["id", "lat", "lng"] and sorted(one.collect())[0]["lng"] == -87.5


def test_feed_fields_follow_the_header(spark, tmp_path):
    (tmp_path / "f.json").write_text(
        '{"channel": {"id": 5, "name": "N", "field1": "PM2.5", "field2": "Hum"},'
        ' "site": {"ID": 9}, "feeds": [{"created_at": "t1", "field1": "1", "field2": "2"},'
        ' {"created_at": "t2", "field1": null}]}'
    )
    df = files.read_feeds(spark, str(tmp_path / "f.json"), ["PM2.5", "Hum", "Absent"], ["ID"], ["id"], True)
    assert [tuple(r) for r in df.collect()] == [("t1", "1", "2", None, "5", "9"), ("t2", None, None, None, "5", "9")]


def test_json_records_multi_line(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"Header": [],\n "Data": [{"code": "1"},\n {"code": "2"}]}')
    df = files.read_json_records(spark, str(tmp_path / "r.json"), "struct<code: string>", multi_line=True)
    assert [r["code"] for r in df.collect()] == ["1", "2"]


def test_geojson_kinds(spark, tmp_path):
    (tmp_path / "g.json").write_text(
        '{"features": [{"properties": {"n": "a"}, "geometry": {"type": "Polygon", "coordinates":'
        ' [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"properties": {"n": "b"}, "geometry": {"type":'
        ' "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}'
    )
    got = {r["n"]: r for r in files.read_geojson(spark, str(tmp_path / "g.json"), ["n"], True).collect()}
    assert len(got["a"]["rings"]) == 1 and len(got["b"]["rings"]) == 2 and got["b"]["bbox"]["xmax"] == 6.0


def test_partition_is_pruned(spark):
    path = new_path(spark, "test-partition")
    df = spark.range(100).withColumn("k", F.concat(F.lit("k"), (F.col("id") % 3).cast("string")))
    tables.write_partitioned(df, path, "k")
    one = tables.read_partition(spark, path, "k", "k1")
    assert one.count() == 33
    assert "PartitionFilters: [isnotnull(k" in one._jdf.queryExecution().toString()


def test_shared_folder_comes_from_the_session(spark):
    assert new_path(spark, "x").startswith(shared_folder(spark))
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_refresh_reloads_the_last_day(spark):
    def table(rows):
        return spark.createDataFrame(rows, "Daily date, n int")

    d = [dt.date(2020, 1, i) for i in range(1, 9)]
    source = table([(d[i], 10 + i) for i in range(8)])

    def load(start, end):
        return {"t": source.where((F.col("Daily") >= F.lit(start)) & (F.col("Daily") < F.lit(end)))}

    current = {"t": (table([(d[0], 10), (d[1], 11), (d[2], 1)]), "Daily")}  # third day incomplete
    results = []
    for _ in range(2):
        done = refresh.incremental_refresh(spark, current, load, new_path(spark, "test-refresh"), d[6])
        results.append(sorted(tuple(r) for r in done["t"].collect()))
        current = {"t": (done["t"], "Daily")}
    assert results[0] == results[1] == [(d[i], 10 + i) for i in range(6)]


def test_an_early_end_changes_nothing(spark):
    """Ten days, an end before the watermark: run after run, and both ways, all days stay."""
    d = [dt.date(2020, 1, i) for i in range(1, 11)]
    source = spark.createDataFrame([(x, i) for i, x in enumerate(d)], "Daily date, n int")

    def load(start, end):
        return {"t": source.where((F.col("Daily") >= F.lit(start)) & (F.col("Daily") < F.lit(end)))}

    current = source
    path = new_path(spark, "test-early")
    tables.write_partitioned(source, path, "Daily")
    for _ in range(3):
        current = refresh.incremental_refresh(spark, {"t": (current, "Daily")}, load, new_path(spark, "test-early"), d[4])["t"]
        days = refresh.refresh_partitions(spark, {"t": path}, load, d[4])["t"]
        assert current.count() == days.count() == 10


def test_tables_of_unequal_age_and_an_empty_day(spark):
    """One table is ahead of the other; the reload has no rows for a day that both have."""
    d = [dt.date(2020, 1, i) for i in range(1, 11)]
    make = lambda days, n: spark.createDataFrame([(x, n) for x in days], "Daily date, n int")
    fresh = [x for x in d if x != d[5]]

    def load(start, end):
        return {k: make([x for x in fresh if start <= x < end], 2) for k in ("a", "b")}

    old = {"a": make(d[:6], 1), "b": make(d, 1)}
    paths = {k: new_path(spark, f"test-age-{k}") for k in old}
    for k, df in old.items():
        tables.write_partitioned(df, paths[k], "Daily")
    # The watermark is the sixth day, the end the ninth: days nine and ten stay as they are.
    want_a = {**{x: 1 for x in d[:5]}, d[6]: 2, d[7]: 2}
    want_b = {**want_a, d[8]: 1, d[9]: 1}
    out = refresh.incremental_refresh(spark, {k: (v, "Daily") for k, v in old.items()}, load, new_path(spark, "test-age"), d[8])
    in_place = refresh.refresh_partitions(spark, paths, load, d[8])
    for done in (out, in_place):
        for k, want in (("a", want_a), ("b", want_b)):
            assert {r["Daily"]: r["n"] for r in done[k].collect()} == want


def test_watermark_is_the_slowest_table(spark):
    a = spark.createDataFrame([(dt.date(2020, 5, 1),)], "Daily date")
    b = spark.sql("SELECT timestamp_ntz'2020-04-30 23:30:00' AS t")
    hoods = spark.sql("SELECT timestamp_ntz'2015-01-01 00:00:00' AS thirtymins")
    mark = lambda **k: refresh.refresh_watermark({"a": (a, "Daily"), "b": (b, "t")}, **k).first()[0]
    assert mark() == dt.date(2020, 4, 30)
    assert mark(neighborhoods=hoods) == dt.date(2016, 1, 1)


def test_station_with_several_site_rows_is_not_repeated(spark):
    rows = [(s, "St", 41.0, -87.0, 10.0, "1 HOUR", "E", "M", "88101", "2020-06-01", f"0{h}:00") for h in range(3) for s in (1, 2)]
    raw = spark.createDataFrame(
        rows,
        "site_number int, value_represented string, latitude double, longitude double, sample_measurement double,"
        " sample_duration string, sample_frequency string, method_type string, parameter_code string,"
        " date_local string, time_local string",
    )
    readings, profile = sites.process_epa(raw)
    assert profile.count() == 2
    day = sites.epa_daily(readings).first()
    assert (day["count"], day["sum"], day["not_harmful"], day["harmful"]) == (6, 60.0, 1.0, 0.0)


def test_combine_prefixes(spark):
    def t(rows, more=""):
        return spark.createDataFrame(rows, f"Daily date, sum double, count int{more}")

    a, b = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
    out = J.combine_sources(t([(a, 1.0, 2, 7), (b, 3.0, 4, 8)], ", hex_ct int"), t([(a, 5.0, 6)]), t([(b, 7.0, 8)]))
    got = {r["Daily"]: r for r in out.collect()}
    assert got[a]["EPA_sum"] == 5.0 and got[a]["PA_sum"] is None and got[b]["hex_ct"] == 8
    assert got[b]["AQ_sum"] == 3.0 and got[b]["PA_count"] == 8


def test_append_refuses_another_checkpoint_and_keeps_late_rows(spark):
    import pytest

    from hazegrid.streaming import refresh as R

    schema = "k int, time timestamp_ntz"
    inbox, path, state = (new_path(spark, f"test-append-{n}") for n in "abc")
    at = lambda h: dt.datetime(2024, 1, 1, h)

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(inbox)
        stream = R.read_folder_stream(spark, inbox, spark.createDataFrame([], schema).schema)
        return R.append_once(stream, ["k"], path, state)

    arrive((1, at(1)), (2, at(10)), (1, at(1)))
    out = arrive((3, at(2)), (4, at(9)), (2, at(10)), (1, at(1)), (5, None))
    arrive((3, at(2)), (4, at(9)))
    assert sorted(r.k for r in out.collect()) == [1, 2, 4, 5]
    late = R.late_rows(spark, path, out.schema)
    assert [r.k for r in late.collect()] == [3]
    with pytest.raises(ValueError):
        stream = R.read_folder_stream(spark, inbox, out.schema)
        R.append_once(stream, ["k"], path, new_path(spark, "test-append-new"))


def test_a_refresh_makes_its_load_once(spark, tmp_path):
    """The rows of the window are computed for the write only, not to find the days that lose theirs."""
    import datetime as dt

    from hazegrid.plans import refresh
    from hazegrid.sources import tables

    days = lambda *ds: spark.createDataFrame([(dt.date(2024, 1, d), d) for d in ds], "Daily date, n int")
    tables.write_partitioned(days(1, 2, 3), str(tmp_path / "t"), "Daily")
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    fresh = days(3, 4).coalesce(1).mapInArrow(counted, "Daily date, n int")
    done = refresh.refresh_partitions(spark, {"t": str(tmp_path / "t")}, lambda s, e: {"t": fresh}, dt.date(2024, 1, 9))
    assert sorted(r["n"] for r in done["t"].collect()) == [1, 2, 3, 4]
    assert made.value == 2
