from __future__ import annotations

import datetime as dt
import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stationflow.config import PUBLISHED_KEYS, ForecastConfig
from stationflow.operators import extract, serving
from stationflow.plans import catalog
from stationflow.session import materialise, run_folder, shared_dir
from stationflow.sources import lines, readers, sinks, typed, versions

HEADER = "Datum;UurgroepOmschrijving (van vertrek);VertrekHalteCode;VertrekHalteNaam;AantalReizen\n"


def put(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = text.encode("utf-8")
    path.write_bytes(gzip.compress(data) if zipped else data)


def test_trip_csv_prefix_and_empty_files(spark, tmp_path):
    day = tmp_path / "2021" / "01" / "05"
    put(day / "Origin_a.csv", HEADER + "2021-01-05;08:00 - 08:59;S1;Zuid;12\n")
    put(day / "Origin_empty.csv", "")
    put(day / "Destination_a.csv", HEADER + "2021-01-05;08:00 - 08:59;S1;Zuid;99\n")
    out = readers.scan_trips_csv(spark, str(tmp_path), "Origin", "in").collect()
    assert [r["AantalReizen"] for r in out] == ["12"]


def test_trip_csv_takes_columns_by_name(spark, tmp_path):
    put(tmp_path / "2021" / "01" / "05" / "x.csv", "Datum;AantalReizen;Extra;VertrekHalteCode;VertrekHalteNaam;"
        "UurgroepOmschrijving (van vertrek)\n2021-01-05;12;?;S1;Zuid;08:00 - 08:59\n")
    row = readers.scan_trips_csv(spark, str(tmp_path), "", "in").first()
    assert (row["AantalReizen"], row["VertrekHalteCode"], row["VertrekHalteNaam"]) == ("12", "S1", "Zuid")
    put(tmp_path / "2021" / "01" / "06" / "x.csv", HEADER + "2021-01-06;08:00 - 08:59;S1;Zuid;12\n")
    with pytest.raises(Exception, match="(?i)header|FAILED_READ_FILE"):  # two headers under one path
        readers.scan_trips_csv(spark, str(tmp_path), "", "in").collect()
    with pytest.raises(ValueError, match="not in the header"):
        readers.scan_trips_csv(spark, str(tmp_path), "", "out")


def test_trip_csv_of_a_span_of_dates(spark, tmp_path):
    for d in ("2020/12/31", "2021/01/01", "2021/01/02", "2021/02/01"):
        put(tmp_path / d / "x.csv", HEADER + f"{d.replace('/', '-')};08:00 - 08:59;S1;Zuid;12\n")
    out = readers.scan_trips_csv(spark, str(tmp_path), "", "in", dt.date(2020, 12, 31), dt.date(2021, 1, 1))
    assert sorted(r["Datum"] for r in out.collect()) == ["2020-12-31", "2021-01-01"]
    assert readers.day_folders("r", dt.date(2019, 12, 31), dt.date(2021, 2, 2)) == [
        "r/2019/12/31", "r/2020/*/*", "r/2021/01/*", "r/2021/02/01", "r/2021/02/02"]


def test_trip_union_of_csv_and_zipped_json(spark, tmp_path):
    put(tmp_path / "csv" / "2021" / "01" / "05" / "a.csv", HEADER + "2021-01-05;08:00 - 08:59;S1;Zuid;12\n")
    record = {"VertrekHalteNaam": "Noord", "Datum": "2021-01-06", "AantalReizen": 7,
              "UurgroepOmschrijving (van vertrek)": "09:00 - 09:59"}
    put(tmp_path / "json" / "2021" / "01" / "06" / "a.json.gz", json.dumps(record) + "\n", zipped=True)
    out = readers.scan_trips_union(spark, str(tmp_path / "csv"), str(tmp_path / "json"), "", "in")
    assert {(r["VertrekHalteNaam"], r["AantalReizen"], r["VertrekHalteCode"]) for r in out.collect()} == {
        ("Zuid", "12", "S1"), ("Noord", "7", None)}


def test_weather_is_unzipped_whatever_the_extension(spark, tmp_path):
    def line(h):
        return json.dumps({"date": "2021-01-01T00:00:00.000Z", "hour": h, "station_code": 240, "T": 10 * h}) + "\n"

    put(tmp_path / "2021" / "a.json.gz", line(1) + line(2), zipped=True)
    put(tmp_path / "2021" / "b.json", line(3), zipped=True)
    put(tmp_path / "2021" / "c", line(4) + "\n", zipped=True)
    put(tmp_path / "2021" / "empty", "")
    schema = "date string, hour int, station_code string, T double"
    assert {r["hour"] for r in readers.scan_weather(spark, str(tmp_path), schema).collect()} == {1, 2}
    both = readers.scan_weather(spark, str(tmp_path), schema, any_extension=True).collect()
    named = readers.scan_weather(spark, str(tmp_path), schema, True, with_revision=True).collect()
    assert {r["revision"].rsplit("/", 1)[1] for r in named} == {"a.json.gz", "b.json", "c"}
    assert {(r["hour"], r["T"], r["station_code"]) for r in both} == {(h, 10.0 * h, "240") for h in (1, 2, 3, 4)}


def test_posts_take_the_account_from_the_file_name(spark, tmp_path):
    def post(text, likes=3):
        edges = [] if text is None else [{"node": {"text": text}}]
        return {"edge_media_preview_like": {"count": likes}, "edge_media_to_comment": {"count": 1},
                "taken_at_timestamp": 1640995199, "edge_media_to_caption": {"edges": edges}, "other": 1}

    put(tmp_path / "nothing.json", json.dumps({"GraphImages": [post(None)]}))
    put(tmp_path / "paradisoadam.json", json.dumps({"GraphImages": [post("05 maart 20:30"), post("no date"), post(None)]}, indent=1))
    out = extract.posts_to_events(readers.scan_posts(spark, str(tmp_path)), "Europe/Amsterdam").collect()
    # An account without events does not stop the others. 23:59:59 UTC is next year in Amsterdam.
    assert [(r["venue"], r["likes"], r["event_date"]) for r in out] == [
        ("paradisoadam", 3, dt.datetime(2022, 3, 5, 20, 30))]
    assert out[0]["date_uploaded"] == dt.datetime(2022, 1, 1, 0, 59, 59)


def test_ticket_pages(spark, tmp_path):
    def event(name, venues):
        return {"name": name, "dates": {"start": {"dateTime": "2022-02-03T19:00:00Z"}}, "_embedded": {"venues": venues}}

    def venue(name, street):
        return {"name": name, "address": {"line1": street}}

    page = {"page": {"totalPages": 1}, "_embedded": {"events": [
        event("a", [venue("X", "Lijnbaansgracht 238")]), event("b", [venue("X", "Lijnbaansgracht 234 A")]),
        event("c", [venue("X", "Elsewhere 1"), venue("Y", "Lijnbaansgracht 238")]), event("d", [])]}}
    put(tmp_path / "p0.json", json.dumps(page))
    put(tmp_path / "p1.json", json.dumps(page))
    out = extract.ticket_pages_to_events(readers.scan_ticket_pages(spark, str(tmp_path)))
    assert sorted((r["name"], r["venue"]) for r in out.collect()) == [("a", "Lovelee"), ("b", "Melkweg"), ("c", "X")]


def test_event_files(spark, tmp_path):
    put(tmp_path / "s" / "b.csv", ",venue,likes,comments,date_uploaded,caption,event_date\n"
        '0,paradisoadam,1,2,2022-01-01,"two\nlines, ""quoted""",2022-03-05 20:30:00\n')
    put(tmp_path / "s" / "c.csv", "ord,event_date,venue\n0,2022-03-06 20:30:00,afaslive\n")
    put(tmp_path / "s" / "a.csv", "")
    r = readers.scan_social_events(spark, str(tmp_path / "s")).orderBy("ord").collect()
    assert [tuple(x)[1:] for x in r] == [("paradisoadam", "2022-03-05 20:30:00"), ("afaslive", "2022-03-06 20:30:00")]
    assert r[0]["ord"] < r[1]["ord"]  # the index starts anew in each file, the files' order goes first
    put(tmp_path / "t" / "x.csv", ',name,venue,datetime\n0,"Joker, live",Carre,2022-02-03T19:00:00Z\n1,B,Arena,\n')
    found = readers.scan_ticketed_events(spark, str(tmp_path / "t")).orderBy("ord").collect()
    assert [tuple(x) for x in found] == [(0, "Joker, live", "Carre", "2022-02-03T19:00:00Z"), (1, "B", "Arena", None)]


def test_wide_case_and_measure_files(spark, tmp_path):
    put(tmp_path / "c" / "x.csv", "dateRep,day,month,year,cases,deaths,countries,geoId,code,pop,continent\n"
        "05/03/2020,5,3,2020,12,1,Netherlands,NL,NLD,17,Europe\n06/03/2020,6,3,2020,x,,Netherlands,NL,NLD,17,Europe\n")
    r = sorted(readers.scan_cases(spark, str(tmp_path / "c")).collect())
    assert [tuple(x) for x in r] == [("05/03/2020", "NL", 12.0, 1.0), ("06/03/2020", "NL", None, None)]
    put(tmp_path / "m" / "x.csv", "date_end,Country,Response_measure,note,date_start\nNA,Netherlands,Masks,a,2020-03-01\n")
    assert tuple(readers.scan_measures(spark, str(tmp_path / "m")).first()) == (
        "Netherlands", "Masks", dt.date(2020, 3, 1), None)


# --- sinks -----------------------------------------------------------------------------------

CFG = ForecastConfig()


def metric(spark, r2):
    return spark.createDataFrame([("Zuid", 5, r2, 1.0, 2.0)], "station string, n bigint, r2 double, mae double, rmse double")


def test_model_log_keeps_the_old_row(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.save_model_log(serving.model_log_rows(metric(spark, 0.81249), CFG, ["global_radiation"]), path, dt.datetime(2022, 1, 1))
    sinks.save_model_log(serving.model_log_rows(metric(spark, 0.5), CFG, ["global_radiation"]), path, dt.datetime(2022, 1, 2))
    sinks.save_model_log(serving.model_log_rows(metric(spark, 0.4), CFG.with_(use_cases=False), []), path, dt.datetime(2022, 1, 3))
    log = sinks.read_model_log(spark, path)
    assert sorted(r["R-squared"] for r in log.collect()) == [0.4, 0.812]
    assert set(PUBLISHED_KEYS) <= set(log.columns)
    sinks.save_model_log(serving.model_log_rows(metric(spark, 0.6), CFG, ["global_radiation"]), path, dt.datetime(2022, 1, 4), "latest")
    assert sorted(r["R-squared"] for r in sinks.read_model_log(spark, path).collect()) == [0.4, 0.6]
    assert len(log.collect()) == 2  # the version that was read before is still there
    assert versions.current_version(spark, path) == 4


def test_log_before_the_first_run_is_empty(spark, tmp_path):
    log = sinks.read_model_log(spark, str(tmp_path / "none"))
    assert log.count() == 0 and "R-squared" in log.columns


def test_tables_are_replaced_whole(spark, tmp_path):
    path, schema = str(tmp_path / "t"), spark.range(1).schema
    assert versions.read_table(spark, path, schema).count() == 0
    for n in range(3):
        versions.replace_table(versions.read_table(spark, path, schema).union(spark.range(n, n + 1)), path, n)
    assert sorted(r["id"] for r in versions.read_table(spark, path, schema).collect()) == [0, 1, 2]
    # A run that read an older version does not undo the later ones.
    with pytest.raises(RuntimeError, match="another run"):
        versions.replace_table(spark.range(9, 10), path, 2)
    # A marker being written, and data without a marker, are not seen.
    (tmp_path / "t" / "0000000004.version").write_text("data-half")
    spark.range(5).write.parquet(str(tmp_path / "t" / "data-lost"))
    assert versions.read_table(spark, path, schema).count() == 3
    folders = [f.name for f in (tmp_path / "t").iterdir() if f.name.startswith("data-") and f.name != "data-lost"]
    assert len(folders) == 2


def test_model_log_operator_latest(spark):
    old = serving.model_log_rows(metric(spark, 0.9), CFG, [])
    new = serving.model_log_rows(metric(spark, 0.1), CFG, [])
    assert [r["R-squared"] for r in serving.model_log(old, new).collect()] == [0.9]
    assert [r["R-squared"] for r in serving.model_log(old, new, "latest").collect()] == [0.1]
    assert serving.model_log(None, new).count() == 1


def test_config_round_trip(spark, tmp_path):
    path = str(tmp_path / "config")
    cfg = CFG.with_(include_social_events=False, hours_before=5)
    sinks.save_config(spark, cfg, path)
    document = sinks.read_config(spark, path)
    assert ForecastConfig.from_mapping(json.loads(document.first()["document"])) == cfg
    assert serving.config_flags(document).first()["enabled"] == [
        "useNormalizedVisitors:true", "useEventStationDistance:true", "includeTicketmasterEvents:true", "useTimeOfEvents:true"]


def test_config_from_published_names():
    cfg = ForecastConfig.from_mapping({"UseCOVIDCases": "no", "MaxMinutesAfterEvent": "15"})
    assert (cfg.use_cases, cfg.minutes_after) == (False, 15)
    with pytest.raises(ValueError, match="unknown settings"):
        ForecastConfig.from_mapping({"Nope": 1})
    assert "cases" not in cfg.model_features() and "deaths" in cfg.model_features()


def test_forecasts_are_saved_by_station_and_served_from_the_newest_run(spark, tmp_path):
    path = str(tmp_path / "forecasts")

    def run(station, ins):
        return spark.createDataFrame([(station, dt.date(2022, 1, 5), 8, ins, 4000.0)],
                                     "station string, date date, hour int, check_ins_predicted double, check_outs_predicted double")

    sinks.save_forecasts(run("Centraal Station", 1.0).union(run("Station Zuid", 2000.0)), path, dt.datetime(2022, 1, 1, 6))
    sinks.save_forecasts(run("Centraal Station", 5000.0), path, dt.datetime(2022, 1, 2, 6))
    out = serving.forecast_serving(spark.read.parquet(path), dt.date(2022, 1, 5))
    assert {(r["station"], r["total"], r["crowded"]) for r in out.collect()} == {
        ("Centraal Station", 9000.0, 1), ("Station Zuid", 6000.0, 1)}
    assert serving.forecast_serving(spark.read.parquet(path), dt.date(2022, 1, 5), station="Station Zuid").count() == 1


def test_published_files_are_sorted_and_replaced(spark, tmp_path):
    path, day = str(tmp_path / "csv"), dt.date(2022, 1, 5)

    def run(n):
        rows = [(s, day + dt.timedelta(h // 24), h % 24, float(h + n), 1.0) for h in range(47, -1, -1) for s in ("Zuid", "A & B/C")]
        return spark.createDataFrame(rows, "station string, date date, hour int, check_ins_predicted double, "
                                           "check_outs_predicted double").repartition(5)

    for n in (0, 100):
        sinks.publish_forecasts(run(n), path, day)
    sinks.publish_forecasts(run(7).where("station = 'Zuid'"), path, day + dt.timedelta(1))
    got = sinks.read_published(spark, path, day).collect()
    assert len(got) == 96 and {r["station"] for r in got} == {"Zuid", "A & B/C"}
    assert {"datetime", "check-ins_predicted", "check-outs_predicted"} <= set(got[0].asDict())
    files = sorted(f.name for f in (tmp_path / "csv" / "station=Zuid").iterdir() if f.name.endswith(".csv"))
    assert files == ["prediction_next_week_Jan-05-2022.csv", "prediction_next_week_Jan-06-2022.csv"]
    lines = (tmp_path / "csv" / "station=Zuid" / files[0]).read_text().splitlines()
    assert [float(x.split(",")[2]) for x in lines[1:]] == [100.0 + h for h in range(48)]
    assert not [f for f in (tmp_path / "csv").iterdir() if f.name.startswith(".writing")]


def test_collected_events_come_once(spark, tmp_path):
    path = str(tmp_path / "e")

    def page(*rows):
        return spark.createDataFrame(rows, "source string, name string, venue string")

    schema = page(("", "", "")).schema
    assert sinks.read_events(spark, path, schema).count() == 0
    first = page(("p0", "a", "X"), ("p0", "a", "X"), ("p1", "b", "Y"))
    for hour in (1, 2):
        sinks.append_events(first, path, dt.datetime(2022, 1, 1, hour))
    sinks.append_events(first.union(page(("p2", "c", "Z"))), path, dt.datetime(2022, 1, 1, 3))
    # A run that wrote its events but ended before the ledger; then the page comes again.
    page(("p3", "d", "Z")).withColumn("batch", F.lit("20220101T040000-x")).write.mode("append").partitionBy("batch").parquet(f"{path}/events")
    sinks.append_events(page(("p3", "d", "Z")), path, dt.datetime(2022, 1, 1, 5))
    got = sorted(tuple(r) for r in sinks.read_events(spark, path, schema).collect())
    assert got == [("p0", "a", "X"), ("p0", "a", "X"), ("p1", "b", "Y"), ("p2", "c", "Z"), ("p3", "d", "Z")]


# --- shared folder -----------------------------------------------------------------------------

def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialise(spark.range(5).selectExpr("id", "id % 2 AS k"), "t", ("k",))
    assert df.columns == ["id", "k"]
    assert all(shared_dir(spark) in f for f in df.inputFiles())


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_saving_a_run_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "again")
    rows = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "station string, hour int, check_ins_predicted double")
    sinks.save_forecasts(rows, path, dt.datetime(2022, 1, 1, 6))
    sinks.save_forecasts(rows, path, dt.datetime(2022, 1, 1, 6))
    sinks.save_forecasts(rows.where("station = 'A'"), path, dt.datetime(2022, 1, 2, 6))
    assert sinks.read_forecasts(spark, path, newest=False).count() == 3
    newest = {(r["station"], r["run_date"]) for r in sinks.read_forecasts(spark, path).collect()}
    assert newest == {("A", dt.date(2022, 1, 2)), ("B", dt.date(2022, 1, 1))}


def test_features_of_a_saved_forecast_with_measures():
    columns = ["year", "cases", "AdaptationOfWorkplace"]
    assert serving.active_features(columns) == ["year", "cases"]
    assert serving.active_features(columns, ["AdaptationOfWorkplace", "Other"]) == ["year", "cases", "measures"]


def test_tables_of_a_run_are_removed_at_its_end(spark):
    with run_folder(spark) as folder:
        assert materialise(spark.range(3), "t").count() == 3
        assert [f for f in spark.read.parquet(f"{folder}/t-*").inputFiles()]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/t-*")


# --- typed layer ---------------------------------------------------------------------------------

def test_typed_layer_reads_changed_days_only(spark, tmp_path):
    raw, layer = tmp_path / "raw", str(tmp_path / "typed")
    folders = [f"2021/{d}" for d in ("01/31", "02/01", "02/02")]

    def land(folder, n):
        day = folder.replace("/", "-")
        put(raw / folder / "Origin_a.csv", HEADER + "".join(f"{day};{h:02d}:00 - {h:02d}:59;S1;Zuid;{n + h}\n" for h in range(3)))
        put(raw / folder / "Destination_a.csv", "x\n")

    for f in folders:
        land(f, 10)
    assert typed.update_trips(spark, str(raw), layer, "Origin", "in") == folders
    assert typed.update_trips(spark, str(raw), layer, "Origin", "in") == []
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "typed").rglob("*.parquet")}
    land("2021/02/02", 50)
    land("2021/02/03", 70)
    assert typed.update_trips(spark, str(raw), layer, "Origin", "in") == ["2021/02/02", "2021/02/03"]
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "typed").rglob("*.parquet")}
    assert len([p for p in before if after.get(p) == before[p]]) == 2  # the other days' files
    rows = typed.read_trips(spark, layer)
    assert sorted((str(r["date"]), r["trips"]) for r in rows.collect()) == [
        (d, n + h) for d, n in (("2021-01-31", 10), ("2021-02-01", 10), ("2021-02-02", 50), ("2021-02-03", 70)) for h in range(3)]
    part = typed.read_trips(spark, layer, dt.date(2021, 2, 1), dt.date(2021, 2, 2))
    assert part.count() == 6
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(make_date" in plan
    assert len(part.where("trips > 0").inputFiles()) >= 2 and "make_date(year" in plan


# --- gzip streams ----------------------------------------------------------------------------------

def test_unzipping_in_pieces():
    text = b"".join(b"line %d\n" % i for i in range(300_000)) + b"z" * 9_000_000 + b"\nend"
    packed = gzip.compress(text[:1_000_000]) + gzip.compress(text[1_000_000:]) + b"\0" * 7
    for size in (1, 1000, 1 << 20):
        cut = packed if size > 1 else packed[:0] + gzip.compress(b"a\n\nb\r\nc")
        pieces = [cut[i:i + size] for i in range(0, len(cut), size)]
        content = b"".join(lines.unzipped(iter(pieces)))
        assert content == (text if size > 1 else b"a\n\nb\r\nc")
        found = [x for part in lines.lines(lines.unzipped(iter(pieces))) for x in part]
        assert found == [x.decode() for x in content.replace(b"\r", b"").split(b"\n") if x]
    with pytest.raises(EOFError):
        list(lines.unzipped(iter([packed[:100_000]])))
    assert list(lines.lines(lines.unzipped(iter([])))) == []


def test_many_event_files_are_one_scan(spark, tmp_path):
    for i in range(40):
        names = ["ord", "venue", "event_date", f"other{i}"][:: 1 if i % 2 else -1]
        row = {"ord": "0", "venue": f"v{i}", "event_date": "2022-03-06 20:30:00", f"other{i}": "x"}
        put(tmp_path / f"{i:02d}.csv", ",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n")
    out = readers.scan_social_events(spark, str(tmp_path))
    assert [tuple(r) for r in out.orderBy("ord").collect()] == [(i << 32, f"v{i}", "2022-03-06 20:30:00") for i in range(40)]
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2  # rows and headers
    put(tmp_path / "99.csv", "a,b\n1,2\n")
    with pytest.raises(Exception, match="no header with"):
        readers.scan_social_events(spark, str(tmp_path)).collect()


def test_many_documents_lie_in_one_folder(spark, sf_dir):
    """No folder a file: such folders cost a listing task each."""
    docs = spark.range(70).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("text "), "id").alias("document"))
    path = catalog._files(docs.unionByName(docs), "k", "one-folder")
    found = [f for f in Path(path).rglob("*.txt")]
    assert len(found) == 140 and {f.parent for f in found} == {Path(path)}
    assert sorted(f.read_text() for f in found) == sorted(2 * [f"text {i}\n" for i in range(70)])
