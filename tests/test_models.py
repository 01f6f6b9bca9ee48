from __future__ import annotations

import datetime as dt
import gzip
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from stationflow.config import ForecastConfig
from stationflow.operators import features, forests, serving, splits
from stationflow.plans import forecast
from stationflow.sources import readers, sinks

CFG = ForecastConfig(stations=("A", "B"), num_trees=8, max_depth=6, max_bins=64, use_stringency=False,
                     station_points=(("A", 52.31, 4.94), ("B", 52.36, 4.88)))
DAYS = [dt.date(2021, 3, 1) + dt.timedelta(i) for i in range(42)]


def level(station, hour, weekday):
    base = {"A": 900, "B": 300}[station]
    return base * (1.2 + math.sin(2 * math.pi * hour / 24)) * (0.5 if weekday >= 5 else 1.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for s in "AB":
        for d in DAYS:
            for h in range(24):
                x = level(s, h, d.weekday())
                ins, outs = round(x + rng.random() * 20), round(0.8 * x + rng.random() * 20)
                gap = rng.random()
                data.append((s, d, h, None if gap < 0.05 else ins, None if gap > 0.95 or gap < 0.005 else outs,
                             d.year, d.month, d.weekday(), 0))
    return spark.createDataFrame(data, "station string, date date, hour int, check_ins bigint, check_outs bigint, "
                                       "year int, month int, weekday int, holiday int").repartition(1).sortWithinPartitions(
        "station", "date", "hour").cache()


def test_imputation_fills_one_sided_gaps_only(spark, rows):
    out = forests.impute(rows, CFG)
    assert out.count() == rows.count()
    keys = ["station", "date", "hour"]
    both = rows.select(*keys, F.col("check_ins").alias("a"), F.col("check_outs").alias("b")).join(out, keys)
    assert both.where("a IS NOT NULL AND a <> check_ins OR b IS NOT NULL AND b <> check_outs").count() == 0
    assert both.where("(check_ins IS NULL) <> (a IS NULL AND b IS NULL)").count() == 0
    assert both.where("(check_outs IS NULL) <> (a IS NULL AND b IS NULL)").count() == 0
    assert both.where("a IS NULL AND b IS NULL").count() > 0
    # Filled values follow the other direction.
    filled = both.where("a IS NULL AND b IS NOT NULL").select(F.avg(F.abs(F.col("check_ins") / (F.col("b") / 0.8) - 1))).first()[0]
    assert filled < 0.15


def test_forest_beats_the_mean_and_is_repeatable(spark, rows):
    chosen = ["hour", "weekday"]
    labelled = splits.split_labels(rows).cache()
    train, test = labelled.where("split <> 'test'"), labelled.where("split = 'test'")

    def scores():
        models = forests.train(train, chosen, CFG)
        assert models.models == ("A", "B") and models.trees.count() == 16
        out = splits.forecast_metrics(forests.predict(models, test, chosen))
        return {r["station"]: (r["n"], r["r2"], r["mae"], r["rmse"]) for r in out.collect()}

    first, second = scores(), scores()
    assert all(v[1] > 0.9 for v in first.values())
    assert first == {k: pytest.approx(v) for k, v in second.items()}


def test_rows_without_a_feature_are_left_out_and_counted(spark, rows):
    models = forests.train(rows, ["hour"], CFG)
    future = spark.createDataFrame([("A", 5), ("A", None), ("B", 3)], "station string, hour int")
    assert forests.predict(models, future, ["hour"]).count() == 2
    left_out = future.agg(*[c.alias(s) for s, c in forests.incomplete(["hour"], ["A", "B"]).items()]).first()
    assert left_out.asDict() == {"A": 1, "B": 0}


def test_station_without_rows_gets_no_model(spark, rows):
    models = forests.train(rows.where("station = 'A'"), ["hour"], CFG)
    assert models.models == ("A",)
    none = forests.train(rows.where("station = 'C'"), ["hour"], CFG)
    with pytest.raises(ValueError, match="no station"):
        forests.predict(none, rows, ["hour"])


# --- the whole run from landed files -------------------------------------------------------------

def _write(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())


def _land(root):
    rng = random.Random(5)
    heads = {"in": "Datum;UurgroepOmschrijving (van vertrek);VertrekHalteCode;VertrekHalteNaam;AantalReizen",
             "out": "Datum;UurgroepOmschrijving (van aankomst);AankomstHalteCode;AankomstHalteNaam;AantalReizen"}
    for d in DAYS[:-1]:
        for side, prefix in (("in", "Origin"), ("out", "Destination")):
            lines = [heads[side]]
            for s in "AB":
                for h in range(24):
                    if rng.random() < 0.03:
                        continue
                    n = round(level(s, h, d.weekday()) * (1.0 if side == "in" else 0.8) + rng.random() * 20)
                    lines += [f"{d};{h:02d}:00 - {h:02d}:59;{s}1;{s};{n - 10}", f"{d};{h:02d}:00 - {h:02d}:59;{s}2;{s};10"]
            _write(root / "trips" / f"{d:%Y}" / f"{d:%m}" / f"{d:%d}" / f"{prefix}.csv", "\n".join(lines) + "\n")
    last = DAYS[-1]
    for side, folder in (("in", "trips-origin-json"), ("out", "trips-destination-json")):
        names = heads[side].split(";")
        lines = [json.dumps(dict(zip(names, (str(last), f"{h:02d}:00 - {h:02d}:59", f"{s}1", s, round(level(s, h, last.weekday())))))) for s in "AB" for h in range(24)]
        _write(root / folder / f"{last:%Y}" / f"{last:%m}" / f"{last:%d}" / "a.json.gz", "\n".join(lines) + "\n", True)
    codes = "DD FH FF FX T T10N TD SQ Q DR RH P VV N U WW IX M R S O Y".split()
    for d in DAYS:
        lines = [json.dumps({"date": f"{d}T00:00:00.000Z", "hour": h, "station_code": 240, **{c: 10 + h for c in codes}}) for h in range(1, 25)]
        name = f"{d}.json.gz" if d.day % 2 else f"{d}"
        _write(root / "weather" / "observations" / name, "\n".join(lines) + "\n", True)
    start = int(dt.datetime(2021, 4, 11, 12, tzinfo=dt.timezone.utc).timestamp())
    lines = [json.dumps({"tijd": start + 3600 * i, "offset": "2", "loc": "x", **{c: "5" for c in "windr rv luchtd temp windb winds gust vis neersl gr tw".split()}}) for i in range(0, 200, 4)]
    _write(root / "weather" / "predictions" / "p.json.gz", "\n".join(lines) + "\n", True)
    _write(root / "events" / "sheet" / "s.csv", "ord,Datum,Locatie,Naam evenement,Start show,Einde show,Aantal bezoekers\n"
           "1,2021-03-06,Arena,Match,20:00:00,22:00:00,50000\n2,2021-04-14,Ziggo dome,Show,20:00:00,22:00:00,17000\n")
    _write(root / "events" / "social" / "s.csv", "ord,venue,likes,comments,date_uploaded,caption,event_date\n1,paradisoadam,1,1,x,y,2021-03-20 20:00:00\n")
    _write(root / "events" / "ticketed" / "t.csv", "ord,name,venue,datetime\n1,Play,Melkweg,2021-03-21T19:00:00Z\n")
    _write(root / "measures" / "m.csv", "Country,Response_measure,date_start,date_end\nNetherlands,Masks,2021-03-10,2021-03-20\nNetherlands,Curfew,2021-04-01,NA\n")
    _write(root / "cases" / "c.csv", "dateRep,geoId,cases,deaths\n" + "".join(f"{d:%d/%m/%Y},NL,{i}.0,1.0\n" for i, d in enumerate(DAYS)))
    _write(root / "stringency" / "s.json", json.dumps({str(d): {"NLD": {"date_value": str(d), "stringency": 70.0}} for d in DAYS}, indent=1))
    _write(root / "school-years" / "y.json", json.dumps({"content": [{"schoolyear": "2020-2021", "vacations": [
        {"type": "Mei", "regions": [{"region": "noord", "startdate": "2021-03-30T22:00:00.000Z", "enddate": "2021-04-04T22:00:00.000Z"}]}]}]}))


def test_low_scores_are_warned_about(spark, rows):
    noise = rows.dropna().withColumns({
        "check_ins": (F.rand(1) * 100).cast("bigint"), "check_outs": (F.rand(2) * 100).cast("bigint")})
    with pytest.warns(UserWarning, match="unexpected performance"):
        forecast.train_and_score(noise, ["hour"], CFG.with_(num_trees=2, max_depth=3))


def test_run_needs_features(spark):
    with pytest.raises(ValueError, match="at least one feature"):
        forecast.run_forecast(None, CFG.with_(features=()), dt.datetime(2021, 1, 1), {}, "x")


def test_switches_take_sources_out_of_the_tables(spark, tmp_path):
    _land(tmp_path)
    cfg = CFG.with_(use_measures=False, use_cases=False, use_event_time=False, use_attendance=False,
                    include_social_events=False, include_ticketed_events=False, features=("temperature",))
    as_of = dt.datetime(2021, 4, 12)
    src = readers.read_sources(spark, str(tmp_path), "Origin", "Destination")
    prepared = forecast.prepare(src, cfg, as_of.date(), {})
    assert {"stringency", "cases"}.isdisjoint(prepared.rows.columns) and "deaths" in prepared.rows.columns
    # Without times an event counts for its whole day, and only its presence counts.
    scores = {r["date"]: r["n"] for r in prepared.rows.where("planned_event > 0 AND station = 'A'").groupBy("date").agg(
        F.countDistinct("planned_event").alias("n")).collect()}
    assert scores == {dt.date(2021, 3, 6): 1}
    future = features.future_features(prepared.rows, prepared.future_dims, cfg, as_of, cfg.model_features())
    assert set(future.columns) == {"station", "date", "hour", "temperature", "deaths", "planned_event"}
    assert future.count() == 336 and future.where("planned_event > 0").count() == 48
    # With measures switched on but none chosen nothing is joined.
    assert forecast.prepare(src, cfg.with_(use_measures=True), as_of.date(), {}).rows.columns == prepared.rows.columns


def test_run_from_files_to_forecast(spark, tmp_path):
    _land(tmp_path)
    cfg = CFG.with_(use_stringency=True, features=(
        "year", "month", "weekday", "holiday", "vacation", "temperature", "check_ins_week_ago", "check_outs_week_ago"))
    measures = {"Masks": "masks", "Curfew": "curfew"}
    model_features = cfg.model_features(tuple(measures.values()))
    as_of = dt.datetime(2021, 4, 12)
    src = readers.read_sources(spark, str(tmp_path), "Origin", "Destination")
    prepared = forecast.prepare(src, cfg, as_of.date(), measures)
    assert prepared.rows.groupBy("station", "date", "hour").count().where("count > 1").count() == 0
    r = prepared.rows.agg(*[F.sum(c).alias(c) for c in ("holiday", "vacation", "masks", "curfew", "planned_event", "cases")]).first()
    assert all(v > 0 for v in r)
    rows = forecast.clean(prepared.rows, cfg)
    assert rows.where("check_ins IS NULL OR check_outs IS NULL").count() == 0
    trained = forecast.train_and_score(rows, model_features, cfg)
    assert all(m["r2"] > 0.7 for m in trained.metrics.collect())
    assert trained.log_rows.count() == 2
    out = forecast.forecast(trained, rows, prepared.future_dims, model_features, cfg, as_of)
    found = out.groupBy("station").agg(F.count("*"), F.countDistinct("date", "hour")).collect()
    assert {tuple(x) for x in found} == {("A", 168, 168), ("B", 168, 168)}
    saved = str(tmp_path / "out")
    again = forecast.run_forecast(src, cfg, as_of, measures, saved)
    assert again.count() == 336
    assert spark.read.parquet(f"{saved}/forecasts").count() == 336
    assert sinks.read_published(spark, f"{saved}/published", as_of.date()).count() == 336
    assert sinks.read_model_log(spark, f"{saved}/model-log").count() == 2
    served = serving.forecast_serving(spark.read.parquet(f"{saved}/forecasts"), dt.date(2021, 4, 14))
    assert served.count() == 48
    assert set(serving.active_features(served.columns)) >= {"temperature", "cases", "check_ins_week_ago"}
    peak = out.where("station = 'A' AND hour = 6").agg(F.avg("check_ins_predicted")).first()[0]
    low = out.where("station = 'A' AND hour = 18").agg(F.avg("check_ins_predicted")).first()[0]
    assert peak > 2 * low
