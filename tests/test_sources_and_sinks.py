import datetime as dt
import json
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from diurna.sources import health_xml as X
from diurna.sources import metric_json as J
from diurna.sources import sinks, tables

EXPORT = """<?xml version="1.0"?>
<HealthData>
 <Record type="HKCategoryTypeIdentifierSleepAnalysis" sourceName="Watch" startDate="2024-01-01 23:30:00 -0800" endDate="2024-01-02 07:00:00 -0800" value="HKCategoryValueSleepAnalysisAsleepCore"/>
 <Record type="HKCategoryTypeIdentifierSleepAnalysis" sourceName="Watch" startDate="2024-01-02 23:30:00 -0800" endDate="2024-01-02 23:30:00 -0800" value="HKCategoryValueSleepAnalysisAsleep"/>
 <Record type="HKCategoryTypeIdentifierSleepAnalysis" sourceName="Watch" startDate="2024-01-03 23:30:00 -0800" endDate="2024-01-04 01:30:00 -0800" value="HKCategoryValueSleepAnalysisDozing"/>
 <Record type="HKQuantityTypeIdentifierStepCount" sourceName="Phone" unit="count" startDate="2024-01-02 08:00:00 -0800" endDate="2024-01-02 08:10:00 -0800" value="512"/>
 <Record type="HKQuantityTypeIdentifierStepCount" sourceName="Phone" unit="count" startDate="2024-01-03 08:00:00 -0800" endDate="2024-01-03 08:10:00 -0800" value="-4"/>
 <Record type="HKQuantityTypeIdentifierHeartRate" sourceName="Watch" unit="count/min" startDate="2024-01-02 09:00:00 -0800" endDate="2024-01-02 09:00:00 -0800" value="61">
  <MetadataEntry key="HKMetadataKeyHeartRateMotionContext" value="Sedentary"/>
 </Record>
 <Record type="HKQuantityTypeIdentifierHeartRate" sourceName="Watch" unit="count/min" startDate="2024-01-02 10:00:00 -0800" endDate="2024-01-02 10:00:00 -0800" value="99">
  <MetadataEntry key="HKMetadataKeyHeartRateMotionContext" value="2"/>
 </Record>
</HealthData>"""


def export(folder):
    path = Path(folder) / "user_7"
    path.mkdir()
    (path / "export.xml").write_text(EXPORT)
    return str(path)


def test_xml_records_become_typed_rows_and_rejects(spark, folder):
    records = X.read_health_xml(spark, export(folder))
    sleep = X.sleep_from_xml(records)
    kept = X.accepted(sleep).collect()
    assert [(r.user_id, r.state, r.start_ts) for r in kept] == [(7, "ASLEEP_CORE", dt.datetime(2024, 1, 1, 23, 30))]
    assert {r.reason for r in X.rejected(sleep).collect()} == {"end not after start", "unknown state"}
    steps = X.activity_from_xml(records)
    assert [r.value for r in X.accepted(steps).collect()] == [512.0]
    assert [r.reason for r in X.rejected(steps).collect()] == ["negative value"]
    heart = X.accepted(X.heart_from_xml(records)).orderBy("ts").collect()
    assert [r.motion_context for r in heart] == ["sedentary", "unknown"]
    numeric = X.accepted(X.heart_from_xml(records, numeric_motion=True)).orderBy("ts").collect()
    assert [r.motion_context for r in numeric] == ["sedentary", "active"]
    outcome = X.file_outcomes(sleep).collect()[0]
    assert (outcome.accepted, outcome.rejected, outcome.status) == (1, 2, "success")


def test_xml_date_and_type_filters(spark, folder):
    path = export(folder)
    only = X.read_health_xml(spark, path, types=["HKQuantityTypeIdentifierStepCount"], start="2024-01-03", end="2024-01-03")
    assert [r.value for r in only.collect()] == ["-4"]


def odd_export(folder, records=60):
    """Records with children, quotes, entities, marks inside values and other elements between them."""
    rows = ["<?xml version='1.0' encoding='UTF-8'?>\r\n<!DOCTYPE HealthData [\n<!ELEMENT Record (MetadataEntry*)>\n<!ATTLIST Record type CDATA #REQUIRED>\n]>\n<HealthData locale='en'>\n"]
    for i in range(records):
        start, end = f"2024-01-{1 + i % 28:02d} 08:00:00 -0800", f"2024-01-{1 + i % 28:02d} 08:{i % 60:02d}:00 -0800"
        attributes = [f'type="HKQuantityTypeIdentifierHeartRate"', f"sourceName='Kim&apos;s &quot;{i}&quot; &#x231a; &gt; > a=\"b\"'", 'unit="count/min"',
                      f'device="&lt;Record type=&quot;no&quot;/&gt; /> {"y" * (i % 13)}"', f'startDate="{start}"', f'endDate="{end}"', f'value="{60 + i}"']
        tag = ("\n  " if i % 3 else " ").join(attributes)
        if i % 4 == 0:
            rows.append(f" <Record {tag}/>\n")
        else:
            word = "sedentary" if i % 2 else "active"
            rows.append(f' <Record\t{tag}>\r\n  <MetadataEntry key="Other" value="x>y"/>\n'
                        f'  <MetadataEntry value="{word}" key="HKMetadataKeyHeartRateMotionContext"/>\n </Record>\n')
        if i % 10 == 9:
            rows.append('<Workout type="run"><MetadataEntry key="HKMetadataKeyHeartRateMotionContext" value="active"/></Workout>\n<RecordSet n="1"/>\n')
    path = Path(folder) / "user_9"
    path.mkdir()
    (path / "export.xml").write_bytes("".join([*rows, "</HealthData>\n"]).encode())
    return path / "export.xml"


@pytest.mark.parametrize("size", [61, 173, 512, 1000, 4096])
def test_one_export_is_read_in_ranges(spark, folder, size):
    path = odd_export(folder)
    want = []
    for r in ET.parse(path).getroot().iter("Record"):
        motion = [m.get("value") for m in r.iter("MetadataEntry") if m.get("key") == "HKMetadataKeyHeartRateMotionContext"]
        day = dt.datetime.fromisoformat
        want.append((9, r.get("type"), r.get("sourceName"), r.get("unit"), r.get("value"), motion[0] if motion else None,
                     day(r.get("startDate")[:19]), day(r.get("endDate")[:19])))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        records = X.read_health_xml(spark, str(path))
        got = records.drop("file").collect()
        filled = {r.p for r in records.select(F.spark_partition_id().alias("p")).distinct().collect()}
        assert X.read_health_xml(spark, str(path), types=["HKQuantityTypeIdentifierStepCount"]).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) == 60
    assert len(filled) > 4


def test_xml_without_records(spark, folder):
    path = Path(folder) / "user_1"
    path.mkdir()
    for name, text in {"a": "", "b": "<HealthData></HealthData>", "c": "\n<HealthData><Record type='x' startDate='2024-01-01", "d": "<a><Record></Record></a>"}.items():
        (path / f"{name}.xml").write_text(text)
    assert X.read_health_xml(spark, str(path)).collect() == []


def test_json_layouts(spark, folder):
    root = Path(folder)
    nested = {"data": {"metrics": [
        {"name": "sleep_analysis", "data": [
            {"sleepStart": "2024-01-01 23:00:00 -0800", "sleepEnd": "2024-01-02 06:30:00 -0800", "source": "Watch"},
            {"start": "2024-01-02T22:00:00Z", "finish": "2024-01-03T06:00:00Z"}, {"sleepStart": "x"}]},
        {"name": "step_count", "data": [{"date": "2024-01-02 00:00:00 -0800", "qty": 8000, "source": "Phone|Watch"}]},
        {"name": "walking_distance", "data": [{"date": "2024-01-02 00:00:00", "qty": 5.5}]},
        {"name": "heart_rate", "data": [{"date": "2024-01-02 08:00:00", "Avg": 70}]},
        {"name": "resting_heart_rate", "data": [{"date": "2024-01-02 00:00:00", "qty": 55}]},
        {"name": "heart_rate_variability", "data": [{"date": "2024-01-02 00:00:00", "qty": 42}]}]}}
    flat = {"data": [
        {"startDate": "2024-01-05T23:00:00Z", "endDate": "2024-01-06T07:00:00Z", "value": "AsleepCore", "sourceName": "Ring"},
        {"startDate": "2024-01-06 23:00:00", "endDate": "2024-01-07 07:00:00", "value": "InBed"}]}
    steps = {"data": [{"startDate": "2024-01-05 08:00:00", "endDate": "2024-01-05 09:00:00", "value": "100", "unit": "count"},
                      {"startDate": "2024-01-05 08:00:00", "endDate": "2024-01-05 09:00:00", "value": "1.5", "unit": "km"}]}
    (root / "Sleep Analysis.json").write_text(json.dumps(nested))
    (root / "sleep_flat.json").write_text(json.dumps(flat))
    (root / "Step Count.json").write_text(json.dumps(steps))
    sleep = J.read_sleep_json(spark, folder).orderBy("start_ts").collect()
    assert [(r.source_name, r.state) for r in sleep] == [
        ("Watch", "ASLEEP"), ("Unknown", "ASLEEP"), ("Ring", "ASLEEP"), ("Unknown", "IN_BED")]
    acts = X.accepted(J.nested_activity(J.nested_entries(spark, folder))).orderBy("activity_type").collect()
    assert [(r.activity_type, r.value, r.source_name) for r in acts] == [
        ("DISTANCE_WALKING", 5.5, "Unknown"), ("STEP_COUNT", 8000.0, "Phone")]
    assert acts[1].end_ts == dt.datetime(2024, 1, 2, 23, 59, 59)
    heart = X.accepted(J.nested_heart(J.nested_entries(spark, folder))).orderBy("value").collect()
    assert [(r.metric_type, r.motion_context, r.value) for r in heart] == [
        ("HRV_SDNN", "unknown", 42.0), ("HEART_RATE", "sedentary", 55.0), ("HEART_RATE", "unknown", 70.0)]
    flat_rows = J.read_activity_json(spark, folder).orderBy("value").collect()
    assert [(r.activity_type, r.value) for r in flat_rows] == [("DISTANCE_WALKING", 1.5), ("STEP_COUNT", 100.0)]


def test_every_json_entry_is_accepted_or_rejected(spark, folder):
    heart = {"data": {"metrics": [
        {"name": "resting_heart_rate", "data": [{"date": "2024-01-02 00:00:00"}, {"date": "x", "qty": 3}, {"date": "2024-01-02", "qty": -1}]},
        {"name": "heart_rate", "data": [{"date": "2024-01-02 08:00:00", "Avg": "many"}]}]}}
    steps = {"data": [{"startDate": "2024-01-05 08:00:00", "endDate": "2024-01-05 07:00:00", "value": "1"},
                      {"startDate": "2024-01-05 08:00:00", "endDate": "2024-01-05 09:00:00", "value": "ten"},
                      {"startDate": "2024-01-05 08:00:00", "endDate": "2024-01-05 09:00:00"}]}
    (Path(folder) / "Heart Rate.json").write_text(json.dumps(heart))
    (Path(folder) / "Step Count.json").write_text(json.dumps(steps))
    rows = J.heart_json(spark, folder)
    assert sorted(r.reason or "" for r in rows.collect()) == ["", "bad date", "bad value", "negative value"]
    assert [r.value for r in J.read_heart_json(spark, folder).collect()] == [0.0]
    rows = J.activity_json(spark, folder)
    assert sorted(r.reason or "" for r in rows.collect()) == ["", "bad value", "end before start"]
    assert X.accepted(rows).count() + X.rejected(rows).count() == 3
    assert X.file_outcomes(rows).collect()[0].status == "success"


def test_people_without_a_name_are_not_merged(spark, folder):
    for name in ("a", "b"):
        (Path(folder) / name).mkdir()
        (Path(folder) / name / "export.xml").write_text(EXPORT)
    users = {r.user_id for r in X.read_health_xml(spark, folder + "/*").select("user_id").collect()}
    assert len(users) == 2 and all(u < 0 for u in users)


def test_one_date_with_most_rows_is_written_in_several_files(spark, folder):
    rows = spark.range(400_000).selectExpr(
        "id AS user_id", "date_add(DATE '2024-01-01', int(if(id % 10 = 0, id % 7, 0))) AS date", "rand(1) AS value")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        sinks.write_features(rows, f"{folder}/w")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list(Path(f"{folder}/w/date=2024-01-01").glob("part-*"))) > 1
    assert spark.read.parquet(f"{folder}/w").count() == 400_000


def test_label_csv_defaults_and_skips(spark, folder):
    (Path(folder) / "a.csv").write_text("date,mood,severity\n2024-01-01,manic,4\n,manic,4\n")
    ok, skipped = tables.read_labels_csv(spark, f"{folder}/a.csv")
    row = ok.collect()[0]
    assert (row.start_date, row.end_date, row.episode_type, row.severity) == (dt.date(2024, 1, 1),) * 2 + ("manic", 4)
    assert skipped.count() == 1
    (Path(folder) / "b.csv").write_text("start_date,end_date,notes\n2024-01-01,2024-01-03,x\n")
    row = tables.read_labels_csv(spark, f"{folder}/b.csv")[0].collect()[0]
    assert (row.episode_type, row.severity, row.end_date) == ("depressive", 3, dt.date(2024, 1, 3))


def test_writers_round_trip(spark, folder):
    rows = [(u, dt.date(2024, 1, d), 0.1 * d, 0.2, 0.3, 0.5) for u in (1, 2) for d in (3, 1, 2)]
    scores = spark.createDataFrame(rows, tables.PREDICTIONS)
    for fmt in ("parquet", "csv"):
        sinks.write_features(scores, f"{folder}/f_{fmt}", fmt)
        back = spark.read.option("header", True).format(fmt).load(f"{folder}/f_{fmt}")
        assert back.count() == 6 and back.select("date").distinct().count() == 3
    sinks.write_predictions(scores, f"{folder}/p")
    assert spark.read.option("header", True).csv(f"{folder}/p/daily").count() == 6
    assert spark.read.json(f"{folder}/p/summary").count() == 2
    sinks.write_cohort(scores, f"{folder}/c")
    newer = scores.filter("user_id = 1 AND date = DATE '2024-01-01'").withColumn("confidence", F.lit(0.9))
    sinks.upsert_to(f"{folder}/c", newer, ["user_id", "date"], ["confidence"], f"{folder}/c2")
    merged = spark.read.parquet(f"{folder}/c2")
    assert merged.count() == 6 and merged.filter("confidence = 0.9").count() == 1
    labels = scores.select("date", F.lit("manic").alias("label"))
    for fmt in ("csv", "json"):
        sinks.write_labels(labels, f"{folder}/l_{fmt}", fmt)
        assert spark.read.option("header", True).format(fmt).load(f"{folder}/l_{fmt}").count() == 6
    wide = spark.createDataFrame([(1, dt.date(2024, 1, 1), 7.0, 1.0)], "user_id long, as_of date, mean double, std double")
    for hour in (1, 2, 2):  # the job of two o'clock runs twice
        sinks.append_snapshot(wide, ["mean", "std"], f"{folder}/b", dt.datetime(2024, 1, 2, hour))
    assert spark.read.parquet(f"{folder}/b").count() == 4
    (Path(folder) / "pred.json").write_text(json.dumps([{"user_id": 1, "date": "2024-01-01", "depression": 0.4}]))
    assert tables.read_predictions(spark, f"{folder}/pred.json").collect()[0].depression == 0.4
    recs = spark.sql("SELECT 1 AS user_id, explode(sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-05 00:00:00', interval 1 day)) AS start_ts")
    assert sinks.delete_period(recs, "2024-01-02 00:00:00", "2024-01-03 00:00:00", f"{folder}/d") == 2
    assert spark.read.parquet(f"{folder}/d").count() == 3
