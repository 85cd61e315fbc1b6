"""A log read as one stream: bad and late lines, observed counts, and a report that continues."""

import json
from datetime import datetime, timedelta

from harborlight.streaming.log import LogReport, weekly_report


def line(day, i, topic="a", mode=1, distance=0.5):
    return json.dumps({"ts": str(datetime(2024, 1, 1) + timedelta(days=day)), "event_id": i, "topic": topic, "mode": mode, "distance": distance})


def put(spark, folder, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(folder)


def test_bad_late_and_continued(spark, tmp_path):
    report, folder = LogReport(spark, f"{tmp_path}/report"), f"{tmp_path}/lines"
    put(spark, folder, [line(0, 1, distance=0.9), line(1, 2, distance=0.8), line(40, 3, "b"), "{broken", "", json.dumps({"topic": "a"})])
    run = report.absorb(spark.readStream.text(folder))
    seen = [p["observedMetrics"]["lines"] for p in run.recentProgress if p["observedMetrics"]]
    assert sum(json.loads(s.json)["lines"] if hasattr(s, "json") else s["lines"] for s in seen) == 5
    assert sum(json.loads(s.json)["bad"] if hasattr(s, "json") else s["bad"] for s in seen) == 2
    assert tuple(report.totals().first()) == (5, 2, 0)
    put(spark, folder, [line(26, 4, "late"), line(26.01, 5), line(0.5, 6, distance=0.7), line(41, 7, "b", mode=2), "also broken"])
    report.absorb(spark.readStream.text(folder))
    assert tuple(report.totals().first()) == (10, 3, 2)  # day 0.5 and day 26 are late, 14 days behind day 40
    got = sorted(map(tuple, report.rows(2).collect()))
    assert got == [("2024-W01", "a", 2, True, [1], [0.9, 0.8], ["1:2"]), ("2024-W04", "a", 1, False, [1], [0.5], ["1:1"]), ("2024-W06", "b", 2, True, [1, 2], [0.5, 0.5], ["1:1", "2:1"])]


def test_report_of_a_table_takes_the_first_distances_by_time(spark):
    rows = [(datetime(2024, 1, 1, 12 - i), i, "t", i % 2, float(i)) for i in range(9)]
    got = weekly_report(spark.createDataFrame(rows, "ts timestamp, event_id long, topic string, mode long, distance double"), 9).first()
    assert got.firsts == [8.0, 7.0, 6.0, 5.0, 4.0] and got.flagged and got.frequencies == ["0:5", "1:4"]
