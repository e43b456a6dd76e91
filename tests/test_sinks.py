"""Writers (SNK-1..4, SNK-7): every section in JSON lines and CSV, read back."""

import json
import os
import tempfile

import pytest

from trailsift.plans.pipeline import detect
from trailsift.sources.adapter import audit_events
from trailsift.functions.scalars import iso_time
from trailsift.sources.sinks import (clusters_json_lines, timeframes_json_lines, timeframes_pieces, write_json_document,
                                     write_section)


@pytest.fixture(scope="module")
def detection(spark, sf_small):
    return detect(audit_events(spark, sf_small))


def _lines(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(os.path.join(folder, name), encoding="utf-8") as fh:
                out.extend(line for line in fh.read().splitlines() if line)
    return out


def test_json_sections(spark, detection):
    base = tempfile.mkdtemp(prefix="trailsift-sinks-")
    write_section(detection, "clusters", "json", os.path.join(base, "clusters"))
    clusters = [json.loads(x) for x in _lines(os.path.join(base, "clusters"))]
    assert len(clusters) == detection.profile.count()
    assert set(clusters[0]) == {"cluster_id", "size", "error_rate", "event_names"}

    write_section(detection, "suspicious", "json", os.path.join(base, "suspicious"))
    (summary,) = [json.loads(x) for x in _lines(os.path.join(base, "suspicious"))]
    assert len(summary["suspicious_clusters"]) == 3
    assert summary["total_readonly"] == detection.labelled.count()

    write_section(detection, "timeframes", "json", os.path.join(base, "tf"))
    tfs = [json.loads(x) for x in _lines(os.path.join(base, "tf"))]
    assert len(tfs) == detection.timeframes.count()
    first = tfs[0]
    assert isinstance(first["start"], str) and isinstance(first["confidence"], float)
    assert all(len(i) == 4 for t in tfs for i in t["identities"])
    assert all(len(t["identities"]) == t["n_identities"] for t in tfs)


def test_long_identity_lists_go_on_in_parts(spark, detection):
    lines = [json.loads(r.json) for r in timeframes_json_lines(
        detection.timeframes, detection.apis, detection.identities, per_line=4).collect()]
    whole = {}
    for line in sorted(lines, key=lambda x: (x["start"], x["part"])):
        assert len(line["identities"]) <= 4 and (line["part"] == 0 or not line["example_apis"])
        whole.setdefault(line["start"], []).extend(map(tuple, line["identities"]))
    want = {}
    for r in detection.identities.orderBy("tf_start", "ord").collect():
        want.setdefault(r.tf_start.strftime("%Y-%m-%dT%H:%M:%S"), []).append((r.ip, r.iam, r.user_agent, r.os))
    assert {k: v for k, v in whole.items() if v} == want
    assert max(x["part"] for x in lines) > 0


def test_zoned_times_show_their_offset(spark):
    row = spark.sql("SELECT timestamp '2024-01-02 03:04:00' AS t").select(
        iso_time("t", zoned=True).alias("a"), iso_time("t").alias("b")).first()
    assert (row.a, row.b) == ("2024-01-02T03:04:00+00:00", "2024-01-02T03:04:00")


def test_csv_and_unknown(spark, detection):
    base = tempfile.mkdtemp(prefix="trailsift-csv-")
    write_section(detection, "timeframes", "csv", os.path.join(base, "tf"))
    rows = spark.read.option("header", "true").csv(os.path.join(base, "tf"))
    assert rows.count() == detection.timeframes.count()
    assert "apis_shown" in rows.columns
    with pytest.raises(ValueError):
        write_section(detection, "timeframes", "yaml", os.path.join(base, "x"))
    with pytest.raises(ValueError):
        write_section(detection, "nothing", "json", os.path.join(base, "y"))


def _document(folder):
    return json.loads("".join(open(os.path.join(folder, n), encoding="utf-8").read() for n in sorted(os.listdir(folder))
                              if n.startswith("part-")))


def test_documents_are_one_json_value(spark, detection):
    base = tempfile.mkdtemp(prefix="trailsift-doc-")
    for section in ("clusters", "suspicious", "timeframes"):
        write_section(detection, section, "document", os.path.join(base, section))
    clusters = _document(os.path.join(base, "clusters"))
    lines = [json.loads(r.json) for r in clusters_json_lines(detection.profile).collect()]
    assert clusters == {"clusters": sorted(lines, key=lambda x: x["cluster_id"])}
    assert set(_document(os.path.join(base, "suspicious"))) == {"suspicious_clusters", "suspicious_count", "total_readonly"}
    lines = [json.loads(r.json) for r in timeframes_json_lines(
        detection.timeframes, detection.apis, detection.identities).orderBy("tf_start").collect()]
    want = {"suspicious_timeframes": [{k: t[k] for k in ("start", "end", "confidence", "example_apis", "identities")}
                                      for t in lines]}
    assert _document(os.path.join(base, "timeframes")) == want and len(want["suspicious_timeframes"]) > 5
    # Long identity lists go on in further lines and parts of the same document.
    pieces = timeframes_pieces(detection.timeframes, detection.apis, detection.identities, per_line=4)
    assert pieces.count() > len(want["suspicious_timeframes"])
    write_json_document(pieces, "suspicious_timeframes", os.path.join(base, "small"))
    assert _document(os.path.join(base, "small")) == want
    write_json_document(pieces.limit(0), "suspicious_timeframes", os.path.join(base, "none"))
    assert _document(os.path.join(base, "none")) == {"suspicious_timeframes": []}
