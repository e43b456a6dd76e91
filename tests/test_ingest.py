"""Ingest of envelope files (SRC-1..10) and its robustness."""

import gzip
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from trailsift.operators.features import encode
from trailsift.sources.ingest import read_audit_logs



def record(name, minute, **more):
    return {"eventTime": f"2023-03-0{1 + minute % 5}T08:{minute:02d}:30Z", "eventName": name, **more}


SAMPLE = [
    record("GetCallerIdentity", 7, eventSource="sts.amazonaws.com", readOnly=True, errorCode=None,
           sourceIPAddress="203.0.113.9", userIdentity={"type": "Root", "principalId": "P1"}),
    record("ListKeys", 8, eventSource="kms.amazonaws.com", readOnly=True, errorCode="ThrottlingException",
           userAgent="tool/1.0", requestParameters={"limit": 5}),
    record("DescribeTable", 9, eventSource="dynamodb.amazonaws.com", readOnly="yes", errorCode="ResourceNotFound"),
]
NAMES = [r["eventName"] for r in SAMPLE]


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="trailsift-ingest-")


def test_single_file_envelope(spark, folder):
    path = _write(folder, "one.json", json.dumps({"Records": SAMPLE}))
    got = read_audit_logs(spark, path)
    rows = got.events.orderBy("event_id").collect()
    assert [r.eventName for r in rows] == NAMES
    assert [r.errorCode for r in rows] == [r["errorCode"] for r in SAMPLE]
    assert [r.readOnly for r in rows] == ["true", "true", "yes"]
    assert rows[0].userIdentity == '{"type":"Root","principalId":"P1"}'
    assert str(rows[1].eventTime) == "2023-03-04 08:08:30"
    assert got.bad_files.count() == 0


def test_directory_of_three_files_sorted(spark, folder):
    for i in range(3):
        _write(folder, f"test_{i}.json", json.dumps({"Records": [SAMPLE[i]]}))
    _write(folder, "notes.txt", "ignored")
    _write(folder, "UPPER.JSON", json.dumps([SAMPLE[0]]))
    got = read_audit_logs(spark, folder)
    names = [os.path.basename(r.file) for r in got.files.orderBy("file_no").collect()]
    assert names == ["UPPER.JSON", "test_0.json", "test_1.json", "test_2.json"]
    assert got.events.count() == 4


def test_directory_requires_event_name_key(spark, folder):
    records = [{"eventTime": "2020-09-25T12:00:00Z"}, {}, {"eventName": None}, "not-an-object"]
    _write(folder, "a.json", json.dumps({"Records": records}))
    got = read_audit_logs(spark, folder)
    assert got.events.count() == 1          # only the record that has the key (null value)
    # a file named directly is not validated
    got_file = read_audit_logs(spark, os.path.join(folder, "a.json"))
    assert got_file.events.count() == 4


def test_wrongly_typed_fields(spark, folder):
    rec = {"eventTime": "invalid-date", "readOnly": "yes", "sourceIPAddress": 12345,
           "userAgent": ["a", "b"], "errorCode": {"code": 1}, "eventSource": "x"}
    _write(folder, "typed.json", json.dumps({"Records": [rec]}))
    assert read_audit_logs(spark, folder).events.count() == 0     # no eventName key
    got = read_audit_logs(spark, os.path.join(folder, "typed.json"))
    row = got.events.first()
    assert row.eventTime is None and row.readOnly == "yes" and row.sourceIPAddress == "12345"
    feats = encode(got.events, keep=[]).first()
    assert feats.f10 == 1.0


def test_empty_records_and_truncated(spark, folder):
    _write(folder, "empty.json", json.dumps({"Records": []}))
    _write(folder, "broken.json", '{"Records": [{"eventName": "test"}')
    _write(folder, "other.json", json.dumps({"something": 1}))
    got = read_audit_logs(spark, folder)
    assert got.events.count() == 0
    bad = [os.path.basename(r.file) for r in got.bad_files.collect()]
    assert bad == ["broken.json"]


def test_missing_paths_and_globs(spark, folder):
    _write(folder, "x1.json", json.dumps([SAMPLE[0]]))
    _write(folder, "x2.json", json.dumps([SAMPLE[1]]))
    assert read_audit_logs(spark, os.path.join(folder, "nope")).events.count() == 0
    assert read_audit_logs(spark, os.path.join(folder, "x?.json")).events.count() == 2
    both = read_audit_logs(spark, [os.path.join(folder, "x*.json"),
                                   os.path.join(folder, "x1.json"), "/does/not/exist"])
    assert both.events.count() == 3          # overlapping arguments load a file twice
    assert [r.file_no for r in both.files.orderBy("file_no").collect()] == [0, 1, 2]


def test_every_listed_file_is_read_or_named_as_bad(spark, folder):
    good = ["plain.json", "with space.json", "per%20cent.json", "a%b.json", "sq[1].json", "cu{r}ly.json", "plus+.json",
            "q\u00fc.json"]
    for i, name in enumerate(good):
        _write(folder, name, json.dumps({"Records": [record(f"E{i}", i)]}))
    for name in ("_under.json", ".dot.json"):
        _write(folder, name, json.dumps([record("Hidden", 1)]))
    _write(folder, "broken.json", '{"Records": [')
    os.mkdir(os.path.join(folder, "sub.json"))
    _write(os.path.join(folder, "sub.json"), "inner.json", json.dumps([record("Inner", 1)]))
    got = read_audit_logs(spark, folder)
    assert {os.path.basename(r.src_file) for r in got.events.select("src_file").collect()} == set(good)
    assert {os.path.basename(r.file) for r in got.bad_files.collect()} == {"_under.json", ".dot.json", "broken.json"}
    files = {os.path.basename(r.file) for r in got.files.collect()}
    assert files == {*good, "broken.json"}
    # The same files named one by one.
    direct = read_audit_logs(spark, [os.path.join(folder, n) for n in [*good, "_under.json"]])
    assert [r.eventName for r in direct.events.orderBy("event_id").collect()] == [f"E{i}" for i in range(len(good))]
    assert direct.bad_files.count() == 1


def test_a_damaged_compressed_file_is_named(spark, folder):
    packed = gzip.compress(json.dumps({"Records": SAMPLE}).encode())
    for name, data in (("fine.json.gz", packed), ("cut.json.gz", packed[:-9]), ("no.json.gz", b"not packed")):
        with open(os.path.join(folder, name), "wb") as fh:
            fh.write(data)
    got = read_audit_logs(spark, os.path.join(folder, "*.gz"))
    assert got.events.count() == 3
    assert {(os.path.basename(r.file), r.reason) for r in got.bad_files.collect()} == {
        ("cut.json.gz", "damaged compressed file"), ("no.json.gz", "damaged compressed file")}


def test_fields_that_no_record_has(spark, folder):
    from trailsift.operators.filters import filter_by_services, filter_by_time, filter_readonly
    _write(folder, "bare.json", json.dumps([{"eventName": f"E{i}"} for i in range(6)]))
    got = read_audit_logs(spark, folder)
    absent = got.absent("eventTime", "eventSource", "readOnly", "eventName")
    assert absent == {"eventTime", "eventSource", "readOnly"}
    assert filter_by_time(got.events, "2023-01-01", absent=absent).count() == 6
    assert filter_by_services(got.events, ["s3"], absent=absent).count() == 6
    assert filter_readonly(got.events, absent=absent).count() == 6
    _write(folder, "more.json", json.dumps([record("Seen", 1, readOnly=True, eventSource="s3.amazonaws.com")]))
    got = read_audit_logs(spark, folder)
    absent = got.absent("eventTime", "eventSource", "readOnly")
    assert absent == set() and filter_readonly(got.events, absent=absent).count() == 1


def test_landed_filters_reach_the_scan(spark, folder):
    from trailsift.operators.filters import filter_by_services, filter_by_time, filter_readonly
    from trailsift.sources.ingest import land_as_parquet, read_landed
    _write(folder, "one.json", json.dumps(SAMPLE))
    path = os.path.join(folder, "landed")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    land_as_parquet(read_audit_logs(spark, os.path.join(folder, "one.json")).events, path)
    df = filter_readonly(filter_by_services(filter_by_time(read_landed(spark, path), "2023-03-01"), ["kms", "sts"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "is_readonly" in pushed and "In(service" in pushed and "GreaterThanOrEqual(eventTime" in pushed
    assert sorted(r.eventName for r in df.collect()) == ["GetCallerIdentity", "ListKeys"]


def test_minimal_event_runs_through_detection(spark, folder):
    from trailsift.plans.pipeline import detect
    path = _write(folder, "test.json", json.dumps(
        {"Records": [{"eventName": "test", "eventTime": "2025-01-01T00:00:00Z", "readOnly": True}]}))
    d = detect(read_audit_logs(spark, path).events)
    assert d.totals.first().noise == 1
    assert d.timeframes.count() == 0


def test_string_values_keep_json_quotes(spark, folder):
    rec = {"eventName": "A", "responseElements": "done", "requestParameters": None,
           "userIdentity": "anonymous"}
    path = _write(folder, "s.json", json.dumps([rec]))
    row = read_audit_logs(spark, path).events.first()
    assert row.responseElements == '"done"'
    assert row.requestParameters is None
    feats = encode(read_audit_logs(spark, path).events, keep=[]).first()
    assert feats.f12 == len(json.dumps("done"))


def test_missing_as_nan(spark, folder):
    recs = [{"eventName": "A", "errorCode": "X", "responseElements": {"a": 1}},
            {"eventName": "B"}]
    path = _write(folder, "m.json", json.dumps(recs))
    ev = read_audit_logs(spark, path).events
    clean = {r.eventName: r for r in encode(ev, keep=["eventName"]).collect()}
    nan = {r.eventName: r for r in encode(ev, keep=["eventName"], missing_as="nan").collect()}
    assert (clean["B"].f10, clean["B"].f12) == (0.0, 4.0)
    assert (nan["B"].f10, nan["B"].f12) == (1.0, 3.0)
    assert nan["A"].f12 == len(json.dumps({"a": 1}))


def test_time_formats(spark, folder):
    recs = [{"eventName": "A", "eventTime": "2020-09-25T12:00:00.123Z"},
            {"eventName": "B", "eventTime": "2020-09-25T14:00:00+02:00"},
            {"eventName": "C", "eventTime": "not-a-date"}]
    ev = read_audit_logs(spark, _write(folder, "t.json", json.dumps(recs))).events
    got = {r.eventName: r.t for r in ev.select("eventName", F.col("eventTime").cast("string")
                                                .alias("t")).collect()}
    assert got == {"A": "2020-09-25 12:00:00.123", "B": "2020-09-25 12:00:00", "C": None}


def test_many_files_and_folders_without_calls_per_file(spark, folder, monkeypatch):
    from py4j.java_gateway import GatewayClient
    from trailsift.sources.listing import Listing
    for i in range(500):
        part = os.path.join(folder, f"f{i:03d}")
        os.mkdir(part)
        for j in range(10):
            _write(part, f"{j}.json" if j else "0.JSON", "[]")
    os.mkdir(os.path.join(folder, "f000", "deep"))
    _write(os.path.join(folder, "f000", "deep"), "x.json", "[]")
    calls, send = [0], GatewayClient.send_command

    def counted(self, command, *args, **kw):
        calls[0] += not command.startswith("m\n")  # without the garbage collector's
        return send(self, command, *args, **kw)
    monkeypatch.setattr(GatewayClient, "send_command", counted)

    def listed(*globs):
        calls[0] = 0
        files = Listing(spark, [f"{folder}/{g}" for g in globs]).files()
        return files, calls[0]
    few = listed("f000", "f000/1.json*", "none")[1], listed("f00?", "f00?/1.json", "none")[1]
    files, many = listed("f*", "f00?/1.json", "none")
    assert many <= few[1] + 10 and few[1] < 2 * few[0]  # calls follow the arguments, not the files or folders
    rows = files.collect()
    assert len(rows) == 5010 and sum(r.from_dir for r in rows) == 5000
    assert all(r.arg == (0 if r.from_dir else 1) for r in rows)
    assert all(r.matched == (os.path.dirname(r.file) if r.from_dir else r.file) for r in rows)


def test_files_in_lower_folders_are_not_opened(spark, folder):
    from trailsift.sources.listing import Listing
    _write(folder, "a.json", "[]")
    os.mkdir(os.path.join(folder, "sub"))
    _write(os.path.join(folder, "sub"), "b.json", "[]")
    read = Listing(spark, [folder]).read("binaryFile").select("path", "content")
    assert [os.path.basename(r.path) for r in read.collect()] == ["a.json"]
    plan = read._jdf.queryExecution().executedPlan()
    while plan.children().nonEmpty():
        plan = plan.children().head()
    assert plan.metrics().apply("numFiles").value() == 1


@pytest.mark.parametrize("glob,yes,no", [
    ("/a/*.json", ["/a/x.json", "/a/.json"], ["/a/b/x.json", "/a/xjson", "/b/a/x.json"]),
    ("/a/?[0-9]/{x,y}.js*", ["/a/b1/x.json", "/a/c9/y.js"], ["/a/b1/z.json", "/a/1/x.json"]),
    ("/a/[!b]\\*", ["/a/c*"], ["/a/b*", "/a/cx"]),
])
def test_glob_regex(glob, yes, no):
    import re
    from trailsift.sources.listing import glob_regex
    assert all(re.search(glob_regex(glob), p) for p in yes) and not any(re.search(glob_regex(glob), p) for p in no)


def _rows(got):
    return sorted((r.src_file, r.src_pos, r.event_id, r.raw, r.eventName, r.userIdentity) for r in got.events.collect())


def test_large_envelopes_are_read_by_ranges(spark, folder):
    """The same records, positions and bad files as a read by rows, however the ranges fall."""
    tricky = [record("A}{][", 1, text='br}ace "quoted" \\ }, {"x":[1,2]}', nested={"a": [{"b": "}"}, []], "Records": [1]}),
              {}, record("ü日本", 2, tail="ends in backslash \\"), "plain } text", 12.5, None, [1, {"c": "],"}],
              *[record(f"E{i}", i % 50, n=i, note="}" * (i % 7), userIdentity={"type": "IAMUser", "n": i}) for i in range(300)]]
    files = {"object.json": json.dumps({"first": {"Records": [{"no": 1}]}, "list": [1, {"x": "}"}], "Records": tricky, "after": [2]}),
             "list.json": json.dumps(tricky, indent=1, ensure_ascii=False) + "\n",
             "compact.json": json.dumps({"Records": tricky}, separators=(",", ":")),
             "spaced name+%.json": json.dumps([record("Odd", 3)] * 40),
             "scalar.json": " " * 300 + "5", "none.json": json.dumps({"other": [1] * 200}),
             "empty.json": '{"Records": [' + " " * 300 + "]}",
             "cut.json": json.dumps({"Records": tricky})[:-1], "cut_string.json": json.dumps(tricky)[:-20],
             "comma.json": json.dumps([{"eventName": "x"}] * 30)[:-1] + ", bad]"}
    for name, text in files.items():
        _write(folder, name, text)
    args = [folder, f"{folder}/*.json"]
    whole = read_audit_logs(spark, args)
    want, bad = _rows(whole), sorted(os.path.basename(r.file) for r in whole.bad_files.collect())
    assert {"cut.json", "cut_string.json", "comma.json", "scalar.json"} <= set(bad) and len(want) > 1000
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2500", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_audit_logs(spark, args, large=200)
            assert sorted(os.path.basename(r.file) for r in got.bad_files.collect()) == bad
            assert _rows(got) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_most_fragments_are_taken_whole(monkeypatch):
    """The plain path and the token path cut alike, and records take the plain one."""
    from trailsift.sources import ranges
    recs = [record(f"E{i}", i % 50, n=i, text='a "}" \\ b', tags=[{"k": [i]}, {"k": []}], userIdentity={"type": "T", "n": i})
            for i in range(200)]
    pieces, slow = [], []
    token = ranges._TOKEN

    class Counted:
        def search(self, *args):
            slow.append(1)
            return token.search(*args)
    for plain in (True, False):
        for text in (json.dumps({"other": {"a": [1]}, "Records": recs, "z": 1}), json.dumps([*recs, [1, {"x": 2}], "}", 5])):
            monkeypatch.setattr(ranges, "_TOKEN", Counted() if plain else token)
            if not plain:
                monkeypatch.setattr(ranges._Cutter, "_pass", lambda self, text: False)
            cutter = ranges._Cutter(False, 0, 1 if text[0] == "[" else 2)
            for part in text.split("}"):
                cutter.feed(part + "}")
            cutter.finish()
            pieces.append((cutter.pieces, cutter.number, cutter.in_string, cutter.depth))
    assert pieces[:2] == pieces[2:] and len(pieces[0][0]) > 200
    assert len(slow) < 200  # a token search per bracket, comma and text would be thousands


def test_absent_everywhere_and_absent_here(spark, folder):
    """The four states of a field under ``missing_as='nan'``: a value, null, absent here, absent everywhere."""
    recs = [{"eventName": "value", "errorCode": "X"}, {"eventName": "null", "errorCode": None}, {"eventName": "here"}]
    path = _write(folder, "four.json", json.dumps(recs))
    got = read_audit_logs(spark, path)
    absent = got.absent("errorCode", "awsRegion", "userIdentity", "responseElements", "sourceIPAddress")
    assert absent == {"awsRegion", "userIdentity", "responseElements", "sourceIPAddress"}
    rows = {r.eventName: r for r in encode(got.events, keep=["eventName"], missing_as="nan", absent=absent).collect()}
    assert [rows[k].f10 for k in ("value", "null", "here")] == [1.0, 0.0, 1.0]  # 'nan' is a text
    null = encode(got.events, keep=["eventName"]).filter("eventName = 'here'").first()
    assert [rows["here"][c] for c in ("f04", "f07", "f08", "f12")] == [null[c] for c in ("f04", "f07", "f08", "f12")]
    unknown = encode(got.events, keep=["eventName"], missing_as="nan").filter("eventName = 'here'").first()
    assert unknown.f08 != rows["here"].f08 and unknown.f12 == 3.0
    assert got.schema() == "OBJECT<errorCode: STRING, eventName: STRING>"
