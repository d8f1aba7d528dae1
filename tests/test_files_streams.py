import datetime
import hashlib
import json
import threading

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fleetgauge.sources import readers as rd
from fleetgauge.sources import sinks as sk
from fleetgauge.sources.files import read_files, write_files
from fleetgauge.streaming import live


def test_manifests_take_identity_from_the_path(spark, tmp_path):
    for name, number, text in (("left", 1, json.dumps({"status": "valid", "parameters": {"frames": 10}}, indent=2)), ("right", 2, "[1, 2]"), ("right", 3, "{broken")):
        folder = tmp_path / name / f"round-{number:02d}" / "run-01"
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text(text)
    out = {(r.implementation, r["round"]): r for r in rd.read_run_manifests(spark, f"{tmp_path}/*/*/*/manifest.json").collect()}
    assert set(out) == {("left", 1), ("right", 2), ("right", 3)}
    assert out["left", 1].status == "valid" and out["left", 1].parameters.frames == 10 and out["left", 1].read_error is None
    assert out["right", 3].read_error and out["right", 3].status is None and out["right", 2].status is None


def test_event_log_shapes(spark, tmp_path):
    event = {"schema_version": 1, "attempt_index": 1, "sequence_index": 1, "round_index": 1, "implementation": "a", "status": "completed", "returncode": 0,
             "required_idle_seconds": 0.0, "observed_idle_seconds": 0.0, "started_at_utc": "2026-01-01T00:00:00+00:00", "finished_at_utc": "2026-01-01T01:00:00+02:00",
             "duration_seconds": 1.0, "manifest": "m"}
    changes = [{}, {"status": "open"}, {"attempt_index": 0}, {"started_at_utc": "2026-01-01T00:00:00"}, {"duration_seconds": -1.0}]
    path = tmp_path / "events.jsonl"
    path.write_text("\n".join(json.dumps({**event, **c, "returncode": n}) for n, c in enumerate(changes)) + "\n\n")
    out = {r.returncode: r.errors for r in rd.read_event_log(spark, str(path)).collect()}
    assert out == {0: [], 1: ["invalid status"], 2: ["indexes must be positive"], 3: ["timestamps must include a timezone"], 4: ["duration cannot be negative"]}


def test_digests_of_all_names_and_sizes(spark, tmp_path):
    files = {"a.bin": b"x" * 10, "b.bin": bytes(range(256)) * 9000, "with space+%41.bin": b"y", "_x": b"1", ".x": b"2", "empty": b"", "deep/er/c.bin": b"z", "deep/é.bin": b"e"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "locked.bin").symlink_to(tmp_path / "nowhere")
    expected = {n: (hashlib.sha256(c).hexdigest(), len(c), n[0] in "_.") for n, c in files.items()}
    for shares in (1, 3):
        rows = {r.path.split(f"{tmp_path}/")[1]: r for r in rd.file_digests(spark, str(tmp_path), shares).collect()}
        rows.pop("locked.bin", None)
        assert {n: (r.sha256, r.size_bytes, r.hidden) for n, r in rows.items()} == expected and all(r.read_error is None for r in rows.values())
    only = lambda path: {r.name for r in read_files(spark, path).collect()}
    assert only(f"{tmp_path}/*.bin") == {"a.bin", "b.bin", "with space+%41.bin", "locked.bin"} - {"locked.bin"} | only(f"{tmp_path}/locked.bin*")
    assert only(f"file://{tmp_path}/d*/**") >= {"é.bin"} and only(f"{tmp_path}/{{a,b}}.bin") == {"a.bin", "b.bin"} and only(f"{tmp_path}/a.bin") == {"a.bin"}
    with pytest.raises(Exception, match="nothing-here"):
        read_files(spark, f"{tmp_path}/nothing-here").collect()


def test_written_files_come_back(spark, tmp_path):
    rows = [("a/b.bin", b"12"), ("a/c.bin", None), ("_d", b"\0\xff"), ("e", b"")]
    write_files(spark.createDataFrame(rows, "name string, content binary").repartition(3), str(tmp_path))
    got = {r.path.split(f"{tmp_path}/")[1]: bytes(r.content) for r in read_files(spark, str(tmp_path), "content").collect()}
    assert got == {n: b or b"" for n, b in rows}
    with pytest.raises(Exception, match="not a relative file name"):
        write_files(spark.createDataFrame([("../x", b"1")], "name string, content binary"), str(tmp_path))


def test_empty_and_hidden_manifests(spark, tmp_path):
    for name, number, text in (("left", 1, ""), ("left", 2, json.dumps({"status": "valid"}))):
        folder = tmp_path / name / f"round-{number:02d}" / "run-01"
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text(text)
    out = {(r.implementation, r["round"]): (r.status, r.read_error) for r in rd.read_run_manifests(spark, f"{tmp_path}/*/*/*/manifest.json").collect()}
    assert out == {("left", 1): (None, "empty file"), ("left", 2): ("valid", None)}


def test_sorted_json_refuses_nan(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.5), (1, None)], "b int, a double")
    sk.write_sorted_json(df, f"{tmp_path}/ok", ["b"])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/ok").collect()]
    assert sorted(lines) == ['{"a":1.5,"b":2}', '{"a":null,"b":1}']
    with pytest.raises(Exception, match="a is not finite"):
        sk.write_sorted_json(spark.createDataFrame([(1, float("nan"))], "b int, a double"), f"{tmp_path}/bad", ["b"])


def test_create_once_and_publish(spark, tmp_path):
    path = f"{tmp_path}/out"
    sk.create_exclusive(spark.range(3), path)
    with pytest.raises(AnalysisException):
        sk.create_exclusive(spark.range(5), path)
    none_large = [("too large", lambda df: df.filter("id > 8"))]
    path = f"{tmp_path}/published"
    with pytest.raises(FileNotFoundError):
        sk.read_published(spark, path)
    assert sk.publish_atomically(spark.range(3), path, none_large) == 1
    early = sk.read_published(spark, path)
    assert sk.publish_atomically(spark.range(4), path, none_large) == 2
    with pytest.raises(sk.PublicationError, match="too large"):
        sk.publish_atomically(spark.range(20), path, none_large)
    # A reader of an older version is not disturbed.
    assert sk.read_published(spark, path).count() == 4 and early.count() == 3


def test_a_reader_never_misses_the_target(spark, tmp_path):
    path, seen, stop = f"{tmp_path}/out", [], threading.Event()
    sk.publish_atomically(spark.range(1), path, [])

    def read():
        while not stop.is_set():
            seen.append(sk.read_published(spark, path).count())

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 6):
        sk.publish_atomically(spark.range(n), path, [])
    stop.set()
    reader.join()
    assert seen == sorted(seen) and set(seen) <= {1, 2, 3, 4, 5}


def test_one_of_two_writers_wins(spark, tmp_path):
    path, second = f"{tmp_path}/out", []
    # The check of the first writer runs between its write and its pointer; the second one publishes there.
    late = ("late", lambda df: (second.append(sk.publish_atomically(spark.range(2), path, [])), df.limit(0))[1])
    with pytest.raises(sk.PublicationError, match="another writer"):
        sk.publish_atomically(spark.range(9), path, [late])
    assert second == [1] and sk.read_published(spark, path).count() == 2


def batches_of(spark, folder, batches, schema):
    """A stream that brings one file after the other."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_sequence_guard_over_several_batches(spark, tmp_path):
    batches = [[("a", 1, True), ("a", 3, True), ("b", 2, True), ("c", 1, True)], [("a", 2, True), ("b", 4, False)], [("a", 4, True), ("b", 1, True), ("c", 1, True), ("d", None, True)]]
    stream = batches_of(spark, f"{tmp_path}/in", batches, "k string, n long, ok boolean")
    for size in (1, 2, 100):
        guarded = live.stream_sequence_guard(stream, "k", "n", F.col("ok"), size)
        parts = live.run_once(guarded, "guard", "update", ["key", "part"])
        # A campaign is kept by as many states as it has ranges.
        assert parts.filter("key = 'a'").count() == -(-4 // size)
        out = {r.key: (r.attempts, r.contiguous, r.unexpected_steps) for r in live.merge_guard(parts).collect()}
        # a is whole, b lacks 3, c repeats 1, d has no index.
        assert out == {"a": (4, True, 0), "b": (3, False, 1), "c": (2, False, 0), "d": (1, False, 0)}


def hours(*values):
    return [datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=v) for v in values]


def kept(spark, state):
    return spark.read.format("statestore").load(state).count()


def test_idle_runs_leave_the_state(spark, tmp_path):
    times = hours(0, 1, 2, 200, 201, 400)
    batches = [[("idle", times[0], 5), ("idle", times[1], 7), ("long", times[2], 1)], [("long", times[3], 3), ("other", times[4], 9)], [("idle", times[5], 2), ("x", times[5], 4)]]
    stream = batches_of(spark, f"{tmp_path}/in", batches, "run string, ts timestamp, n long")
    state = f"{tmp_path}/state"
    parts = live.run_once(live.stream_first_last_marker(stream, ["run"], "n", "ts", "1 day", "1 hour"), "m", "update", ["run", "part_start"], checkpoint=state)
    # The first part of the idle run is gone from the state, and its result is still right.
    assert kept(spark, state) == 2
    out = {r.run: (r.first_frame, r.last_frame, r.frames) for r in live.merge_markers(parts, ["run"]).collect()}
    assert out == {"idle": (2, 7, 3), "long": (1, 3, 2), "other": (9, 9, 1), "x": (4, 4, 1)}


def test_sessions_close_at_the_end(spark, tmp_path):
    batches = [[("a", t) for t in hours(0, 1, 2)] + [("b", t) for t in hours(1)], [("a", t) for t in hours(30, 31)], [("b", t) for t in hours(60)] + [(None, t) for t in hours(60, 61)]]
    stream = batches_of(spark, f"{tmp_path}/in", batches, "k string, ts timestamp")
    state = f"{tmp_path}/state"
    closing = live.Closing(stream, "ts")
    out = live.run_once(live.stream_idle_sessions(closing.events, ["k"], "ts", "5 hours", "1 hour"), "s", closing=closing, checkpoint=state)
    assert sorted(((r.k, r.session_start, r.events) for r in out.collect()), key=str) == sorted(
        [("a", hours(0)[0], 3), ("b", hours(1)[0], 1), ("a", hours(30)[0], 2), ("b", hours(60)[0], 1), (None, hours(60)[0], 2)], key=str)
    # Only the closing row is left.
    assert kept(spark, state) == 1


def test_extension_trigger(spark, tmp_path):
    at = hours(0, 50, 100)
    rows = [("a", 1, 100.0), ("a", 2, 101.0), ("a", 3, 120.0), ("b", 1, 100.0), ("b", 2, 200.0), ("c", 1, 10.0), ("c", 2, 10.0), ("c", 3, 10.1), ("c", 4, 99.0)]
    batches = [[(k, i, v, at[min(i, 3) - 1]) for k, i, v in rows if min(i, 3) == n] for n in (1, 2, 3)]
    stream = batches_of(spark, f"{tmp_path}/in", batches, "k string, i int, v double, ts timestamp")
    state = f"{tmp_path}/state"
    parts = live.run_once(live.stream_extension_trigger(stream, ["k"], "i", "v", 3, "ts", "1 day", "1 hour"), "e", "update", ["k", "part_start"], checkpoint=state)
    out = {r.k: (r.runs, r.extend) for r in live.extension_verdict(parts, ["k"], 3, 0.05).collect()}
    assert out == {"a": (3, True), "b": (2, False), "c": (3, False)}
    assert kept(spark, state) == 2
