"""Streams in several micro-batches give what the batch operators give."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.operators import cooldown, detect, packets as K, points as P
from sensorloom.sources import feeds, store
from sensorloom.streaming import ingest, keyed, runtime

BASE = 1_704_067_200
READING = "mesh_id string, node_id long, field string, value double, time timestamp, packet_id long"


def moment(seconds):
    return datetime.fromtimestamp(BASE + seconds, timezone.utc)


def write_in_pieces(spark, rows, schema, folder, pieces=3):
    """One file per piece, written in order, for `maxFilesPerTrigger`."""
    size = -(-len(rows) // pieces)
    for i in range(pieces):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def stream_of(spark, schema, folder):
    return feeds.open_stream(spark, "parquet", {"maxFilesPerTrigger": "1"}, schema, folder)


def run(stream, out, checkpoint):
    return runtime.run_until_caught_up(stream, lambda b, n: store.write_rows(b, out, n), checkpoint, partitions=4)


def test_stuck_value_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("m", i % 2, "x", float((i // 14) % 3), moment(i * 60), i) for i in range(90)]
    batch = write_in_pieces(spark, rows, READING, source)
    query = run(keyed.stuck_value_stream(stream_of(spark, READING, source)), out, str(tmp_path / "cp"))
    assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == 3
    columns = ["device_id", "value", "triggered_at"]
    streamed = sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()))
    assert streamed == sorted(map(tuple, detect.stuck_value(batch).select(*columns).collect())) and streamed


def test_cool_down_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("m", i % 2, "c", "absence", "stream", None, f"{i:03d}", moment(i * 700 + (i % 5) * 90)) for i in range(60)]
    batch = write_in_pieces(spark, rows, schemas.ALARM, source)
    run(keyed.cool_down_stream(stream_of(spark, schemas.ALARM, source)), out, str(tmp_path / "cp"))
    columns = ["device_id", "triggered_at", "message"]
    streamed = sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()))
    assert streamed == sorted(map(tuple, cooldown.cool_down(batch).select(*columns).collect())) and streamed


def test_absence_timers(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    # Node 1 falls silent, node 2 pauses for less than three intervals, node 3
    # is silent in the middle and comes back, node 4 is not watched.
    sent = [(1, 0), (2, 0), (3, 0), (4, 0), (2, 2_000), (3, 20_000), (2, 4_900), (2, 7_700), (2, 10_500), (2, 13_300),
            (2, 16_000), (2, 18_900), (2, 20_000), (2, 22_000), (3, 22_000), (2, 23_000), (3, 23_000)]
    sent.sort(key=lambda s: s[1])
    schema = "mesh_id string, node_id long, time timestamp"
    write_in_pieces(spark, [("m", n, moment(s)) for n, s in sent], schema, source, pieces=len(sent))
    devices = spark.createDataFrame([("m", n, i) for n, i in ((1, 1000), (2, 1000), (3, 1000), (4, None))], "mesh_id string, device_id long, publish_interval_seconds int")
    run(keyed.absence_stream(stream_of(spark, schema, source), devices), out, str(tmp_path / "cp"))
    got = sorted((r["device_id"], r["detector"], r["channel"], r["triggered_at"].replace(tzinfo=timezone.utc)) for r in spark.read.parquet(out).collect())
    assert got == [(1, "absence", None, moment(3000)), (3, "absence", None, moment(3000))]


def envelope(i):
    gateway = ("!g1", "!g2", "!gone")[i % 3]
    return (gateway, "LF", i % 5, i, BASE + i, 1, 67, "env", '{"env": {"t": %d}}' % i, True)


def changes(spark):
    return spark.createDataFrame(
        [
            ("gateway_key", "!g1", "m1", None, "upsert", 1),
            ("gateway_key", "!g2", "m2", None, "upsert", 2),
            ("gateway_key", "!gone", "m3", None, "upsert", 3),
            ("gateway_key", "!gone", "m3", None, "delete", 4),
            ("node_rejection", "m1:3", "m1", 3, "upsert", 5),
            ("node_rejection", "m2:4", "m2", 4, "upsert", 6),
            ("node_rejection", "m2:4", "m2", 4, "delete", 7),
        ],
        "kind string, key string, mesh_id string, device_id long, op string, version long",
    )


def test_ingest_over_batches_and_replay(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [envelope(i) for i in range(60)]
    batch = write_in_pieces(spark, rows, schemas.ENVELOPE, source, 4)
    load = ingest.config_from_changes(lambda s: changes(s))
    ingest.start_ingest(stream_of(spark, schemas.ENVELOPE, source), load, root, str(tmp_path / "cp")).awaitTermination()
    gateways, rejections = load(spark)
    gated = K.gate(batch, gateways, rejections)
    paths = ingest.IngestPaths(root)
    for name, expected in ingest.kinds_of(gated).items():
        stored = spark.read.parquet(getattr(paths, name))
        assert stored.count() == expected.count() > 0, name
    points = P.event_points(K.decoded(gated))
    assert store.read_points(spark, paths.points).count() == points.count()
    # The last batch again, under its own number: nothing is doubled.
    before = spark.read.parquet(paths.points).count()
    last = spark.read.parquet(paths.decoded).agg(F.max("ingest_batch")).first()[0]
    files = spark.read.schema(schemas.ENVELOPE).parquet(source)
    ids = spark.read.parquet(paths.decoded).where(f"ingest_batch = {last}").select("packet_id")
    dropped = spark.read.parquet(paths.drops).where(f"ingest_batch = {last}").select("packet_id")
    replay = files.join(ids.union(dropped), "packet_id", "left_semi").select(*batch.columns)
    replay = spark.createDataFrame(replay.collect(), schemas.ENVELOPE)
    ingest.write_ingest(replay, last, gateways, rejections, paths)
    assert spark.read.parquet(paths.points).count() == before


def test_unreadable_payloads_are_told(spark, tmp_path):
    rows = [envelope(0), (*envelope(1)[:-2], '{"a":' * 1_500 + "1" + "}" * 1_500, True), (*envelope(4)[:-2], "{oops", True), envelope(7)]
    gateways, rejections = spark.createDataFrame([("!g1", "m"), ("!g2", "m")], "gateway_id string, mesh_id string"), spark.createDataFrame([], "mesh_id string, device_id long")
    ingest.write_ingest(spark.createDataFrame(rows, schemas.ENVELOPE), 0, gateways, rejections, ingest.IngestPaths(str(tmp_path)))
    read = lambda name, schema: ingest.read_table(spark, str(tmp_path), name, schema)
    told = read("unreadable", f"{schemas.DECODED}, reject_reason string")
    assert {(r["packet_id"], r["reject_reason"]) for r in told.collect()} == {(1, "unreadable_payload"), (4, "unreadable_payload")}
    assert read("decoded", schemas.DECODED).count() == 4


def test_point_writer_takes_events_and_alarms(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "points")
    events = spark.createDataFrame([(1, 1, 67, BASE, 1, "LF", "!g", "m", "telemetry:e", '{"e": {"t": 1}}')], schemas.DECODED)
    alarms = spark.createDataFrame([("m", 1, "e.t", "flat_value", "stream", 1.0, "x", moment(0))], schemas.ALARM)
    feed = P.mixed_feed(events, alarms)
    feed.coalesce(1).write.parquet(source)
    ingest.start_point_writer(
        spark.readStream.schema(feed.schema).parquet(source), path, str(tmp_path / "cp"), None
    ).awaitTermination()
    got = sorted((r["measurement"], r["field"]) for r in store.read_points(spark, path).collect())
    assert got == [("alarms", "message"), ("alarms", "value"), ("e", "packet_id"), ("e", "t"), ("e", "timestamp_quality")]


def test_dead_letters(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "dead")
    source.mkdir()
    (source / "a.txt").write_text('{"node_id": 1}\n{oops\nnull\n')
    lines = spark.readStream.format("text").load(str(source))
    parsed = feeds.parse_events(lines, schemas.DECODED)
    runtime.run_until_caught_up(parsed, ingest.dead_letter_writer(out), str(tmp_path / "cp"))
    assert [(r["raw"], r["reject_reason"]) for r in spark.read.parquet(out).collect()] == [("{oops", "not_json")]


def test_bus_options():
    options = feeds.bus_options("b:1", "raw", feeds.LATEST, feeds.DECODER_BATCH)
    assert options["startingOffsets"] == "latest" and options["maxOffsetsPerTrigger"] == "100"
    assert options["failOnDataLoss"] == "true"


def test_shared_folder():
    from types import SimpleNamespace

    from sensorloom.session import shared_folder

    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("yarn", spark_checkpoint_dir="hdfs:/x/")) == "hdfs:/x"
    with pytest.raises(ValueError):
        shared_folder(session("yarn"))


def test_late_and_reordered_readings(spark, tmp_path):
    """Runs are those of the readings in time order; what is behind the watermark is told apart."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    lots = [
        [(0, 1.0), (40, 1.0), (20, 1.0), (10, 1.0)],
        [(30, 1.0), (100, 2.0), (50, 1.0)],  # the fifth equal one comes before and the sixth after what was read
        [(200, 3.0), (95, 1.0), (30.5, 9.0)],  # one is behind the watermark of 40
        [(400, 3.0)], [(401, 3.0)],
    ]
    n = 0
    for lot in lots:
        rows = [("m", 1, "x", v, moment(s), n + i) for i, (s, v) in enumerate(lot)]
        n += len(rows)
        spark.createDataFrame(rows, READING).coalesce(1).write.mode("append").parquet(source)
        run(keyed.ordered_stuck_value_stream(stream_of(spark, READING, source), 5, 60, 1000), out, str(tmp_path / "cp"))
    got = sorted((r["is_late"], r["triggered_at"].replace(tzinfo=timezone.utc), r["value"]) for r in spark.read.parquet(out).collect())
    assert got == [(False, moment(40), 1.0), (False, moment(50), 1.0), (False, moment(95), 1.0), (True, moment(30.5), 9.0)]


def test_absence_starts_from_the_store(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "mesh_id string, node_id long, time timestamp"
    sent = [(2, 5_000), (3, 5_000), (2, 7_900), (3, 7_000), (2, 10_800), (2, 13_700), (2, 14_000)]
    write_in_pieces(spark, [("m", n, moment(s)) for n, s in sent], schema, source, pieces=len(sent))
    devices = spark.createDataFrame([("m", n, 1000) for n in (1, 2, 3, 4)], "mesh_id string, device_id long, publish_interval_seconds int")
    # Node 1 was last heard by the store, node 2 goes on, node 3 falls silent later, node 4 was never heard.
    seen = spark.createDataFrame([("m", 1, moment(4_000)), ("m", 2, moment(4_500)), ("m", 3, moment(4_200))], "mesh_id string, node_id long, last_time timestamp")
    run(keyed.absence_stream(stream_of(spark, schema, source), devices, last_seen=seen), out, str(tmp_path / "cp"))
    got = sorted((r["device_id"], r["triggered_at"].replace(tzinfo=timezone.utc)) for r in spark.read.parquet(out).collect())
    assert got == [(1, moment(7_000)), (3, moment(10_000))]


def test_settled_points_are_stored_once(spark, tmp_path):
    """Copies come in the same batch and in later ones; the last to arrive is stored."""
    source, path = str(tmp_path / "in"), str(tmp_path / "points")
    schema = f"{schemas.DECODED}, arrival long"

    def event(seconds, value, arrival):
        return (1, 5, 67, BASE + seconds, 1, "LF", "!g", "m", "telemetry:e", '{"e": {"t": %s}}' % value, arrival)

    lots = [[event(0, 1, 1), event(0, 2, 2), event(60, 5, 3)], [event(0, 3, 4), event(60, 4, 0)], [event(9_000, 0, 5)], [event(9_001, 0, 6)]]
    for lot in lots:
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.start_settled_point_writer(stream_of(spark, schema, source), path, str(tmp_path / "cp"), None, 3_600).awaitTermination()
    got = sorted((r["time"].replace(tzinfo=timezone.utc), r["value"]) for r in store.read_points(spark, path, deduplicate=False).where("field = 't'").collect())
    assert got == [(moment(0), 3.0), (moment(60), 5.0)]


def test_readings_of_a_key_enter_and_leave_state_together():
    """A batch of a key's readings costs a few calls of the state, however many they are; copies count once."""
    calls, given = [], []

    class Held:
        def __init__(self, kept):
            self.kept = kept

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("put", "update"):
                    self.kept = args[0]
                elif name == "appendList":
                    self.kept = [*(self.kept or []), *args[0]]
                elif name == "clear":
                    self.kept = None
                return self.kept if name == "get" else None

            return call

    class Handle(Held):
        def __getattr__(self, name):
            return (lambda *_: Held(None)) if name.startswith("get") else (lambda *args: given.append((name, *args)))

    class Mark:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    runs, key = keyed.OrderedRuns(3, 0), ("m", 1, "value")
    runs.init(Handle(None))
    at = lambda s: datetime.fromtimestamp(s, timezone.utc)
    rows = [{"time": at(1000 - i), "packet_id": i, "value": 7.0} for i in range(200)]
    assert list(runs.handleInputRows(key, iter([*rows, *rows[:50]]), Mark(0))) == []
    found = list(runs.handleExpiredTimer(key, Mark(900_000), None))
    assert [r.triggered_at for r in found] == [at(s) for s in range(803, 901)]
    assert len(runs.waiting.kept) == 100 and given[-1] == ("registerTimer", 901_000)
    assert [r.is_late for r in runs.handleInputRows(key, iter(rows[150:151]), Mark(900_000))] == [True]
    assert len(calls) < 10


def test_detection_parses_payloads_once(spark, tmp_path, monkeypatch):
    """Of the two detection queries each takes readings out of its packets once a micro-batch."""
    from sensorloom.streaming import jobs

    seen, real = spark.sparkContext.accumulator(0), K.observations

    def counted(value):
        seen.add(1)
        return value

    number = F.udf(counted, "double").asNondeterministic()
    monkeypatch.setattr(jobs.packets, "observations", lambda *a, **k: real(*a, **k).withColumn("value", number("value")))
    source, schema = str(tmp_path / "in"), "mesh_id string, node_id long, packet_id long, rx_time long, payload string"
    rows = [("m", i % 2, i, BASE + i, '{"m": {"value": 5}}') for i in range(40)]
    spark.createDataFrame(rows, schema).write.parquet(source)
    rules = spark.createDataFrame([], schemas.RULE_CHANGE)
    for job in jobs.start_detection(spark.readStream.schema(schema).parquet(source), lambda _: rules, str(tmp_path / "out"), partitions=4):
        job.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/stuck_value")).count() == 2 * (20 - detect.FLAT_DEFAULT + 1)
    assert seen.value == 2 * len(rows)
