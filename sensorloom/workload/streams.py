"""Sinks written and read back, and the streaming jobs run to their end.

Every job reads the whole events file as its source and writes to the shared
folder; nothing is gathered in memory.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from .. import schemas
from ..operators import detect as D, packets as K, points as P
from ..plans import notify
from ..session import shared_folder
from ..sources import feeds, store
from ..streaming import ingest, jobs, keyed, runtime
from . import health
from .registry import query
from .tables import AS_OF, Tables, stamp, with_views


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid4().hex}"


def _event_stream(t: Tables):
    raw = (
        t.spark.readStream.schema(t.raw("events").schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", "1")
        .parquet(t.folder)
    )
    return t.shape_events(raw)


_RECORD = """CASE k % 10 WHEN 0 THEN '{"node_id": ' WHEN 1 THEN 'null' WHEN 2 THEN '[1, 2]' WHEN 3 THEN '{"node_id": "abc"}'
    ELSE '{"node_id": ' || event_id || ', "rx_time": ' || es || '}' END"""


@query(
    "s03_t09_json_feed",
    with_views(
        f"""SELECT CASE WHEN reason IS NULL THEN event_id END::VARCHAR AS node_id, CASE WHEN reason IS NOT NULL THEN raw END AS raw, reason AS reject_reason
        FROM (SELECT event_id, {_RECORD} AS raw, CASE k % 10 WHEN 0 THEN 'not_json' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'wrong_type' END AS reason, k FROM ev)
        WHERE k % 10 <> 1""",
        "ev",
    ),
)
def json_feed(t):
    k = F.col("k") % 10
    record = (
        F.when(k == 0, '{"node_id": ')
        .when(k == 1, "null")
        .when(k == 2, "[1, 2]")
        .when(k == 3, '{"node_id": "abc"}')
        .otherwise(F.concat(F.lit('{"node_id": '), "event_id", F.lit(', "rx_time": '), F.unix_seconds("time"), F.lit("}")))
    )
    parsed = feeds.parse_events(t.events().select(record.alias("value")), schemas.DECODED)
    good = feeds.accepted(parsed).select(
        F.col("node_id").cast("string").alias("node_id"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("reject_reason")
    )
    bad = feeds.dead_letters(parsed).select(F.lit(None).cast("string").alias("node_id"), "raw", "reject_reason")
    return good.unionByName(bad)


_STORED = """SELECT DISTINCT mesh_id, node_id, channel_id, gateway_id, measurement, field, at_s,
    CASE WHEN payload_kind = 'nodeinfo' THEN payload END AS tags FROM packet_points"""


@query(
    "s04_points_sink",
    with_views(
        "SELECT measurement, field, count(*) AS points FROM stored GROUP BY measurement, field",
        "packet_points",
        stored=_STORED,
    ),
)
def points_sink(t):
    """Two batches with the same points are stored; each point is read once."""
    path = _folder(t, "points")
    points = P.event_points(t.decoded())
    for batch in (1, 2):
        store.write_points(points, path, batch)
    stored = store.read_points(t.spark, path)
    return stored.groupBy("measurement", "field").agg(F.count(F.lit(1)).alias("points"))


@query(
    "s05_archive_sink",
    with_views(
        """SELECT mesh_id, node_id, '2024-01-31' AS dt, 7 AS hour, count(*) AS events, CAST(sum(packet_id) AS BIGINT) AS packet_ids
        FROM dec GROUP BY mesh_id, node_id""".replace("7 AS hour", "CAST(7 AS BIGINT) AS hour"),
        "dec",
    ),
)
def archive_sink(t):
    path = _folder(t, "archive")
    store.write_archive(K.archive_rows(t.decoded()), path, 1, F.lit("2024-01-31 07:30:00").cast("timestamp"))
    rows = store.read_archive(t.spark, path, ("packet_id",))
    return rows.groupBy("mesh_id", F.col("node_id").cast("bigint").alias("node_id"), F.col("dt").cast("string").alias("dt"), F.col("hour").cast("bigint").alias("hour")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("packet_id").alias("packet_ids")
    )


@query(
    "s09_alarm_sink",
    with_views(
        "SELECT detector, count(*) AS alarms, round(max(value), 6) AS largest FROM alarms GROUP BY detector",
        *health._STAT_VIEWS,
        **health._BOTH,
    ),
)
def alarm_sink(t):
    path = _folder(t, "alarms")
    store.write_rows(health._all_alarms(t), path, 1, ("detector",))
    return t.spark.read.parquet(path).groupBy("detector").agg(F.count(F.lit(1)).alias("alarms"), F.max("value").alias("largest"))


@query(
    "u04_kinds_of_events",
    with_views(
        """SELECT 'decoded' AS kind, count(*) AS events FROM dec UNION ALL
        SELECT 'sightings', count(*) FROM dec WHERE mesh_id IS NOT NULL UNION ALL
        SELECT 'discoveries', count(*) FROM dec WHERE mesh_id IS NOT NULL AND payload_kind LIKE 'telemetry:%' UNION ALL
        SELECT 'drops', count(*) FROM gated WHERE drop_reason IS NOT NULL""",
        "dec",
    ),
)
def kinds_of_events(t):
    return ingest.kind_counts(t.gated())


@query(
    "u02_mixed_feed",
    with_views(
        """SELECT measurement, field, count(*) AS points FROM (SELECT measurement, field FROM packet_points
          UNION ALL SELECT 'alarms', unnest(['message', 'value']) FROM alarms) GROUP BY measurement, field""",
        "packet_points",
        "vals",
        alarms=health._PLAUSIBILITY,
    ),
)
def mixed_feed(t):
    feed = P.mixed_feed(t.decoded(), health.plausibility(t))
    return P.all_points(feed).groupBy("measurement", "field").agg(F.count(F.lit(1)).alias("points"))


@query(
    "t01_s10_stream_ingest",
    with_views(
        """SELECT 'points' AS table_name, measurement AS part, count(*) AS rows FROM stored GROUP BY measurement
        UNION ALL SELECT 'decoded', payload_kind, count(*) FROM dec GROUP BY payload_kind
        UNION ALL SELECT 'sightings', 'upsert', count(*) FROM dec WHERE mesh_id IS NOT NULL
        UNION ALL SELECT 'discoveries', payload_kind, count(*) FROM dec WHERE mesh_id IS NOT NULL AND payload_kind LIKE 'telemetry:%' GROUP BY payload_kind
        UNION ALL SELECT 'drops', drop_reason, count(*) FROM gated WHERE drop_reason IS NOT NULL GROUP BY drop_reason""",
        "packet_points",
        stored=_STORED,
    ),
)
def stream_ingest(t):
    root = _folder(t, "ingest")
    envelopes = t.shape_envelopes(_event_stream(t), t.raw("customer"))
    job = ingest.start_ingest(envelopes, lambda _: (t.gateways(), t.rejections()), root, f"{root}/_checkpoint")
    job.awaitTermination()
    paths = ingest.IngestPaths(root)
    count = F.count(F.lit(1)).alias("rows")
    read = t.spark.read.parquet
    parts = [
        store.read_points(t.spark, paths.points).groupBy(F.lit("points").alias("table_name"), F.col("measurement").alias("part")).agg(count)
    ]
    for name, part in (("decoded", "payload_kind"), ("sightings", "op"), ("discoveries", "payload_kind"), ("drops", "drop_reason")):
        parts.append(read(getattr(paths, name)).groupBy(F.lit(name).alias("table_name"), F.col(part).alias("part")).agg(count))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# Ten days: more than what a batch repeats of the one before.
SETTLED = 864_000


@query(
    "t03_s04_settled_points",
    with_views(
        f"""SELECT measurement, field, count(*) AS points FROM stored
        WHERE at_s <= (SELECT max(at_s) FROM stored) - {SETTLED} GROUP BY measurement, field""",
        "packet_points",
        stored=_STORED,
    ),
)
def settled_points(t):
    """Four micro-batches, each of which repeats half of the one before. Every point
    is stored once, and the store is read as it is."""
    root = _folder(t, "settled")
    raw = t.raw("events")
    day = F.dayofmonth("ts")
    for week in range(4):
        own = (day > 8 * week - 4 * (week > 0)) & (day <= 8 * week + 8 if week < 3 else F.lit(True))
        raw.where(own).withColumn("part", F.lit(week)).write.mode("append").parquet(f"{root}/in")
        events = t.spark.readStream.schema(f"{', '.join(f'{c} {k}' for c, k in raw.dtypes)}, part int").parquet(f"{root}/in")
        envelopes = t.shape_envelopes(t.shape_events(events), t.raw("customer"))
        gated = K.gate(envelopes, t.gateways(), t.rejections()).withColumn(store.ARRIVAL, F.col("packet_id"))
        job = ingest.start_settled_point_writer(K.decoded(gated, store.ARRIVAL), f"{root}/points", f"{root}/_checkpoint", None, SETTLED)
        job.awaitTermination()
    stored = store.read_points(t.spark, f"{root}/points", deduplicate=False)
    return stored.groupBy("measurement", "field").agg(F.count(F.lit(1)).alias("points"))


@query(
    "t05_stream_archive",
    with_views("SELECT mesh_id, node_id, count(*) AS events FROM dec GROUP BY mesh_id, node_id", "dec"),
)
def stream_archive(t):
    """Decoded events of the stream, archived under a fixed writing hour."""
    root = _folder(t, "archive-stream")
    envelopes = t.shape_envelopes(_event_stream(t), t.raw("customer"))
    events = K.decoded(K.gate(envelopes, t.gateways(), t.rejections()))
    job = ingest.start_archive(
        events, f"{root}/archive", f"{root}/_checkpoint", None, F.lit("2024-01-31 07:30:00").cast("timestamp")
    )
    job.awaitTermination()
    rows = store.read_archive(t.spark, f"{root}/archive", ("packet_id",))
    return rows.groupBy("mesh_id", F.col("node_id").cast("bigint").alias("node_id")).agg(F.count(F.lit(1)).alias("events"))


def _stream_points(t: Tables):
    return _event_stream(t).join(t.mesh_of_node(), "user_id").select(
        "mesh_id", F.col("user_id").alias("node_id"), F.lit("value").alias("field"), "value", "time", F.col("event_id").alias("packet_id"),
        F.col("event_type").alias("kind"),
    )


def _collect_stream(t: Tables, name: str, stream):
    root = _folder(t, name)
    runtime.run_until_caught_up(
        stream, lambda batch, number: store.write_rows(batch, f"{root}/out", number), f"{root}/_checkpoint"
    )
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)


@query("t02_stream_stuck_value", health.ORACLE_STUCK)
def stream_stuck_value(t):
    readings = _stream_points(t).withColumn("value", F.floor(F.col("value") / 50).cast("double"))
    return _collect_stream(t, "stuck", keyed.stuck_value_stream(readings))


@query("r01_r02_stream_detection", health.ORACLE_DETECTION)
def stream_detection(t):
    """Both detectors over the stream of packets, in four micro-batches."""
    root = _folder(t, "detection")
    for events in _by_week(t, root):
        for job in jobs.start_detection(_stepped(t, events), lambda _: t.rule_changes(), root):
            job.awaitTermination()
    columns = list(D.ALARM_COLUMNS)
    found = [t.spark.read.parquet(f"{root}/{name}").select(*columns) for name in ("stuck_value", "range_check")]
    return found[0].unionByName(found[1])


def _by_week(t: Tables, root: str):
    """The stream of events as it grows: a week is appended to its source by
    all tasks, and what runs on it meets that week as one micro-batch."""
    raw = t.raw("events")
    of_week = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    for week in range(4):
        raw.where(of_week == week).write.mode("append").parquet(f"{root}/in")
        yield t.shape_events(t.spark.readStream.schema(raw.schema).parquet(f"{root}/in"))


def _stepped(t: Tables, events):
    """Packets with readings in steps of 50."""
    value = (F.floor(F.col("value") / 50) * 50).cast("double")
    return events.join(t.mesh_of_node(), "user_id").select(
        "mesh_id",
        F.col("user_id").alias("node_id"),
        F.col("event_id").alias("packet_id"),
        F.unix_seconds("time").alias("rx_time"),
        F.concat(F.lit('{"m": {"value": '), value, F.lit("}}")).alias("payload"),
    )


_WEEK_OF_PACKET = "least((day(make_timestamp(rx_time * 1000000)) - 1) // 8, 3)"


@query(
    "t01_live_configuration",
    with_views(
        """SELECT 'gate' AS part, batch, COALESCE(reason, 'kept') AS name, count(*) AS rows, CAST(sum(packet_id) AS BIGINT) AS ids FROM live GROUP BY ALL
        UNION ALL
        SELECT 'alarm', batch, 'Value ' || value || ' outside configured range [' || CASE WHEN both_sides THEN '60.0, 120.0]' ELSE 'None, 80.0]' END,
               count(*), CAST(sum(node_id) AS BIGINT)
        FROM (SELECT *, floor(value / 50) * 50 AS value, least((day(time) - 1) // 8, 3) AS week FROM (SELECT node_id, time, value FROM vals))
        JOIN live_rules ON batch = week AND node = node_id WHERE value > CASE WHEN both_sides THEN 120 ELSE 80 END OR both_sides AND value < 60 GROUP BY ALL""".replace(
            "SELECT *, floor(value / 50) * 50 AS value, least", "SELECT node_id, floor(value / 50) * 50 AS value, least"
        ),
        "env",
        "vals",
        "live_gates",
        "live_rules",
        live=f"""SELECT packet_id, w.batch, CASE WHEN g.id IS NULL THEN 'unregistered_gateway' WHEN r.id IS NOT NULL THEN 'rejected_node'
                   WHEN NOT decryptable THEN 'undecryptable' WHEN payload IS NULL THEN 'no_schema' END AS reason
            FROM (SELECT *, {_WEEK_OF_PACKET} AS batch FROM env) w
            LEFT JOIN live_gates g ON g.batch = w.batch AND g.urgent AND printf('!%08x', g.id) = gateway_id
            LEFT JOIN live_gates r ON r.batch = w.batch AND NOT r.urgent AND r.id = node_id AND r.mesh_id = g.mesh_id""",
    ),
)
def live_configuration(t):
    """Gateways, rejections and rules change between four micro-batches. Each
    takes in its week's changes and reads the levels, not the changelog."""
    root = _folder(t, "live")
    feeds_ = {"config": t.weekly_config(), "rules": t.weekly_rules()}
    tables = {"config": ingest.config_table(f"{root}/config"), "rules": jobs.rule_table(f"{root}/rules")}

    def since(name):
        def read(spark, offset):
            found = spark.read.schema(tables[name].schema).parquet(f"{root}/{name}-changes")
            return found if offset is None else found.where(F.col("version") > offset)

        return ingest.LiveTable(tables[name], read)

    for week, events in enumerate(_by_week(t, root)):
        for name, changes in feeds_.items():
            changes.where(F.col("week") == week).drop("week").write.mode("append").parquet(f"{root}/{name}-changes")
        envelopes = t.shape_envelopes(events, t.raw("customer"))
        ingest.start_ingest(envelopes, since("config"), root, f"{root}/_checkpoint").awaitTermination()
        for job in jobs.start_detection(_stepped(t, events), since("rules"), f"{root}/alarms"):
            job.awaitTermination()
    count, batch = F.count(F.lit(1)).alias("rows"), F.col(store.BATCH).alias("batch")
    packets = [
        ingest.read_table(t.spark, root, "decoded", "packet_id bigint").withColumn("name", F.lit("kept")),
        ingest.read_table(t.spark, root, "drops", "packet_id bigint, drop_reason string").withColumnRenamed("drop_reason", "name"),
    ]
    gated = packets[0].unionByName(packets[1]).groupBy(F.lit("gate").alias("part"), batch, "name")
    alarms = t.spark.read.parquet(f"{root}/alarms/range_check").groupBy(F.lit("alarm").alias("part"), batch, F.col("message").alias("name"))
    return gated.agg(count, F.sum("packet_id").alias("ids")).unionByName(alarms.agg(count, F.sum("device_id").alias("ids")))


_TABLES = {"decoded": "packet_id bigint", "points": "packet_id bigint", "sightings": "device_id bigint", "discoveries": "device_id bigint", "drops": "packet_id bigint"}


@query(
    "t04_s10_killed_batch",
    with_views(
        f"""SELECT phase, table_name, count(*) AS rows FROM (
          SELECT 'decoded' AS table_name, rx_time AS s FROM dec UNION ALL
          SELECT 'points', rx_time FROM (SELECT DISTINCT ON (mesh_id, node_id, channel_id, gateway_id, measurement, field, at_s, tags) * FROM (
             SELECT p.*, e.es AS rx_time, CASE WHEN payload_kind = 'nodeinfo' THEN payload END AS tags FROM packet_points p JOIN ev e ON e.event_id = p.packet_id)) UNION ALL
          SELECT 'sightings', rx_time FROM dec WHERE mesh_id IS NOT NULL UNION ALL
          SELECT 'discoveries', rx_time FROM dec WHERE mesh_id IS NOT NULL AND payload_kind LIKE 'telemetry:%' UNION ALL
          SELECT 'drops', rx_time FROM gated WHERE drop_reason IS NOT NULL)
        JOIN (VALUES ('killed', 1), ('replayed', 3)) f(phase, weeks) ON least((day(make_timestamp(s * 1000000)) - 1) // 8, 3) <= weeks GROUP BY ALL""",
        "packet_points",
    ),
)
def killed_batch(t):
    """The second half of the packets is a batch that dies after its second
    table. Readers see the first half of every table, then, when the batch has
    run again, all of it."""
    root = _folder(t, "killed")
    count = lambda phase: [
        ingest.read_table(t.spark, root, name, schema).groupBy(F.lit(phase).alias("phase"), F.lit(name).alias("table_name")).agg(F.count(F.lit(1)).alias("rows"))
        for name, schema in _TABLES.items()
    ]
    def die(table: str, batch: int) -> None:
        if batch == 1 and table == "points":
            raise RuntimeError("killed after its second table")

    for week, events in enumerate(_by_week(t, root)):
        if week in (0, 2):
            continue  # two weeks make a batch
        envelopes = t.shape_envelopes(events, t.raw("customer"))
        job = ingest.start_ingest(envelopes, lambda _: (t.gateways(), t.rejections()), root, f"{root}/_checkpoint", on_written=die)
        try:
            job.awaitTermination()
        except StreamingQueryException:
            # Counted now, as it is to a reader at this moment.
            for rows in count("killed"):
                rows.write.mode("append").parquet(f"{root}/seen")
            ingest.start_ingest(envelopes, lambda _: (t.gateways(), t.rejections()), root, f"{root}/_checkpoint").awaitTermination()
    for rows in count("replayed"):
        rows.write.mode("append").parquet(f"{root}/seen")
    return t.spark.read.parquet(f"{root}/seen")


@query("t06_t07_stream_notifications", health.ORACLE_NOTIFICATIONS)
def stream_notifications(t):
    root = _folder(t, "notifications")
    found = _stream_points(t).withColumn("channel", F.concat_ws(".", "kind", "field"))
    alarms = D.as_alarms(
        found.where((F.col("value") < 0) | (F.col("value") > 200)), "plausibility", F.lit("m"), F.col("time"), F.col("value"), F.col("channel"), source="stream"
    )
    jobs.start_notifications(
        alarms, lambda _: (t.devices(), t.meshes(), t.owners()), f"{root}/sent", f"{root}/_checkpoint"
    ).awaitTermination()
    return t.spark.read.parquet(f"{root}/sent").select("mesh_id", "device_id", "channel", "triggered_at")


@query("t06_stream_cooldown", health.ORACLE_COOLDOWN)
def stream_cooldown(t):
    found = _stream_points(t).where(F.col("value") > 20)
    alarms = D.as_alarms(found, "plausibility", F.lit("high"), F.col("time"), F.col("value"), F.col("field"), source="stream")
    sent = _collect_stream(t, "cooldown", keyed.cool_down_stream(alarms, 86_400))
    return sent.select("mesh_id", "device_id", "channel", "triggered_at")


@query(
    "t08_stream_absence",
    with_views(
        """SELECT mesh_id, device_id, 'absence' AS detector, epoch_us(last) // 1000 + 3 * publish_interval_seconds * 1000 AS deadline_ms
        FROM (SELECT d.mesh_id, d.device_id, publish_interval_seconds, max(time) AS last FROM dev d JOIN vals v ON v.mesh_id = d.mesh_id AND v.node_id = d.device_id
              WHERE publish_interval_seconds > 0 GROUP BY d.mesh_id, d.device_id, publish_interval_seconds)
        WHERE epoch_us(last) // 1000 + 3 * publish_interval_seconds * 1000 <= epoch_ms((SELECT max(ts) FROM events)) - 600000""",
        "dev",
        "vals",
    ),
)
def stream_absence(t):
    """Devices silent for three intervals before the stream's last watermark."""
    stream = keyed.absence_stream(_stream_points(t).select("mesh_id", "node_id", "time"), t.devices())
    found = _collect_stream(t, "absence", stream)
    return found.select("mesh_id", "device_id", "detector", F.unix_millis("triggered_at").alias("deadline_ms"))


LATE = 172_800


@query(
    "t03_reordered_stream",
    with_views(
        f"""SELECT mesh_id, node_id AS device_id, value, {stamp('time')} AS triggered_at FROM (
          SELECT *, count(*) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi FROM coarse
          WINDOW w AS (PARTITION BY mesh_id, node_id ORDER BY time, packet_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
        WHERE n = 5 AND lo = hi AND epoch_us(time) <= (epoch_ms((SELECT max(ts) FROM events)) - {LATE * 1000}) * 1000""",
        "coarse",
    ),
)
def reordered_stream(t):
    """Readings come up to two days late, over micro-batches of six days; runs
    are those of the readings in order, as far as the watermark goes."""
    root = _folder(t, "reordered")
    raw = t.raw("events")
    delay = F.pmod(F.xxhash64("event_id"), F.lit(LATE - 1))
    lot = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) + delay) / (6 * 86_400))
    for number in sorted(r[0] for r in raw.select(lot.alias("lot")).distinct().collect()):  # six lots in a month
        raw.where(lot == number).write.mode("append").parquet(f"{root}/in")
        events = t.shape_events(t.spark.readStream.schema(raw.schema).parquet(f"{root}/in"))
        readings = events.join(t.mesh_of_node(), "user_id").select(
            "mesh_id", F.col("user_id").alias("node_id"), F.lit("value").alias("field"), F.floor(F.col("value") / 50).cast("double").alias("value"),
            "time", F.col("event_id").alias("packet_id"),
        )
        stream = keyed.ordered_stuck_value_stream(readings, late_seconds=LATE)
        runtime.run_until_caught_up(stream, lambda batch, n: store.write_rows(batch, f"{root}/out", n), f"{root}/_checkpoint")
    found = t.spark.read.schema(stream.schema).parquet(f"{root}/out")
    return found.where("not is_late").select("mesh_id", "device_id", "value", "triggered_at")


@query(
    "t08_absence_from_store",
    with_views(
        """SELECT mesh_id, device_id, heard_last, epoch_us(last) // 1000 + 3 * publish_interval_seconds * 1000 AS deadline_ms
        FROM (SELECT d.mesh_id, d.device_id, publish_interval_seconds, max(time) AS last, CASE WHEN day(max(time)) <= 29 THEN 'before' ELSE 'since' END AS heard_last
              FROM dev d JOIN vals v ON v.mesh_id = d.mesh_id AND v.node_id = d.device_id
              WHERE publish_interval_seconds > 0 GROUP BY d.mesh_id, d.device_id, publish_interval_seconds)
        WHERE epoch_us(last) // 1000 + 3 * publish_interval_seconds * 1000 <= epoch_ms((SELECT max(ts) FROM events)) - 600000""",
        "dev",
        "vals",
    ),
)
def absence_from_store(t):
    """The stream has the last days of the month alone; devices that were last heard
    before are known from the stored points."""
    root = _folder(t, "absence-store")
    first = F.dayofmonth("ts") <= 29
    raw = t.raw("events")
    raw.where(~first).write.parquet(f"{root}/in")
    stored = t.shape_events(raw.where(first)).join(t.mesh_of_node(), "user_id")
    last_seen = stored.groupBy("mesh_id", F.col("user_id").alias("node_id")).agg(F.max("time").alias("last_time"))
    events = t.shape_events(t.spark.readStream.schema(raw.schema).parquet(f"{root}/in"))
    packets = events.join(t.mesh_of_node(), "user_id").select("mesh_id", F.col("user_id").alias("node_id"), "time")
    found = _collect_stream(t, "absence-stored", keyed.absence_stream(packets, t.devices(), last_seen=last_seen))
    heard = F.substring("message", 17, 19).cast("timestamp")
    when = F.when(F.dayofmonth(heard) <= 29, "before").otherwise("since")
    return found.select("mesh_id", "device_id", when.alias("heard_last"), F.unix_millis("triggered_at").alias("deadline_ms"))
