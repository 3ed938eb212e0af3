"""Completeness, detectors, alarms and notifications."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import detect as D, points as P, quality as Q, registry as R, sliced
from ..operators.cooldown import cool_down
from ..operators.series import in_range
from ..plans import notify, quality_scan, telemetry
from ..plans.gap_store import GapStore
from ..functions.channels import origin_of, channel_name
from ..session import shared_folder
from .registry import query
from .tables import AS_OF, AS_OF_SQL, stamp, with_views

LOOKBACK = "-30d"
_CH = "mesh_id, node_id, channel"


@query(
    "w02_largest_gap",
    with_views(
        f"""SELECT {_CH}, count(*) AS observed, {stamp('min(time)')} AS first_time, {stamp('max(time)')} AS last_time,
               round(COALESCE(max(gap), 0) / 1e6, 6) AS largest_gap_seconds
        FROM (SELECT *, epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY {_CH} ORDER BY time) AS gap FROM vals)
        GROUP BY {_CH}""",
        "vals",
    ),
)
def largest_gap(t):
    return sliced.gap_summary(t.points(("value",)), ("mesh_id", "node_id", "channel"))


_STATS = {
    "wanted": """SELECT mesh_id, device_id AS node_id, split_part(payload_kind, ':', 2) || '.value' AS channel,
          COALESCE(reading_interval_seconds, default_reading_interval_seconds) AS interval_seconds
        FROM meas JOIN dev USING (mesh_id, device_id) LEFT JOIN var USING (payload_kind)""",
    "gaps": f"""SELECT {_CH}, count(*) AS n, max(gap) / 1e6 AS gap FROM (
          SELECT *, epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY {_CH} ORDER BY time) AS gap FROM vals
          WHERE time >= {AS_OF_SQL} - INTERVAL 30 DAY) GROUP BY {_CH}""",
    "stats": f"""SELECT {_CH}, interval_seconds, COALESCE(n, 0) AS observed,
          greatest(1, 2592000 // interval_seconds) AS expected,
          least(1.0, COALESCE(n, 0) / greatest(1, 2592000 // interval_seconds)::DOUBLE) AS ratio, COALESCE(gap, 0.0) AS gap
        FROM wanted LEFT JOIN gaps USING ({_CH}) WHERE interval_seconds > 0""",
}
_STAT_VIEWS = ("vals", "meas", "var")


def known_channels(t):
    return t.measurements().select(
        "mesh_id", "device_id", "payload_kind",
        channel_name(F.col("payload_kind"), F.col("field_name")).alias("channel"),
        origin_of(F.col("payload_kind")).alias("origin"),
    )


def _run(t):
    channels = known_channels(t)
    return quality_scan.check_completeness(
        t.points(("value",)), channels, t.devices(), t.variants(), AS_OF, LOOKBACK
    )


@query(
    "a05_r06_completeness",
    with_views(
        f"""SELECT {_CH}, CAST(interval_seconds AS BIGINT) AS interval_seconds, observed, CAST(expected AS BIGINT) AS expected,
               round(ratio, 6) AS completeness_ratio, round(gap, 6) AS largest_gap_seconds FROM stats""",
        *_STAT_VIEWS,
        **_STATS,
    ),
)
def completeness(t):
    return _run(t).stats


@query(
    "a05_r06_hourly_scans",
    with_views(
        f"""SELECT scan, {_CH}, observed, round(gap, 6) AS largest_gap_seconds FROM (
          SELECT scan, {_CH}, count(*) AS observed, COALESCE(max(gap) / 1e6, 0.0) AS gap FROM (
            SELECT scan, v.*, epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY scan, {_CH} ORDER BY time) AS gap
            FROM vals v JOIN (VALUES ('first', TIMESTAMP '2024-01-20 09:00:00'), ('an hour later', TIMESTAMP '2024-01-20 10:00:00'),
                                     ('between', TIMESTAMP '2024-01-20 10:20:30')) a(scan, moment)
            ON time >= moment - INTERVAL 7 DAY AND time < moment) GROUP BY ALL)""",
        "vals",
    ),
)
def hourly_scans(t):
    """Three scans of a week's look-back from one store of hourly summaries. Each is
    written down as it was, since the next one adds to the store."""
    root = f"{shared_folder(t.spark)}/gaps-{uuid4().hex}"
    gaps = GapStore(f"{root}/store", lambda spark, start, stop: t.points(("value",)))
    scans = {"first": (9, 0, 0), "an hour later": (10, 0, 0), "between": (10, 20, 30)}
    for name, clock in scans.items():
        stop = datetime(2024, 1, 20, *clock, tzinfo=timezone.utc)
        found = gaps.stats(t.spark, stop - timedelta(days=7), stop)
        found.withColumn("scan", F.lit(name)).write.mode("append").parquet(f"{root}/seen")
    return t.spark.read.parquet(f"{root}/seen").select("scan", "mesh_id", "node_id", "channel", "observed", "largest_gap_seconds")


_ALARM_TEXT = """CASE WHEN ratio < 0.8 THEN printf('Only %d of ~%d expected readings in -30d (%.0f%%) - the device published, but its history has gaps at the configured %ds reading interval',
      observed, CAST(expected AS BIGINT), ratio * 100, CAST(interval_seconds AS BIGINT))
    ELSE printf('Overall completeness is fine but there is a %.0fs hole, over 3x the %ds reading interval', gap, CAST(interval_seconds AS BIGINT)) END"""
_COMPLETENESS_ALARMS = f"""SELECT mesh_id, node_id AS device_id, channel, 'completeness' AS detector, 'batch' AS source,
      round(CASE WHEN ratio < 0.8 THEN ratio ELSE gap END, 6) AS value, {_ALARM_TEXT} AS message, {AS_OF_SQL} AS triggered_at
    FROM stats WHERE ratio < 0.8 OR gap > 3 * interval_seconds"""


@query(
    "r05_r07_completeness_alarms",
    with_views(
        f"SELECT * REPLACE ({stamp('triggered_at')} AS triggered_at) FROM alarms",
        *_STAT_VIEWS,
        **_STATS,
        alarms=_COMPLETENESS_ALARMS,
    ),
)
def completeness_alarms(t):
    return _run(t).alarms


@query(
    "s08_quality_points",
    with_views(
        f"""SELECT mesh_id, node_id, channel AS of_channel, 'quality' AS measurement, field, round(value, 6) AS value FROM (
          UNPIVOT (SELECT {_CH}, ratio::DOUBLE AS completeness_ratio, observed::DOUBLE AS observed, expected::DOUBLE AS expected,
                     gap::DOUBLE AS largest_gap_seconds FROM stats)
          ON completeness_ratio, observed, expected, largest_gap_seconds INTO NAME field VALUE value)""",
        *_STAT_VIEWS,
        **_STATS,
    ),
)
def quality_points(t):
    return _run(t).points.select("mesh_id", "node_id", F.col("tags")["channel"].alias("of_channel"), "measurement", "field", "value")


@query(
    "r08_s09_quality_discoveries",
    with_views(
        """SELECT DISTINCT mesh_id, node_id AS device_id, 'quality' AS payload_kind, f.field, f.unit FROM stats
        CROSS JOIN (VALUES ('completeness_ratio', 'ratio'), ('observed', 'count'), ('expected', 'count'), ('largest_gap_seconds', 's')) f(field, unit)""",
        *_STAT_VIEWS,
        **_STATS,
    ),
)
def quality_discoveries(t):
    rows = _run(t).discoveries.select("mesh_id", "device_id", "payload_kind", "field_units", F.explode("fields").alias("field"))
    return rows.select("mesh_id", "device_id", "payload_kind", "field", F.col("field_units")[F.col("field")].alias("unit"))


@query(
    "a06_channel_quality",
    with_views(
        f"""SELECT {_CH}, round(ratio, 6) AS completeness_ratio, observed::DOUBLE AS observed, expected::DOUBLE AS expected,
               round(gap, 6) AS largest_gap_seconds FROM stats""",
        *_STAT_VIEWS,
        **_STATS,
    ),
)
def channel_quality(t):
    points = _run(t).points
    return telemetry.metrics_by_channel(points, AS_OF, "-1h", "2024-02-01")


_PLAUSIBILITY = """SELECT mesh_id, node_id AS device_id, channel, 'plausibility' AS detector, 'stream' AS source, value,
      'Value ' || value || ' outside configured range [0.0, 200.0]' AS message, time AS triggered_at
    FROM vals WHERE value < 0 OR value > 200"""


@query(
    "r04_plausibility",
    with_views(
        f"SELECT * REPLACE ({stamp('triggered_at')} AS triggered_at, round(value, 6) AS value) FROM alarms",
        "vals",
        alarms=_PLAUSIBILITY,
    ),
)
def plausibility(t):
    return D.plausibility(t.points(("value",)), R.channel_config(t.links(), t.types(), t.variants()))


def _all_alarms(t):
    return _run(t).alarms.unionByName(plausibility(t))


_BOTH = {**_STATS, "alarms": f"{_COMPLETENESS_ALARMS} UNION ALL {_PLAUSIBILITY}"}


@query(
    "p08_alarm_points",
    with_views(
        f"""SELECT mesh_id, device_id AS node_id, detector, channel AS of_channel, source, field, value, value_str, {stamp('triggered_at')} AS time
        FROM (SELECT *, unnest(['message', 'value']) AS field FROM (SELECT * REPLACE (NULL AS value), value AS v FROM alarms))
        CROSS JOIN LATERAL (SELECT CASE WHEN field = 'value' THEN round(v, 6) END AS value, CASE WHEN field = 'message' THEN message END AS value_str) x""".replace(
            "FROM (SELECT * REPLACE (NULL AS value), value AS v FROM alarms)", "FROM (SELECT * EXCLUDE (value), value AS v FROM alarms)"
        ),
        *_STAT_VIEWS,
        **_BOTH,
    ),
)
def alarm_points(t):
    rows = P.alarm_points(_all_alarms(t))
    tag = lambda n: F.col("tags")[n]
    return rows.select(
        "mesh_id", "node_id", tag("detector").alias("detector"), tag("channel").alias("of_channel"), tag("source").alias("source"),
        "field", "value", "value_str", "time",
    )


@query(
    "a07_alarm_counts",
    with_views(
        """SELECT mesh_id, device_id AS node_id, detector, count(*) AS alarms FROM alarms GROUP BY mesh_id, device_id, detector""",
        *_STAT_VIEWS,
        **_BOTH,
    ),
)
def alarm_counts(t):
    return telemetry.metrics_by_detector(P.alarm_points(_all_alarms(t)), AS_OF, "-30d", "2024-02-01")


@query(
    "a08_device_metrics",
    with_views(
        """SELECT mesh_id, node_id, COALESCE(points_ingested, 0) AS points_ingested,
             round(1 - COALESCE(implausible, 0) / NULLIF(COALESCE(points_ingested, 0), 0), 6) AS plausibility_ratio,
             COALESCE(alarms, 0) AS alarms, COALESCE(channels, 0) AS channels, COALESCE(implausible, 0) AS plausibility_alarms
        FROM (SELECT mesh_id, node_id, CAST(sum(observed) AS DOUBLE) AS points_ingested, count(*) AS channels FROM stats GROUP BY mesh_id, node_id)
        FULL OUTER JOIN (SELECT mesh_id, device_id AS node_id, count(*) AS alarms, count_if(detector = 'plausibility')::BIGINT AS implausible
                         FROM alarms GROUP BY mesh_id, device_id) USING (mesh_id, node_id)""",
        *_STAT_VIEWS,
        **_BOTH,
    ),
)
def device_metrics(t):
    run = _run(t)
    alarms = P.alarm_points(run.alarms.unionByName(plausibility(t)))
    rows = telemetry.metrics(run.points.unionByName(alarms), AS_OF, "-30d", "2024-02-01")
    return rows.withColumn(
        "plausibility_alarms", F.coalesce(F.col("alarms_by_detector")["plausibility"], F.lit(0))
    ).drop("alarms_by_detector")


ORACLE_STUCK = with_views(
        f"""SELECT mesh_id, node_id AS device_id, 'value' AS channel, 'stuck_value' AS detector, 'stream' AS source, value,
               printf('Value stuck at %.1f for 5 consecutive readings', value) AS message, {stamp('time')} AS triggered_at
        FROM (SELECT *, count(*) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi FROM coarse
              WINDOW w AS (PARTITION BY mesh_id, node_id ORDER BY time, packet_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
        WHERE n = 5 AND lo = hi""",
        "coarse",
    )


@query("w01_r01_stuck_value", ORACLE_STUCK)
def stuck_value(t):
    return D.stuck_value(t.coarse())


@query(
    "w05_r03_flat_value",
    with_views(
        f"""SELECT mesh_id, node_id AS device_id, channel, 'flat_value' AS detector, 'stream' AS source, value,
               printf('Value stuck at %.1f for %d consecutive readings', value, n) AS message, {stamp('time')} AS triggered_at
        FROM (SELECT *, row_number() OVER (PARTITION BY {_CH}, island ORDER BY time, packet_id) AS position,
                CAST(CASE WHEN reading_interval_seconds IS NULL THEN 5 ELSE greatest(3, least(240, 604800 // reading_interval_seconds)) END AS BIGINT) AS n
              FROM (SELECT *, sum(changed) OVER (PARTITION BY {_CH} ORDER BY time, packet_id) AS island
                    FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY {_CH} ORDER BY time, packet_id) THEN 0 ELSE 1 END AS changed FROM coarse))
              JOIN dev ON dev.device_id = node_id)
        WHERE position >= n""",
        "coarse",
        "dev",
    ).replace("SELECT *, row_number() OVER (PARTITION BY mesh_id, node_id, channel, island", "SELECT *, row_number() OVER (PARTITION BY node_id, channel, island").replace("FROM (SELECT *, sum(changed)", "FROM (SELECT *, sum(changed)").replace("JOIN dev ON dev.device_id = node_id)", "JOIN (SELECT device_id, reading_interval_seconds FROM dev) d ON d.device_id = node_id)"),
)
def flat_value(t):
    intervals = t.devices().select("mesh_id", F.col("device_id").alias("node_id"), F.col("reading_interval_seconds").alias("interval_seconds"))
    return D.flat_value(t.coarse().join(intervals, ["mesh_id", "node_id"]), hours=168.0)


_RULES = """SELECT o_custkey AS node, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 END AS lo, CASE WHEN o_orderkey % 2 = 0 THEN 120.0 ELSE 80.0 END AS hi
    FROM cfg WHERE o_orderkey % 7 <> 0"""


@query(
    "j04_rules",
    with_views(
        "SELECT packet_id, node_id, CAST(lo AS DOUBLE) AS low, CAST(hi AS DOUBLE) AS high FROM vals JOIN rules ON node = node_id",
        "vals",
        "cfg",
        rules=_RULES,
    ),
)
def rules(t):
    rows = t.points(("value",)).withColumn("_rule", F.concat_ws(":", F.col("node_id").cast("string"), "field"))
    return rows.join(D.rules_by_key(t.rule_changes()), "_rule").select("packet_id", "node_id", "low", "high")


@query(
    "r02_range_check",
    with_views(
        f"""SELECT mesh_id, node_id AS device_id, 'value' AS channel, 'range_check' AS detector, 'stream' AS source, round(value, 6) AS value,
               'Value ' || value || ' outside configured range [' || CASE WHEN lo IS NULL THEN 'None' ELSE '1.0' END || ', '
                 || CASE WHEN lo IS NULL THEN '80.0' ELSE '120.0' END || ']' AS message, {stamp('time')} AS triggered_at
        FROM vals JOIN rules ON node = node_id WHERE value < lo OR value > hi""",
        "vals",
        "cfg",
        rules=_RULES,
    ),
)
def range_check(t):
    return D.range_check(t.points(("value",)), t.rule_changes())


# Packets carry whole seconds, so the streaming tier orders and dates readings by them.
ORACLE_DETECTION = with_views(
    f"""SELECT mesh_id, node_id AS device_id, 'value' AS channel, 'stuck_value' AS detector, 'stream' AS source, value,
           printf('Value stuck at %.1f for 5 consecutive readings', value) AS message, {stamp("date_trunc('second', time)")} AS triggered_at
    FROM (SELECT *, count(*) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi FROM steps
          WINDOW w AS (PARTITION BY mesh_id, node_id ORDER BY date_trunc('second', time), packet_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    WHERE n = 5 AND lo = hi
    UNION ALL
    SELECT mesh_id, node_id, 'value', 'range_check', 'stream', round(value, 6),
           'Value ' || value || ' outside configured range [' || CASE WHEN lo IS NULL THEN 'None' ELSE '1.0' END || ', '
             || CASE WHEN lo IS NULL THEN '80.0' ELSE '120.0' END || ']', {stamp("date_trunc('second', time)")}
    FROM steps JOIN rules ON node = node_id WHERE value < lo OR value > hi""",
    "coarse",
    "cfg",
    steps="SELECT * REPLACE (value * 50 AS value) FROM coarse",
    rules=_RULES,
)


@query(
    "t08_absence",
    with_views(
        f"""SELECT mesh_id, device_id, CAST(NULL AS VARCHAR) AS channel, 'absence' AS detector, 'stream' AS source, CAST(NULL AS DOUBLE) AS value,
               printf('No packet for %.0fs, over 3x the %ds publish interval', silence, publish_interval_seconds) AS message,
               {stamp(AS_OF_SQL)} AS triggered_at
        FROM (SELECT d.mesh_id, d.device_id, publish_interval_seconds, epoch_us({AS_OF_SQL}) / 1e6 - max(epoch_us(time)) / 1e6 AS silence
              FROM dev d JOIN vals v ON v.mesh_id = d.mesh_id AND v.node_id = d.device_id WHERE publish_interval_seconds > 0
              GROUP BY d.mesh_id, d.device_id, publish_interval_seconds)
        WHERE silence > 3 * publish_interval_seconds""",
        "dev",
        "vals",
    ),
)
def absence(t):
    last = t.points(("value",)).groupBy("mesh_id", "node_id").agg(F.max("time").alias("last_time"))
    return D.absence(t.devices(), last, AS_OF)


@query(
    "j10_alarm_routing",
    with_views(
        f"""SELECT a.mesh_id, a.device_id, a.channel, detector, {stamp('triggered_at')} AS triggered_at, owner_id, own.name AS owner_name, email,
               COALESCE(d.label, d.name) AS device_label, COALESCE(m.label, m.channel_id) AS mesh_label,
               CASE detector WHEN 'completeness' THEN 'Device readings have gaps' ELSE 'Sensor value is out of range' END AS subject
        FROM alarms a JOIN dev d USING (mesh_id, device_id) JOIN mesh m USING (mesh_id) JOIN own USING (owner_id)
        WHERE is_active AND email IS NOT NULL""",
        *_STAT_VIEWS,
        "mesh",
        "own",
        **_BOTH,
    ),
)
def alarm_routing(t):
    rows = R.route_alarms(_all_alarms(t), t.devices(), t.meshes(), t.owners())
    return rows.drop("source", "value", "message")


_GREEDY = """
    WITH RECURSIVE {views},
    numbered AS (SELECT DISTINCT {keys}, time FROM {source}),
    chain AS (
      SELECT {keys}, min(time) AS time FROM numbered GROUP BY {keys}
      UNION ALL
      SELECT {keys}, time FROM (
        SELECT {ckeys}, min(n.time) AS time FROM chain c JOIN numbered n ON {match} AND n.time >= c.time + INTERVAL {hours} HOUR GROUP BY {ckeys}, c.time)
    )
    SELECT {keys}, {stamp} AS triggered_at FROM chain"""


def _greedy(source: str, hours: int, *views: str) -> str:
    keys = ("mesh_id", "device_id", "channel")
    return _GREEDY.format(
        views=with_views("", *views).strip().removeprefix("WITH "),
        keys=", ".join(keys),
        ckeys=", ".join(f"c.{k}" for k in keys),
        match=" AND ".join(f"n.{k} = c.{k}" for k in keys),
        source=source,
        hours=hours,
        stamp=stamp("time"),
    )


def _implausible(t, threshold: float):
    return t.points(("value",)).where(F.col("value") > threshold)


ORACLE_COOLDOWN = _greedy(
    "(SELECT mesh_id, node_id AS device_id, 'value' AS channel, time FROM vals WHERE value > 20)", 24, "vals"
)


@query("t06_cooldown", ORACLE_COOLDOWN)
def cooldown(t):
    """A day's cool-down over every reading above 20, per device."""
    found = _implausible(t, 20.0).withColumn("channel", F.lit("value"))
    alarms = D.as_alarms(found, "plausibility", F.lit("high"), F.col("time"), F.col("value"), F.col("channel"))
    sent = cool_down(alarms, cooldown_seconds=86_400, slice_cooldowns=3)
    return sent.select("mesh_id", "device_id", "channel", "triggered_at")


ORACLE_NOTIFICATIONS = _greedy(
    """(SELECT mesh_id, device_id, channel, triggered_at AS time FROM alarms JOIN mesh USING (mesh_id) JOIN own USING (owner_id)
        WHERE is_active AND email IS NOT NULL)""",
    1,
    "vals",
    "mesh",
    "own",
).replace("numbered AS", f"alarms AS ({_PLAUSIBILITY}), numbered AS", 1)


@query("j10_t06_notifications", ORACLE_NOTIFICATIONS)
def notifications(t):
    sent = notify.notifications(plausibility(t), t.devices(), t.meshes(), t.owners())
    return sent.select("mesh_id", "device_id", "channel", "triggered_at")
