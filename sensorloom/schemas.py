"""Schemas, as DDL text, of the tables that flow between the jobs."""

from __future__ import annotations

# Parsed radio packets as the bridge delivers them. `payload` is JSON text,
# null where the port has no known schema; `decryptable` is false where the
# mesh key does not open the packet.
ENVELOPE = (
    "gateway_id string, channel_id string, node_id bigint, packet_id bigint, rx_time bigint, "
    "hop_start int, portnum int, variant string, payload string, decryptable boolean"
)

DECODED = (
    "node_id bigint, packet_id bigint, portnum int, rx_time bigint, hop_start int, "
    "channel_id string, gateway_id string, mesh_id string, payload_kind string, payload string"
)

# The archive as it is read: what its files hold, then its folders.
ARCHIVE = (
    "packet_id bigint, portnum int, rx_time bigint, hop_start int, channel_id string, gateway_id string, "
    "payload_kind string, payload_json string, mesh_id string, node_id bigint, dt date, hour int, ingest_batch bigint"
)

ALARM = (
    "mesh_id string, device_id bigint, channel string, detector string, source string, "
    "value double, message string, triggered_at timestamp"
)

SIGHTING = (
    "key string, mesh_id string, device_id bigint, latitude double, longitude double, "
    "name string, short_name string, hardware_type string, role string, seen_at timestamp, op string"
)

DISCOVERY = (
    "mesh_id string, device_id bigint, payload_kind string, fields array<string>, "
    "field_units map<string,string>, seen_at timestamp, op string"
)

POINT = (
    "mesh_id string, node_id bigint, channel_id string, gateway_id string, measurement string, "
    "field string, channel string, value double, value_str string, value_bool boolean, "
    "value_type string, tags map<string,string>, packet_id bigint, timestamp_quality string, "
    "time timestamp"
)

DEVICE = (
    "id string, device_id bigint, mesh_id string, label string, is_gateway boolean, "
    "is_allowed boolean, postprocessing_blueprint_id string, reading_interval_seconds int, "
    "publish_interval_seconds int, latitude double, longitude double, location_overridden boolean, "
    "name string, short_name string, hardware_type string, role string, "
    "nodeinfo_overridden boolean, last_seen timestamp"
)

BLUEPRINT_STEP = (
    "blueprint_id string, `order` int, function_name string, inputs map<string,string>, "
    "params string, outputs map<string,string>"
)

CALIBRATION_CHANGE = (
    "key string, op string, function_name string, params string, version bigint"
)
RULE_CHANGE = (
    "key string, op string, detector_name string, params string, version bigint"
)

# A merged configuration feed: registered gateways and rejected nodes, told
# apart by `kind`; `version` is the offset in the feed.
CONFIG_CHANGE = (
    "kind string, key string, mesh_id string, device_id bigint, op string, version bigint"
)
