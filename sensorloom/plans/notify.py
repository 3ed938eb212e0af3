"""Alarm notifications: routing, then cool-down (J-10, T-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cooldown import COOLDOWN_SECONDS, cool_down
from ..operators.registry import route_alarms


def notifications(
    alarms: DataFrame,
    devices: DataFrame,
    meshes: DataFrame,
    owners: DataFrame,
    cooldown_seconds: int = COOLDOWN_SECONDS,
) -> DataFrame:
    """Alarms to send. Routing comes first: an alarm nobody would get does not
    start a cool-down."""
    return cool_down(route_alarms(alarms, devices, meshes, owners), cooldown_seconds=cooldown_seconds)
