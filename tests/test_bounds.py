from datetime import datetime, timezone

import pytest

from sensorloom.functions import bounds as B

NOW = datetime(2024, 3, 31, 12, 0, 0, 500_000, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "text, seconds",
    [("-7d", 604800), ("24h", 86400), ("90s", 90), ("5m", 300), ("2w", 1209600), ("1mo", 2592000), ("1y", 31536000), ("999ms", 0)],
)
def test_duration_seconds(text, seconds):
    assert B.duration_seconds(text) == seconds


@pytest.mark.parametrize("text", ["", None, "7", "d", "1.5h", "7 d", "--7d", "2024-01-01", "now()", "7d\n"])
def test_malformed_durations(text):
    with pytest.raises(ValueError):
        B.parse_duration(text)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("now()", NOW),
        ("-1h", datetime(2024, 3, 31, 11, 0, 0, 500_000, tzinfo=timezone.utc)),
        ("-1mo", datetime(2024, 2, 29, 12, 0, 0, 500_000, tzinfo=timezone.utc)),
        ("2026-09-01", datetime(2026, 9, 1, tzinfo=timezone.utc)),
        ("2026-09-01T13:45", datetime(2026, 9, 1, 13, 45, tzinfo=timezone.utc)),
        ("2026-09-01 13:45:10.75Z", datetime(2026, 9, 1, 13, 45, 10, tzinfo=timezone.utc)),
        (" 2026-09-01T13:45:00+0200 ", datetime(2026, 9, 1, 11, 45, tzinfo=timezone.utc)),
        ("2026-01-01 00:15-05:30", datetime(2026, 1, 1, 5, 45, tzinfo=timezone.utc)),
        ("2026-01-01T00:15:59+01:00", datetime(2025, 12, 31, 23, 15, 59, tzinfo=timezone.utc)),
    ],
)
def test_bounds(text, expected):
    assert B.resolve_bound(text, NOW) == expected


@pytest.mark.parametrize("text", ["", None, "yesterday", "2026-13-01", "2026-9-1", "now", "2026-09-01T25:00", "2026-09-01T12", "2026-09-01T12:00:00.", "2026-09-01T12:00+2", "2026-09-01T12:00+02:0", "2026-09-01x12:00", "２026-09-01", "2026-02-30"])
def test_malformed_bounds(text):
    with pytest.raises(ValueError):
        B.resolve_bound(text, NOW)


def test_windows_and_aggregates():
    assert B.parse_window("2mo").months == 2
    for text in ("-6h", "0s", "6"):
        with pytest.raises(ValueError):
            B.parse_window(text)
    with pytest.raises(ValueError):
        B.parse_aggregate("median")
    with pytest.raises(ValueError):
        B.parse_identifier('a"b', "field")
