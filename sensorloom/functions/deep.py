"""Payloads whose objects nest deeper than the expressions of `jsonvalues` unroll.

Those expressions cover usual payloads inside the engine. The few that go
deeper are walked here, in Arrow batches; all other rows pass a null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

LEAF = T.ArrayType(T.StructType().add("top", "string").add("key", "string").add("value", "double"))


def _parsed(text: str | None) -> dict | None:
    """The object a text holds; None for other text and beyond the parser's own depth."""
    try:
        found = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _is_number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def leaves_of(root: dict) -> Iterator[tuple[str | None, str, float]]:
    """(top, key, value) of every number, with a stack instead of recursion."""
    waiting = [(None, root)]
    while waiting:
        top, inner = waiting.pop()
        for key, value in inner.items():
            if isinstance(value, dict):
                waiting.append((key if top is None else top, value))
            elif _is_number(value):
                yield top, key, float(value)


def number_text(value: float) -> str:
    """A double as the engine writes it: plain from 0.001 up to ten million, else with an exponent."""
    if value == 0 or not math.isfinite(value) or 1e-3 <= abs(value) < 1e7:
        return repr(value)
    sign, digits, power = Decimal(repr(value)).normalize().as_tuple()
    figures = "".join(map(str, digits))
    return f"{'-' if sign else ''}{figures[0]}.{figures[1:] or '0'}E{power + len(figures) - 1}"


def text_of(root: dict) -> str:
    """JSON of an object, with a stack instead of recursion."""
    out: list[str] = []
    waiting: list = [("value", root)]
    while waiting:
        kind, item = waiting.pop()
        if kind == "text":
            out.append(item)
        elif isinstance(item, (dict, list)):
            parts = [(f"{json.dumps(k, ensure_ascii=False)}:", v) for k, v in item.items()] if isinstance(item, dict) else [("", v) for v in item]
            opens, closes = "{}" if isinstance(item, dict) else "[]"
            waiting.append(("text", closes))
            for i in range(len(parts) - 1, -1, -1):
                waiting.append(("value", parts[i][1]))
                waiting.append(("text", ("," if i else opens) + parts[i][0]))
            if not parts:
                out.append(opens)
        elif isinstance(item, float):
            out.append(number_text(item))
        else:
            out.append(json.dumps(item, ensure_ascii=False))
    return "".join(out)


def curve_value(value: float, curve: dict) -> float:
    """`calibration.apply_curve` for one number."""
    name, points = curve["function_name"], curve["points"]
    if name == "offset_scale" and curve["scale"] is not None and curve["offset"] is not None:
        return value * curve["scale"] + curve["offset"]
    if name == "lookup_table" and points is not None and len(points):
        xs, ys = [p["x"] for p in points], [p["y"] for p in points]
        if value <= xs[0] or len(xs) == 1:
            return ys[0]
        if value >= xs[-1]:
            return ys[-1]
        right = int(np.searchsorted(xs, value, side="left"))
        low, high = right - 1, right
        return ys[low] + (value - xs[low]) / (xs[high] - xs[low]) * (ys[high] - ys[low])
    return value


@F.pandas_udf(LEAF)
def deep_leaves(payloads: pd.Series) -> pd.Series:
    def walk(text: str | None) -> list | None:
        root = _parsed(text)
        return None if root is None else [{"top": t, "key": k, "value": v} for t, k, v in leaves_of(root)]

    return payloads.map(walk)


@F.pandas_udf(T.StringType())
def deep_calibrated(payloads: pd.Series, curves: pd.Series) -> pd.Series:
    def rewrite(text: str | None, by_name: dict | None) -> str | None:
        root = _parsed(text)
        if root is None or by_name is None:
            return None
        by_name = dict(by_name)
        waiting = [root]
        while waiting:
            inner = waiting.pop()
            for key, value in inner.items():
                if isinstance(value, dict):
                    waiting.append(value)
                elif _is_number(value) and by_name.get(key) is not None:
                    inner[key] = curve_value(float(value), by_name[key])
        return text_of(root)

    return pd.Series([rewrite(t, c) for t, c in zip(payloads, curves)], dtype=object)
