"""Algorithms that blueprint steps may name.

An algorithm maps input columns to output columns. Where it cannot compute a
row it yields null, which drops the row from that step only. The formulas are
textbook ones; the set is open to additions through `register`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import windowed

POINTWISE, WINDOWED = "pointwise", "windowed"
INHERIT = "inherit:"

# Parameters are those of one step, or a column of maps of texts where the steps
# are data; `number` reads both.
Params = Mapping[str, object] | Column
Formula = Callable[[Mapping[str, Column], Params], dict[str, Column]]
# Rows, input columns, parameters, the columns that name a series, and the width
# of its slices in seconds, to the same rows with `result`, a map from output to value.
Over = Callable[[DataFrame, Mapping[str, Column], Params, Sequence[str], int], DataFrame]


def number(params: Params, name: str, default: float | None = None) -> Column:
    """A parameter; without a default a missing one can't be computed with."""
    if not isinstance(params, Column):
        return F.lit(float(params[name] if default is None else params.get(name, default)))
    given = F.try_element_at(params, F.lit(name)).try_cast("double")
    return given if default is None else F.when(F.map_contains_key(params, name), given).otherwise(float(default))


@dataclass(frozen=True)
class Algorithm:
    name: str
    inputs: tuple[str, ...]
    output_units: Mapping[str, str | None]
    formula: Formula
    mode: str = POINTWISE
    required_params: tuple[str, ...] = field(default=())
    # What a windowed algorithm does; its rows have `time` and `packet_id`, which order a series.
    over: Over | None = None

    def call(self, inputs: Mapping[str, Column], params: Params) -> dict[str, Column]:
        return self.formula(inputs, params)

    def unit_for(self, output: str, input_units: Mapping[str, str | None]) -> str | None:
        unit = self.output_units.get(output)
        if unit and unit.startswith(INHERIT):
            return input_units.get(unit.removeprefix(INHERIT))
        return unit

    def as_dict(self) -> dict:
        return {
            "name": self.name,
            "mode": self.mode,
            "inputs": list(self.inputs),
            "outputs": list(self.output_units),
            "required_params": list(self.required_params),
        }


REGISTRY: dict[str, Algorithm] = {}


def register(algorithm: Algorithm) -> Algorithm:
    REGISTRY[algorithm.name] = algorithm
    return algorithm


def get(name: str) -> Algorithm | None:
    return REGISTRY.get(name)


def discover() -> list[dict]:
    return [REGISTRY[name].as_dict() for name in sorted(REGISTRY)]


def validate_step(function_name: str, inputs: Mapping | None, params: Mapping | None) -> list[str]:
    algorithm = get(function_name)
    if algorithm is None:
        return [f"unknown function {function_name!r}"]
    problems = [f"input {name!r} is not bound" for name in algorithm.inputs if not (inputs or {}).get(name)]
    problems += [f"parameter {name!r} is missing" for name in algorithm.required_params if name not in (params or {})]
    return problems


def _divide(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom, F.lit(0.0))


def _linear(x, p):
    return {"value": x["value"] * number(p, "scale", 1.0) + number(p, "offset", 0.0)}


def _ratio(x, p):
    return {"ratio": _divide(x["numerator"], x["denominator"])}


def _difference(x, p):
    return {"difference": x["minuend"] - x["subtrahend"]}


def _dew_point(x, p):
    # Magnus formula over water, constants of Alduchov and Eskridge (1996).
    a, b = 17.625, 243.04
    share = F.when((x["humidity"] > 0) & (x["humidity"] <= 100), x["humidity"] / 100)
    gamma = F.ln(share) + a * x["temperature"] / (b + x["temperature"])
    return {"dew_point": b * gamma / (a - gamma)}


def _ppb_to_mass(x, p):
    # Ideal gas: micrograms per cubic metre at the given temperature and
    # pressure; 8.314462618 J/(mol K), 101325 Pa unless stated.
    kelvin = x["temperature"] + 273.15
    pressure = number(p, "pressure_pa", 101325.0)
    moles = pressure / 8.314462618 / F.when(kelvin > 0, kelvin)
    return {"mass": x["ppb"] * number(p, "molar_mass_g") * moles / 1000}


register(Algorithm("linear", ("value",), {"value": INHERIT + "value"}, _linear))
register(Algorithm("ratio", ("numerator", "denominator"), {"ratio": "ratio"}, _ratio))
register(Algorithm("difference", ("minuend", "subtrahend"), {"difference": INHERIT + "minuend"}, _difference))
register(Algorithm("dew_point", ("temperature", "humidity"), {"dew_point": "degC"}, _dew_point))
register(
    Algorithm("ppb_to_ugm3", ("ppb", "temperature"), {"mass": "ug/m3"}, _ppb_to_mass, required_params=("molar_mass_g",))
)


def _windowed(name: str, output: str, unit: str | None, required: tuple[str, ...], run: Callable[..., DataFrame]) -> None:
    def over(rows, x, p, keys, width):
        made = run(rows.withColumn("_value", x["value"]), p, keys, {"value": "_value", "into": "_result", "width_seconds": width})
        return made.withColumn("result", F.create_map(F.lit(output), F.col("_result"))).drop("_value", "_result")

    none = lambda x, p: {output: F.lit(None).cast("double")}
    register(Algorithm(name, ("value",), {output: unit}, none, WINDOWED, required, over))


_TIES = ("packet_id",)
_windowed(
    "rolling_mean", "mean", INHERIT + "value", ("seconds",),
    lambda rows, p, keys, how: windowed.rolling_mean(rows, keys, number(p, "seconds"), **how),
)
_windowed(
    "exponential_smoothing", "smoothed", INHERIT + "value", ("alpha",),
    lambda rows, p, keys, how: windowed.exponential_smoothing(rows, keys, number(p, "alpha"), order=_TIES, **how),
)
_windowed("rate_of_change", "rate", None, (), lambda rows, p, keys, how: windowed.rate_of_change(rows, keys, order=_TIES, **how))
