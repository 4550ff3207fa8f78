"""Argument checks, made before any plan is built."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


TRUE_VALUES = (True, 1, "1", "true", "True", "yes")  # fixed values: what counts as true
NAMES = re.compile(r"[^,\s](?:[^,]*[^,\s])?")


def parsed(value: Any, kind: type, default: Any = None) -> Any:
    """A parameter as saved reports write it, typed: numbers may be text, lists comma-separated text; blank is the default."""
    if value is None or value == "":
        return [] if kind is list else default
    if kind is bool:
        return value in TRUE_VALUES
    if kind is list:
        return NAMES.findall(value) if isinstance(value, str) else [str(item) for item in value]
    return kind(float(value))


def as_int(value: Any, default: int) -> int:
    return parsed(value, int, default)


def as_float(value: Any, default: float) -> float:
    return parsed(value, float, default)


def as_flag(value: Any) -> bool:
    return parsed(value, bool, False)


def name_list(value: str | Iterable[Any] | None) -> list[str]:
    return parsed(value, list)


def event_names(value: str | Sequence[Any], what: str, least: int, most: int) -> list[str]:
    names = name_list(value)
    if not least <= len(names) <= most:
        raise ValueError(f"{what} needs {least} to {most} event names, got {len(names)}")
    return names


def funnel_steps(value: str | Sequence[Any]) -> list[str]:
    return event_names(value, "steps", 2, 6)


def required_text(value: Any, what: str) -> str:
    text = str(value or "").strip()
    if not text:
        raise ValueError(f"{what} is required")
    return text


def known_property(name: str, properties: Sequence[str]) -> str:
    if name not in properties:
        raise ValueError(f"unknown user property {name!r}; known: {list(properties)}")
    return name


def profile_condition(filters: Mapping[str, Any] | None, properties: Sequence[str]) -> Column | None:
    """AND of equalities on profile properties, or None without filters."""
    condition = None
    for name, value in (filters or {}).items():
        test = F.col(known_property(name, properties)) == F.lit(str(value))
        condition = test if condition is None else condition & test
    return condition


def path_ends(start: Any, end: Any) -> tuple[str, str]:
    first, last = required_text(start, "start_event"), required_text(end, "end_event")
    if first == last:
        raise ValueError("start_event and end_event must differ")
    return first, last
