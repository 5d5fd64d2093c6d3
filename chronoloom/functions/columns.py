"""Column expressions for values, calendars, names and configurations."""

from __future__ import annotations

import hashlib
import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of one season by frequency, and the strides between fitted windows.
SEASONS = {"S": 3600, "T": 1440, "H": 24, "D": 1, "W": 1, "M": 12, "B": 5, "Q": 4, "A": 1}
STRIDES = {"S": 127, "T": 127, "H": 127, "B": 27, "D": 27, "W": 11, "M": 5, "Q": 3}
# Default horizons by frequency, and terms as multiples of them.
HORIZONS = {"A": 6, "Q": 8, "M": 12, "W": 8, "B": 21, "D": 30, "H": 48, "T": 48, "S": 60}
HORIZONS_M4 = {"A": 6, "Q": 8, "M": 18, "W": 13, "D": 14, "H": 48}
TERMS = {"short": 1, "medium": 10, "long": 15}
# Seconds of a step of fixed width.
SECONDS = {"S": 1, "T": 60, "H": 3600, "D": 86400, "W": 604800}
_ALIASES = {"MIN": "T", "SEC": "S", "BH": "H", "CBH": "H", "C": "B", "ME": "M", "MS": "M", "BM": "M", "CBM": "M", "SM": "M", "QS": "Q", "QE": "Q", "BQ": "Q", "Y": "A", "YE": "A"}


def parse_frequency(freq: str) -> tuple[int, str]:
    """(multiple, unit) of a frequency such as 15T, H or W-SUN."""
    if not (m := re.match(r"^(\d*)([A-Za-z]+)", freq.strip())):
        raise ValueError(f"no frequency: {freq!r}")
    unit = m[2].upper()
    return int(m[1] or 1), _ALIASES.get(unit, unit if unit in SEASONS else unit[:1])


def seasonality(freq: str) -> int:
    """Steps of one season: the unit's, divided by the multiple where that leaves no rest, else 1."""
    multiple, unit = parse_frequency(freq)
    season = SEASONS[unit]
    return season // multiple if season % multiple == 0 else 1


def stride_for(freq: str) -> int:
    return STRIDES[parse_frequency(freq)[1]]


def horizon_for(freq: str, term: str = "short", m4: bool = False) -> int:
    return (HORIZONS_M4 if m4 else HORIZONS)[parse_frequency(freq)[1]] * TERMS[term]


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def observed(c: Column) -> Column:
    """NaN as null; infinities stay."""
    return F.when(~F.isnan(c), c)


def only_finite(c: Column) -> Column:
    return F.when(finite(c), c)


def kind(c: Column) -> Column:
    """finite, nan (or null), posinf or neginf."""
    return F.when(c.isNull() | F.isnan(c), "nan").when(c == float("inf"), "posinf").when(c == -float("inf"), "neginf").otherwise("finite")


def epoch_seconds(c: Column) -> Column:
    """Whole seconds since 1970 of a time without zone (one with a zone: as shown in the session's)."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def tick(start: Column, freq: str, origin: Column) -> Column:
    """The calendar ordinal of step origin of a series from start, counted in whole steps of freq."""
    multiple, unit = parse_frequency(freq)
    if unit in SECONDS:
        return F.floor(epoch_seconds(start) / (SECONDS[unit] * multiple)).cast("long") + origin
    months = F.year(start) * 12 + F.month(start) - 1 - 1970 * 12
    if unit == "B":
        days = F.datediff(start, F.lit("1970-01-01").cast("date"))
        return (F.floor((days + 3) / 7) * 5 + F.least(F.weekday(start), F.lit(4)) - 3).cast("long") + origin
    return F.floor(months / ({"M": 1, "Q": 3, "A": 12}[unit] * multiple)).cast("long") + origin


def position_time(start: Column, seconds: int, position: Column) -> Column:
    return F.timestamp_add("SECOND", position * seconds, start.cast("timestamp_ntz"))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_")


def parse_time(c: Column) -> Column:
    """The first of the usual formats that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "yyyyMMdd")])


def prediction_scale(largest: Column, most: float = 60000.0) -> Column:
    """The power of ten by which values are divided to fit a 16-bit float; 1 where they fit."""
    return F.when(largest > most, F.pow(F.lit(10.0), F.ceil(F.log10(largest / most)))).otherwise(1.0)


def config_hash(config: dict) -> str:
    """SHA-256 over canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def flatten_config(config: dict, prefix: str = "") -> dict[str, object]:
    flat: dict[str, object] = {}
    for key, value in config.items():
        path = f"{prefix}.{key}" if prefix else key
        flat |= flatten_config(value, path) if isinstance(value, dict) else {path: value}
    return flat


def parse_filters(specs: list[str]) -> dict[str, object]:
    """dotted.path=JSON filters; a value that is no JSON is text."""
    found = {}
    for spec in specs:
        path, given, raw = spec.partition("=")
        if not given or not path:
            raise ValueError(f"a filter is path=value: {spec!r}")
        try:
            found[path] = json.loads(raw)
        except ValueError:
            found[path] = raw
    return found


def matches_filters(config: Column, filters: dict[str, object]) -> Column:
    """Whether a JSON column has each filter's value at its path."""
    test = F.lit(True)
    for path, value in filters.items():
        text = value if isinstance(value, str) else json.dumps(value)
        test = test & F.coalesce(F.get_json_object(config, f"$.{path}") == text, F.lit(value is None))
    return test


def context_limit(h: int, period: int, limit: int) -> int:
    """The retrieval context where none is given: whole periods that hold the horizon, up to limit."""
    return min(limit, period * math.ceil(h / period))
