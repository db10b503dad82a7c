"""Timestamps in mixed notations and zones, made one instant in UTC.

All notations are compiled into one regular expression with named groups. One pass of it over an Arrow batch gives the
components of all texts; the rest is integer arithmetic on whole arrays. Only the text and its zone go to Python, and no
row moves. A zone is a table of its changes of offset, searched once for each local time.
"""

from __future__ import annotations

import datetime as dt
import re
import zoneinfo
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.errors import SchemaError
from tabspark.session import fresh, pinned, quoted

# English month and weekday names, and zone abbreviations with their minutes east of UTC.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["thursday", "friday", "saturday", "sunday", "monday", "tuesday", "wednesday"]  # 1970-01-01 was a Thursday
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "BST": 60, "CET": 60, "CEST": 120, "IST": 330, "JST": 540, "AEST": 600, "AEDT": 660,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
}

# Each {part} becomes a named group; [..] around parts marks what may be left out.
NOTATIONS = [
    "{year}-{month2}-{day2}[{T}{hour2}:{minute}[:{second}[{fraction}]][{zone}]]",
    "{year}{month2}{day2}T{hour2}{minute}{second}[{zone}]",
    "{month1}/{day1}/{year}[ {hour1}:{minute}[:{second}][ {half}][{zone}]]",
    "{day1}.{month1}.{year}[ {hour1}:{minute}[:{second}][{zone}]]",
    "[{weekday}, ]{day1} {name} {year}[ {hour1}:{minute}[:{second}][{zone}]]",
    "{name} {day1}, {year}[ {hour1}:{minute}[:{second}][ {half}][{zone}]]",
    "{seconds}",
    "{millis}",
]
PARTS = {
    "year": r"(?P<year>\d{4})", "month1": r"(?P<month>\d{1,2})", "month2": r"(?P<month>\d{2})", "name": r"(?P<name>[A-Za-z]{3,9})",
    "day1": r"(?P<day>\d{1,2})", "day2": r"(?P<day>\d{2})", "weekday": r"(?P<weekday>[A-Za-z]{3,9})", "T": "[T ]",
    "hour1": r"(?P<hour>\d{1,2})", "hour2": r"(?P<hour>\d{2})", "minute": r"(?P<minute>\d{2})", "second": r"(?P<second>\d{2})",
    "fraction": r"[.,](?P<fraction>\d{1,9})", "half": "(?P<half>[AaPp][Mm])", "seconds": r"(?P<seconds>\d{10})", "millis": r"(?P<millis>\d{13})",
    "zone": r"(?: ?(?P<sign>[+-])(?P<offhour>\d{2})(?::?(?P<offminute>\d{2}))?| ?(?P<zone>[A-Za-z][\w+-]*(?:/[\w+-]+)*)|\[(?P<bracket>[^\]]+)\])",
}
GROUPS = [
    "year", "month", "name", "day", "weekday", "hour", "minute", "second", "fraction", "half", "seconds", "millis",
    "sign", "offhour", "offminute", "zone", "bracket",
]

# What may come of a text, in the order in which it is decided.
STATES = ["ok", "missing", "unreadable", "invalid", "unknown_zone", "twice", "never"]
OK, MISSING, UNREADABLE, INVALID, UNKNOWN_ZONE, TWICE, NEVER = range(len(STATES))
SECOND = 1_000_000
#: The years whose changes of offset are tabled; local times of others ask the zone itself, one by one.
TABLED = (1880, 2110)
PROBE_DAYS = 5


@dataclass(frozen=True)
class TimestampRules:
    """How texts are read: notations, the zone of rows that name none, and what abbreviations mean (minutes)."""

    notations: tuple[str, ...] = tuple(NOTATIONS)
    default_zone: str = "America/Chicago"
    abbreviations: dict[str, int] = field(default_factory=lambda: dict(ABBREVIATIONS))



@dataclass(frozen=True)
class Compiled:
    """One anchored regular expression for all notations, and for each notation the group that holds a component."""

    pattern: str
    groups: tuple[dict[str, str], ...]


@lru_cache(maxsize=16)
def compile_notations(notations: tuple[str, ...]) -> Compiled:
    alternatives, groups = [], []
    for n, notation in enumerate(notations):
        out, own = "", {}
        for token in re.findall(r"\{\w+\}|\[|\]|[^{}\[\]]+", notation):
            if token == "[":
                out += "(?:"
            elif token == "]":
                out += ")?"
            elif token[0] == "{":
                part = PARTS[token[1:-1]]
                for group in re.findall(r"\(\?P<(\w+)>", part):
                    part = part.replace(f"(?P<{group}>", f"(?P<{group}_{n}>")
                    own[group] = f"{group}_{n}"
                out += part
            else:
                out += re.escape(token).replace(r"\ ", " ")
        alternatives.append(out)
        groups.append(own)
    return Compiled(rf"\A(?:{'|'.join(alternatives)})\z", tuple(groups))


def days_from_civil(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of dates of the proleptic Gregorian calendar, by integer steps alone."""
    shifted = year - (month <= 2)
    era = shifted // 400
    in_era = shifted - era * 400
    in_year = (153 * (month + np.where(month > 2, -3, 9)) + 2) // 5 + day - 1
    return era * 146_097 + in_era * 365 + in_era // 4 - in_era // 100 + in_year - 719_468


def month_lengths(year: np.ndarray, month: np.ndarray) -> np.ndarray:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return np.where(month == 2, 28 + leap, np.where(np.isin(month, (4, 6, 9, 11)), 30, 31))


@lru_cache(maxsize=1)
def zone_names() -> frozenset[str]:
    return frozenset(zoneinfo.available_timezones() - {"Factory", "localtime"})


@lru_cache(maxsize=1024)
def zone_table(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, starts, offsets) of the stretches of one offset in a zone, in local seconds: stretch i begins at
    ``starts[i - 1]``, ends before ``ends[i]`` and is ``offsets[i]`` seconds east of UTC.

    Offsets are asked every PROBE_DAYS days; between two that differ the moment of the change is found by halving.
    """
    zone, utc = zoneinfo.ZoneInfo(name), dt.timezone.utc
    origin = dt.datetime(1970, 1, 1, tzinfo=utc)

    def offset(second: int) -> int:
        return int((origin + dt.timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

    first, last = (int((dt.datetime(y, 1, 1, tzinfo=utc) - origin).total_seconds()) for y in TABLED)
    changes, offsets = [], [offset(first)]
    for end in range(first + PROBE_DAYS * 86_400, last, PROBE_DAYS * 86_400):
        now = offset(end)
        if now == offsets[-1]:
            continue
        low, high = end - PROBE_DAYS * 86_400, end
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if offset(middle) == offsets[-1] else (low, middle)
        changes.append(high)
        offsets.append(now)
    at, off = np.array(changes, np.int64), np.array(offsets, np.int64)
    return at + off[:-1], at + off[1:], off


def local_offsets(name: str, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For local seconds in a zone: how often they come (0, 1 or 2), and the offset in seconds where it is once."""
    ends, starts, offsets = zone_table(name)
    begun, over = np.searchsorted(starts, second, "right"), np.searchsorted(ends, second, "right")
    times, offset = begun - over + 1, offsets[begun]
    first, last = (days_from_civil(*(np.array([x]) for x in (y, 1, 1)))[0] * 86_400 for y in (TABLED[0] + 1, TABLED[1] - 1))
    for i in np.flatnonzero((second < first) | (second >= last)):
        zone, wall, fits = zoneinfo.ZoneInfo(name), dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(second[i])), set()
        for fold in (0, 1):
            east = wall.replace(tzinfo=zone, fold=fold).utcoffset()
            try:
                back = (wall - east).replace(tzinfo=dt.timezone.utc).astimezone(zone).replace(tzinfo=None)
            except OverflowError:  # the first or last day that the calendar has
                back = wall
            if back == wall:
                fits.add(int(east.total_seconds()))
        times[i], offset[i] = len(fits), min(fits, default=0)
    return times, offset


def _digits(texts: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers of some rows of an array of digits (0 for an empty text), and how many digits they have."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    start, length = offsets[rows], offsets[rows + 1] - offsets[rows]
    out = np.zeros(len(rows), np.int64)
    for j in range(int(length.max(initial=0))):
        more = length > j
        out[more] = out[more] * 10 + (data[start[more] + j] - 48)
    return out, length


def _numbered(texts: pa.Array, rows: np.ndarray, names: list[str], first: int) -> np.ndarray:
    """The places of names, or of their first three letters, in a list, counted from ``first``; -1 for no such name."""
    known = [*names, *(n[:3] for n in names)]
    at = pc.index_in(pc.ascii_lower(texts.take(pa.array(rows))), pa.array(known)).fill_null(-1).to_numpy()
    return np.where(at < 0, -1, at % len(names) + first)


def resolve(texts: pa.Array, zones: pa.Array | None, rules: TimestampRules) -> tuple[np.ndarray, np.ndarray]:
    """The instants (microseconds) and the places in STATES of what came of each text."""
    compiled = compile_notations(rules.notations)
    whole = pc.utf8_trim(texts.cast(pa.string()), " ")
    empty = pc.fill_null(pc.equal(pc.binary_length(whole), 0), True).to_numpy(zero_copy_only=False)
    found = pc.extract_regex(whole, compiled.pattern)
    state = np.where(empty, MISSING, UNREADABLE)
    value = np.zeros(len(texts), np.int64)
    fits = found.is_valid().to_numpy(zero_copy_only=False) & ~empty
    fields = dict(zip((f.name for f in found.type), found.flatten(), strict=True)) if len(texts) else {}
    named_rows, named_texts = [], []
    for own in compiled.groups if fits.any() else ():
        # A notation's first number is never empty in the texts that it fits.
        leading = fields[own.get("year") or own.get("seconds") or own["millis"]]
        rows = np.flatnonzero(fits & (pc.fill_null(pc.binary_length(leading), 0).to_numpy(zero_copy_only=False) > 0))
        if not len(rows):
            continue
        if "year" not in own:
            value[rows] = _digits(leading, rows)[0] * (SECOND if "seconds" in own else 1000)
            state[rows] = OK
            continue
        zero = np.zeros(len(rows), np.int64)
        part = {g: _digits(fields[own[g]], rows) for g in ("year", "month", "day", "hour", "minute", "second", "fraction", "offhour", "offminute") if g in own}
        number = lambda g: part[g][0] if g in part else zero  # noqa: B023, E731
        month = number("month") if "month" in part else _numbered(fields[own["name"]], rows, MONTHS, 1)
        year, day, hour = number("year"), number("day"), number("hour")
        good = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= month_lengths(year, month))
        days = days_from_civil(year, month, day)
        if "half" in own:
            half = pc.ascii_lower(fields[own["half"]].take(pa.array(rows)))
            has = pc.not_equal(half, "").to_numpy(zero_copy_only=False)
            good &= ~has | ((hour >= 1) & (hour <= 12))
            hour = np.where(has, hour % 12 + 12 * pc.equal(half, "pm").to_numpy(zero_copy_only=False), hour)
        if "weekday" in own:
            has = pc.binary_length(fields[own["weekday"]].take(pa.array(rows))).to_numpy(zero_copy_only=False) > 0
            good &= ~has | (_numbered(fields[own["weekday"]], rows, WEEKDAYS, 0) == days % 7)
        good &= (hour <= 23) & (number("minute") <= 59) & (number("second") <= 59) & (number("offhour") <= 18) & (number("offminute") <= 59)
        micro = zero
        if "fraction" in part:
            digits, length = part["fraction"]
            micro = np.where(length > 6, digits // 10 ** np.maximum(length - 6, 0), digits * 10 ** np.maximum(6 - length, 0))
        value[rows] = (days * 86_400 + hour * 3600 + number("minute") * 60 + number("second")) * SECOND + micro
        state[rows] = np.where(good, OK, INVALID)
        local = good
        if "sign" in own:
            signed = pc.binary_length(fields[own["sign"]].take(pa.array(rows))).to_numpy(zero_copy_only=False) > 0
            minus = pc.equal(fields[own["sign"]].take(pa.array(rows)), "-").to_numpy(zero_copy_only=False)
            at = good & signed
            value[rows[at]] -= (np.where(minus, -1, 1) * (number("offhour") * 60 + number("offminute")))[at] * 60 * SECOND
            local = good & ~signed
        at = pa.array(rows[local])
        named_rows.append(rows[local])
        said = pa.nulls(len(at), pa.string())
        for g in ("zone", "bracket"):
            if g in own:
                text = fields[own[g]].take(at)
                said = pc.coalesce(said, pc.if_else(pc.not_equal(text, ""), text, None))
        named_texts.append(said)
    if named_rows:
        _place(value, state, np.concatenate(named_rows), pa.concat_arrays(named_texts), zones, rules)
    return value, state


def _place(value: np.ndarray, state: np.ndarray, rows: np.ndarray, said: pa.Array, zones: pa.Array | None, rules: TimestampRules) -> None:
    """Turns the local times of some rows into instants, by the abbreviation or zone said, or else by the row's zone."""
    short = pc.index_in(pc.utf8_upper(said), pa.array(list(rules.abbreviations), pa.string())).fill_null(-1).to_numpy()
    minutes = np.array([*rules.abbreviations.values(), 0], np.int64)
    value[rows] -= np.where(short >= 0, minutes[short], 0) * 60 * SECOND
    rows, said = rows[short < 0], said.filter(pa.array(short < 0))
    own = zones.cast(pa.string()).take(pa.array(rows)) if zones is not None else pa.nulls(len(rows), pa.string())
    coded = pc.fill_null(pc.coalesce(said, own), rules.default_zone).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    for name, at in zip(coded.dictionary.to_pylist(), np.split(rows[order], np.searchsorted(codes[order], np.arange(1, len(coded.dictionary)))), strict=True) if len(rows) else ():
        if name not in zone_names():
            state[at] = UNKNOWN_ZONE
            continue
        times, offset = local_offsets(name, value[at] // SECOND)
        value[at] -= offset * SECOND
        state[at] = np.where(times == 1, OK, np.where(times > 1, TWICE, NEVER))


def normalise_timestamps(df: DataFrame, text: str, zone: str | None, rules: TimestampRules = TimestampRules(), instant: str = "epoch_us", status: str = "ts_status") -> DataFrame:
    """Add ``instant`` (bigint, microseconds since 1970 UTC, null if unresolved) and ``status`` to every row of ``df``.

    ``status`` is ``ok``, ``missing`` (null text or nothing after the outer spaces are gone), ``unreadable`` (no notation
    fits), ``invalid`` (a calendar or clock value out of range, or a weekday that is not that date's), ``unknown_zone``
    (no name of the IANA table of the machines), ``twice`` or ``never`` (a local time that its zone has twice or never).
    Rows are kept one for one, repeated rows too; an empty table gives an empty one; columns that already have an output
    name are replaced. A text of any length is matched once; fractions beyond microseconds are cut. The zone of a row
    (``zone`` may be None) counts only where the text names neither offset nor zone; a null zone is ``rules.default_zone``.
    """
    for name in (text, zone):
        if name is not None and name not in df.columns:
            raise SchemaError(f"no column {name!r}")
    kept = [c for c in df.columns if c not in (instant, status)]
    (both,) = fresh([*df.columns, instant, status], "_ts")

    @F.arrow_udf("us bigint, state string")
    def read(texts: pa.Array, zones: pa.Array) -> pa.Array:
        value, state = resolve(texts, zones, rules)
        names = pa.DictionaryArray.from_arrays(pa.array(state, pa.int8()), pa.array(STATES)).cast(pa.string())
        return pa.StructArray.from_arrays([pa.array(value, mask=state != OK), names], names=["us", "state"])

    where = quoted(zone).cast("string") if zone is not None else F.lit(None).cast("string")
    step = df.withColumn(both, pinned(read(quoted(text).cast("string"), where)))
    return step.select(*[quoted(c) for c in kept], F.col(f"{both}.us").alias(instant), F.col(f"{both}.state").alias(status))
