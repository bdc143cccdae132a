"""Mixed timestamp texts to one unambiguous instant.

Every text is reduced to a shape mask (digits to ``9``, letters to ``a``, everything else kept).  Each distinct
mask is mapped to a parser once per worker; all texts of a mask are then converted together, by digit columns of
a byte matrix.  Wall-clock times go through transition tables of their zone.  The zone data is read once, on the driver, and
goes to all workers with its version (``ZoneBook``), so no result hangs on what a worker's own system holds.

Defined results: null and empty texts, shapes without a parser, impossible dates, values without a
time of day, wall-clock times that a clock change skips or repeats, and zoneless times of an unknown zone give null.
Texts of any length are read; a zone's last rule holds for all later years.
Seconds may be missing (0); digits finer than a microsecond are dropped; dates with dots put the day first;
two-digit years are 20xx; integers of 9 or 10 digits count seconds, of 12 or 13 milliseconds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

CANONICAL = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z")

# English month and weekday names, and the zone abbreviations of RFC 2822 with UTC.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
ABBREVIATIONS = {"z": 0, "gmt": 0, "ut": 0, "utc": 0, "est": -18000, "edt": -14400, "cst": -21600, "cdt": -18000, "mst": -25200, "mdt": -21600, "pst": -28800, "pdt": -25200}

MONTH_NO = {n: i + 1 for i, m in enumerate(MONTHS) for n in (m, m[:3])} | {"sept": 9}
DAY_NO = {n: i for i, d in enumerate(DAYS) for n in (d, d[:3])}

_MASK = bytes(57 if 48 <= b < 58 else 97 if 65 <= b < 91 or 97 <= b < 123 else b for b in range(256))


_HALF = re.compile(r"(?<=[0-9 ])[AaPp][Mm](?![A-Za-z])")


def mask_of(text: str) -> bytes:
    """The shape; AM and PM are a class of their own (``mm``), or they would look like a zone of two letters."""
    out = text.encode("utf-8", "replace").translate(_MASK)
    if ("M" in text or "m" in text) and (m := _HALF.search(text)):
        at = len(text[: m.start()].encode("utf-8", "replace"))
        out = out[:at] + b"mm" + out[at + 2 :]
    return out


# Zone tables ---------------------------------------------------------------------------------------------
#: The calendar with its weekdays repeats after 400 years, and with it what a zone's last rule gives.
_CYCLE = 146097 * 86400
#: Years a table spans: before the first no zone had changed its clock; the last 400 follow every zone's last rule.
_FIRST, _LAST = 1800, 2440


@dataclass(frozen=True)
class ZoneTable:
    """``starts[i]`` is the instant (seconds) from which ``offsets[i]`` holds; from ``end`` on, what held one or more cycles before."""

    name: str
    version: str
    starts: np.ndarray
    offsets: np.ndarray
    end: int

    def offset_at(self, utc: np.ndarray) -> np.ndarray:
        utc = utc - np.maximum(0, -((self.end - utc) // _CYCLE)) * _CYCLE
        return self.offsets[np.maximum(np.searchsorted(self.starts, utc, side="right") - 1, 0)]

    def to_utc(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Instants of wall-clock seconds, and whether exactly one instant shows that wall clock."""
        a, b = wall - self.offset_at(wall - 129600), wall - self.offset_at(wall + 129600)
        good_a, good_b = self.offset_at(a) == wall - a, self.offset_at(b) == wall - b
        return np.where(good_a, a, b), (good_a & good_b & (a == b)) | (good_a ^ good_b)


def _zone_files() -> dict[str, bytes]:
    """The system's zone files, or those of the package ``tzdata``."""
    import zoneinfo
    from importlib import resources
    from pathlib import Path

    def read(name: str) -> bytes | None:
        for root in zoneinfo.TZPATH:
            if (p := Path(root, name)).is_file():
                return p.read_bytes()
        try:
            return resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()
        except (ImportError, OSError):
            return None

    got = ((n, read(n)) for n in sorted(zoneinfo.available_timezones()))
    return {n: d for n, d in got if d}


class ZoneBook:
    """Zone data of one version: made on the driver, sent to the workers, where tables are made of it when a zone is first met.

    ``version`` is a digest of the data itself, so equal versions mean equal tables on whatever machine.
    """

    def __init__(self, files: dict[str, bytes]):
        import hashlib

        self.files, self.tables = files, {}
        h = hashlib.blake2b(digest_size=8)
        for n in sorted(files):
            h.update(n.encode() + b"\0" + len(files[n]).to_bytes(8, "big") + files[n])
        self.version = h.hexdigest()

    def __getstate__(self):
        return {"files": self.files, "version": self.version, "tables": {}}

    def table(self, name: str | None) -> ZoneTable | None:
        """None for a name that is no zone."""
        if name not in self.tables:
            self.tables[name] = self._make(name) if name in self.files else None
        return self.tables[name]

    def _make(self, name: str) -> ZoneTable:
        """Changes of offset, found by bisection between weeks."""
        import datetime as dt
        import io
        import zoneinfo

        z = zoneinfo.ZoneInfo.from_file(io.BytesIO(self.files[name]), key=name)
        epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)

        def off(s: int) -> int:
            return int((epoch + dt.timedelta(seconds=s)).astimezone(z).utcoffset().total_seconds())

        t, end = (int((dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc) - epoch).total_seconds()) for y in (_FIRST, _LAST))
        starts, offsets = [-(2**62)], [off(t)]
        while t < end:
            u = min(t + 7 * 86400, end)
            if off(u) != offsets[-1]:
                a, b = t, u
                while b - a > 1:
                    mid = (a + b) // 2
                    a, b = (a, mid) if off(mid) != offsets[-1] else (mid, b)
                starts.append(b)
                offsets.append(off(b))
                u = b
            t = u
        return ZoneTable(name, self.version, np.array(starts, np.int64), np.array(offsets, np.int64), end)


@lru_cache(maxsize=1)
def zone_book() -> ZoneBook:
    """The book of this machine's zone data; call it on the driver."""
    return ZoneBook(_zone_files())


# Shapes --------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Shape:
    """Byte columns of the fields of one mask.  ``None``: the field is absent."""

    year: tuple[int, int] | None = None
    month: tuple[int, int] | None = None
    month_name: tuple[int, int] | None = None
    day: tuple[int, int] | None = None
    day_name: tuple[int, int] | None = None
    hour: tuple[int, int] | None = None
    minute: tuple[int, int] | None = None
    second: tuple[int, int] | None = None
    fraction: tuple[int, int] | None = None
    half: tuple[int, int] | None = None
    sign: tuple[int, int] | None = None
    zone_hour: tuple[int, int] | None = None
    zone_minute: tuple[int, int] | None = None
    zone: tuple[int, int] | None = None
    zone2: tuple[int, int] | None = None
    count: tuple[int, int] | None = None


_CLOCK = r"(?P<hour>9{1,2}):(?P<minute>99)(?::(?P<second>99)(?:[.,](?P<fraction>9+))?)?(?: ?(?P<half>mm))?"
_ZONE = r"(?: ?(?P<sign>[+-])(?P<zone_hour>99):?(?P<zone_minute>99)?(?: ?\(a+\))?| ?\[(?P<zone>a[a/_+\-9]*)\]| ?\(?(?P<zone2>a[a/_+\-9]*)\)?)?"
_GRAMMAR = [
    re.compile(p)
    for p in (
        rf"(?P<year>9999)[-/](?P<month>99)[-/](?P<day>99)[a ,]+{_CLOCK}{_ZONE}",
        rf"(?P<year>9999)(?P<month>99)(?P<day>99)a?(?P<hour>99)(?P<minute>99)(?P<second>99)?(?:[.,](?P<fraction>9+))?{_ZONE}",
        rf"(?P<day>9{{1,2}})\.(?P<month>9{{1,2}})\.(?P<year>9999|99),? {_CLOCK}{_ZONE}",
        rf"(?:(?P<day_name>a+)\.?,? )?(?P<day>9{{1,2}})[ -](?P<month_name>a+)\.?[ -](?P<year>9999|99),? {_CLOCK}{_ZONE}",
        rf"(?:(?P<day_name>a+)\.?,? )?(?P<month_name>a+)\.? (?P<day>9{{1,2}}),? (?P<year>9999),?(?: aa)? {_CLOCK}{_ZONE}",
        rf"(?P<day_name>a+) (?P<month_name>a+) +(?P<day>9{{1,2}}) {_CLOCK}(?: (?P<zone2>a+))? (?P<year>9999)",
        r"(?P<count>9{9,10}|9{12,13})",
    )
]


@lru_cache(maxsize=20_000)
def shape_of(mask: bytes) -> Shape | None:
    if b"9" not in mask:
        return None
    text = mask.decode("latin-1")
    for g in _GRAMMAR:
        if m := g.fullmatch(text):
            return Shape(**{k: m.span(k) for k in m.groupdict() if m.span(k)[0] >= 0})
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    y = y - (m <= 2)
    era = np.floor_divide(y, 400)
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


_LENGTHS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _month_length(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return _LENGTHS[np.clip(m, 0, 12)] + (leap & (m == 2))


def _convert(shape: Shape, texts: list[str], zones: list[str | None], book: ZoneBook) -> np.ndarray:
    """Microseconds of texts of one mask; the least int64 stands for none."""
    n = len(texts)
    raw = [t.encode("utf-8", "replace") for t in texts]
    mat = np.frombuffer(b"".join(raw), np.uint8).reshape(n, -1)
    none = np.iinfo(np.int64).min

    def num(span: tuple[int, int] | None, missing: int = 0) -> np.ndarray:
        if span is None:
            return np.full(n, missing, np.int64)
        out = np.zeros(n, np.int64)
        for c in range(*span):
            out = out * 10 + (mat[:, c].astype(np.int64) - 48)
        return out

    def words(span: tuple[int, int], table: dict[str, int]) -> np.ndarray:
        memo: dict[bytes, int] = {}
        out = np.empty(n, np.int64)
        for i, r in enumerate(raw):
            w = r[span[0] : span[1]]
            if w not in memo:
                memo[w] = table.get(w.decode("ascii", "replace").lower(), -1)
            out[i] = memo[w]
        return out

    if shape.count:
        c = num(shape.count)
        return c * (1_000_000 if shape.count[1] - shape.count[0] <= 10 else 1000)

    y, d = num(shape.year), num(shape.day)
    if shape.year[1] - shape.year[0] == 2:
        y = y + 2000
    m = num(shape.month) if shape.month else words(shape.month_name, MONTH_NO)
    h, mi, s = num(shape.hour), num(shape.minute), num(shape.second)
    good = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1) & (mi < 60) & (s < 60)
    good &= d <= _month_length(y, m)
    if shape.half:
        half = words(shape.half, {"am": 0, "pm": 12})
        good &= (half >= 0) & (h >= 1) & (h <= 12)
        h = h % 12 + half
    good &= h < 24
    days = _days(y, np.clip(m, 1, 12), d)
    if shape.day_name:
        name = words(shape.day_name, DAY_NO)
        good &= name == (days + 3) % 7
    wall = days * 86400 + h * 3600 + mi * 60 + s
    micros = np.zeros(n, np.int64)
    if shape.fraction:
        a, b = shape.fraction
        micros = num((a, min(b, a + 6))) * 10 ** max(0, 6 - (b - a))

    if shape.sign:
        zh, zm = num(shape.zone_hour), num(shape.zone_minute)
        good &= (zh < 24) & (zm < 60)
        off = (zh * 3600 + zm * 60) * np.where(mat[:, shape.sign[0]] == 45, -1, 1)
        utc = wall - off
    else:
        span = shape.zone or shape.zone2
        named = [r[span[0] : span[1]].decode("ascii", "replace") for r in raw] if span else zones
        utc = np.zeros(n, np.int64)
        groups: dict[str | None, list[int]] = {}
        for i, z in enumerate(named):
            groups.setdefault(z, []).append(i)
        for z, at in groups.items():
            ix = np.array(at)
            if z and z.lower() in ABBREVIATIONS:
                utc[ix] = wall[ix] - ABBREVIATIONS[z.lower()]
                continue
            t = book.table(z) if z and ("/" in z or not span) else None
            if t is None:
                good[ix] = False
            else:
                utc[ix], one = t.to_utc(wall[ix])
                good[ix] &= one
    return np.where(good, utc * 1_000_000 + micros, none)


def to_micros(texts: Iterable[str | None], zones: Iterable[str | None], book: ZoneBook | None = None) -> list[int | None]:
    """Instants of texts, in microseconds since 1970-01-01 UTC; ``zones`` are those of times without a zone."""
    book = book or zone_book()
    texts, zones = list(texts), list(zones)
    out: list[int | None] = [None] * len(texts)
    by: dict[bytes, list[int]] = {}
    for i, t in enumerate(texts):
        if t is None:
            continue
        t = t.strip()
        if t:
            texts[i] = t
            by.setdefault(mask_of(t), []).append(i)
    for mask, at in by.items():
        # The memo is for the masks that recur; one of a long text isn't kept.
        if shape := shape_of(mask) if len(mask) <= 80 else shape_of.__wrapped__(mask):
            got = _convert(shape, [texts[i] for i in at], [zones[i] for i in at], book)
            for i, v in zip(at, got.tolist()):
                out[i] = v if v != np.iinfo(np.int64).min else None
    return out


def instants(batches: Iterator, fields: tuple[str, ...], zone: str, keep: str, book) -> Iterator:
    """mapInArrow body: one row per field value that denotes one instant: ``keep``, field, epoch_us, already (written in the target form).  ``book`` is a broadcast ZoneBook."""
    import pyarrow as pa

    for b in batches:
        ids, zones = b.column(keep), b.column(zone).to_pylist()
        for f in fields:
            texts = b.column(f).to_pylist()
            got = to_micros(texts, zones, book.value)
            at = [i for i, v in enumerate(got) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(at, pa.int64())),
                    pa.array([f] * len(at), pa.string()),
                    pa.array([got[i] for i in at], pa.int64()),
                    pa.array([bool(CANONICAL.fullmatch(texts[i])) for i in at], pa.bool_()),
                ],
                names=[keep, "field", "epoch_us", "already"],
            )
