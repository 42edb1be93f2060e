"""Instants, windows and buckets."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Epoch numbers below this are seconds; the last accepted instant.
SECONDS_BELOW = 1e11
LAST_MILLIS = 253402300799999
# Fixed value: the range of a 64-bit float date in ms.
MAX_DATE_MILLIS = 8640000000000000

# Accepted spellings.
_ISO = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2})([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?"
    r"(Z|[+-][0-9]{2}:?[0-9]{2})?\z"
)
_NUMERIC = r"^-?[0-9]+(\.[0-9]+)?\z"


def from_epoch(number: Column) -> Column:
    """Epoch seconds or milliseconds (DOUBLE) to TIMESTAMP, NULL outside 1970..9999."""
    millis = F.when(F.abs(number) < SECONDS_BELOW, number * 1000).otherwise(number)
    return F.when(
        (millis >= 0) & (millis <= LAST_MILLIS),
        F.timestamp_millis(F.floor(millis).cast("bigint")),
    )


# The fields of an ISO text in fixed places; fields that are missing come out empty.
_FIELDS = (
    r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2})"
    r"(?::([0-9]{2})(?:\.([0-9]{1,3})[0-9]*)?)?)?(?:Z|([+-])([0-9]{2}):?([0-9]{2}))?\z"
)


def _instant_of_fields(field: Column) -> Column:
    def number(i: int) -> Column:
        return F.coalesce(F.get(field, i).try_cast("int"), F.lit(0))

    month, day, hour, minute, second = (number(i) for i in (1, 2, 3, 4, 5))
    milli = F.rpad(F.get(field, 6), 3, "0").try_cast("int")
    valid = (
        month.between(1, 12)
        & day.between(1, 31)
        & (minute <= 59)
        & (second <= 59)
        & ((hour <= 23) | ((hour == 24) & (minute + second + milli == 0)))
        & (number(8) <= 23)
        & (number(9) <= 59)
    )
    month_start = F.unix_date(F.make_date(number(0), month, F.lit(1))).cast("bigint")
    offset = F.when(F.get(field, 7) == "-", -1).otherwise(1) * (number(8) * 60 + number(9))
    seconds = (
        (month_start + day - 1) * 86400 + hour * 3600 + (minute - offset) * 60 + second
    )
    return F.when(valid, F.timestamp_millis(seconds * 1000 + milli))


def _calendar_instant(text: Column) -> Column:
    """Instant from the fields of an ISO text that the built-in cast refuses.

    Covers a missing seconds field, a day past the end of its month (carried
    into the next month), 24:00 and wide zone offsets.
    """
    places = ",".join(f"${i}" for i in range(1, 11))
    fields = F.split(F.regexp_replace(text, _FIELDS, places), ",")
    return F.transform(F.array(fields), _instant_of_fields)[0]


def from_iso(text: Column) -> Column:
    """ISO 8601 text to TIMESTAMP in whole ms.

    Text without a zone is read in the session's zone, which is UTC.
    """
    quick = F.date_trunc("millisecond", text.try_cast("timestamp"))
    return F.when(
        F.rlike(text, F.lit(_ISO)), F.coalesce(quick, _calendar_instant(text))
    )


def within_range(instant: Column) -> Column:
    return F.when(
        instant.between(
            F.timestamp_millis(F.lit(0)), F.timestamp_millis(F.lit(LAST_MILLIS))
        ),
        instant,
    )


def from_text(token: Column) -> Column:
    """Numeric or ISO text, already trimmed, to TIMESTAMP."""
    number = F.when(F.rlike(token, F.lit(_NUMERIC)), token.try_cast("double"))
    return F.when(
        F.contains(token, F.lit("-")) & (F.length(token) >= 10), within_range(from_iso(token))
    ).otherwise(from_epoch(number))


def iso_text(instant: Column) -> Column:
    """UTC text with milliseconds, for export only."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


_INSTANT = re.compile(
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})\Z"
)


def parse_instant(value: str | datetime, name: str = "instant") -> datetime:
    """Validate a query bound: an ISO instant with an offset, cut to whole ms."""
    if isinstance(value, datetime):
        moment = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    else:
        if not isinstance(value, str) or not _INSTANT.match(value):
            raise ValueError(f"{name} must be an ISO 8601 instant with an offset: {value!r}")
        try:
            moment = datetime.fromisoformat(value)
        except ValueError as error:
            raise ValueError(f"{name} is not a valid instant: {value!r}") from error
    moment = moment.astimezone(timezone.utc)
    return moment.replace(microsecond=moment.microsecond // 1000 * 1000)


def instant_lit(moment: datetime) -> Column:
    """UTC literal that does not depend on the Python process's own time zone."""
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f") + "Z").cast("timestamp")


def instant_text(moment: datetime) -> str:
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


@dataclass(frozen=True)
class Window:
    """Half-open time window."""

    start: datetime
    end: datetime

    @classmethod
    def of(cls, start: str | datetime, end: str | datetime) -> Window:
        return cls(parse_instant(start, "from"), parse_instant(end, "to"))

    @property
    def length(self) -> timedelta:
        return self.end - self.start

    def previous(self) -> Window:
        """The window of equal length that ends where this one starts."""
        return Window(self.start - self.length, self.start)

    def bucket_unit(self) -> str:
        """minute up to 3 hours, hour up to 3 days, day beyond."""
        if self.length <= timedelta(hours=3):
            return "minute"
        return "hour" if self.length <= timedelta(days=3) else "day"

    def bucket_count(self) -> int:
        """Buckets the window touches, 0 for an empty window."""
        first, last = self.bucket_bounds()
        step = {"minute": 60, "hour": 3600, "day": 86400}[self.bucket_unit()]
        return max(0, int((last - first).total_seconds()) // step + 1)

    def bucket_bounds(self) -> tuple[datetime, datetime]:
        """Starts of the first bucket and of the one holding the last ms."""

        def floor(moment: datetime) -> datetime:
            moment = moment.replace(second=0, microsecond=0)
            unit = self.bucket_unit()
            if unit != "minute":
                moment = moment.replace(minute=0)
            return moment if unit != "day" else moment.replace(hour=0)

        return floor(self.start), floor(self.end - timedelta(milliseconds=1))


# The named time ranges.
PRESETS = {
    "1h": timedelta(hours=1),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
    "30d": timedelta(days=30),
}
DEFAULT_PRESET = "24h"


def time_range(
    preset: str | None,
    now: datetime,
    start: str | None = None,
    end: str | None = None,
) -> Window:
    """Window of a named range ending now; ``custom`` needs two ordered bounds.

    An unknown name and an unusable custom range fall back to the default.
    """
    now = parse_instant(now)
    if preset == "custom":
        try:
            window = Window.of(start, end)
        except ValueError:
            window = None
        if window is not None and window.start < window.end:
            return window
    length = PRESETS.get(preset, PRESETS[DEFAULT_PRESET])
    return Window(now - length, now)
