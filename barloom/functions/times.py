"""Time ranges: checked on the driver, used as column expressions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _time(x: str | dt.datetime) -> dt.datetime:
    try:
        out = dt.datetime.fromisoformat(x.replace("Z", "+00:00")) if isinstance(x, str) else x
        aware = out.tzinfo is not None
    except (AttributeError, ValueError) as e:
        raise ValueError(f"no time: {x!r}") from e
    if not aware:
        raise ValueError(f"a time needs a zone: {x!r}")
    return out


@dataclass(frozen=True)
class TimeRange:
    """A closed range of times with zones, the end not before the start; ISO text is read as a time."""

    start: dt.datetime
    end: dt.datetime

    def __post_init__(self):
        object.__setattr__(self, "start", _time(self.start))
        object.__setattr__(self, "end", _time(self.end))
        if self.start > self.end:
            raise ValueError("a range can't end before it starts")

    def checked(self, now: str | dt.datetime | None = None) -> TimeRange:
        """The range, if it doesn't end in the future."""
        if self.end > _time(now or dt.datetime.now(dt.UTC)):
            raise ValueError("a range can't end in the future")
        return self

    def clamped(self, now: str | dt.datetime | None = None) -> TimeRange:
        """The range up to now at most."""
        return TimeRange(self.start, min(self.end, _time(now or dt.datetime.now(dt.UTC))))

    def contains(self, ts: Column) -> Column:
        """Is a time (UTC where it has no zone) inside the range, both ends included?"""
        at = lambda x: F.lit(x.astimezone(dt.UTC).replace(tzinfo=None)).cast("timestamp_ntz")
        return ts.cast("timestamp_ntz").between(at(self.start), at(self.end))

    def to_dict(self) -> dict[str, str]:
        return {"start": self.start.isoformat(), "end": self.end.isoformat()}

    @classmethod
    def from_dict(cls, data: dict[str, str]) -> TimeRange:
        try:
            return cls(data["start"], data["end"])
        except (KeyError, TypeError) as e:
            raise ValueError(f"no time range: {data!r}") from e
