"""Names of the columns that make up a panel of series."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SeriesSpec:
    """Which columns hold the series key, time, tie-breaker and target.

    ``order`` is the total order of the rows inside one series. Spark rows have
    no order of their own, so every positional operator reads it from here.
    Pass ``order=("seq",)`` to keep the arrival order of the rows whatever
    their timestamps say.
    """

    key: str = "series_id"
    ts: str = "ts"
    seq: str = "seq"
    value: str = "value"
    order: tuple[str, ...] | None = None

    @property
    def order_by(self) -> list[str]:
        return list(self.order) if self.order else [self.ts, self.seq]

    @property
    def columns(self) -> list[str]:
        return [self.key, self.ts, self.seq, self.value]


PANEL = SeriesSpec()
