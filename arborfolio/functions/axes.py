"""Axis limits, ticks and text formats of the charts and the report."""

from __future__ import annotations

import math
from collections.abc import Iterable
from datetime import date


def nice_step(span: float, ticks: int = 5) -> float:
    """The step of 1, 2, 5 or 10 times a power of ten nearest to span / ticks; cut points 1.5, 3 and 7."""
    if not span > 0 or ticks < 1:
        return 1.0
    raw = span / ticks
    power = 10.0 ** math.floor(math.log10(raw))
    return next((m for cut, m in ((1.5, 1), (3, 2), (7, 5)) if raw / power < cut), 10) * power


def clean_limits(low: float, high: float, ticks: int = 5) -> tuple[float, float, float]:
    """Low and high moved out to whole steps, and the step."""
    step = nice_step(high - low if high > low else abs(high) or 1.0, ticks)
    return math.floor(low / step) * step, math.ceil(high / step) * step, step


def tick_values(low: float, high: float, step: float) -> list[float]:
    return [round(low + i * step, 12) for i in range(round((high - low) / step) + 1)]


def date_ticks(dates: Iterable[date]) -> list[date]:
    """The first and the last date, and the first date of each later year."""
    days = sorted(set(dates))
    if not days:
        return []
    firsts = {d.year: d for d in reversed(days)}
    return sorted({days[0], days[-1], *(d for y, d in firsts.items() if y > days[0].year)})


def percent(x: float | None) -> str:
    return "–" if x is None else f"{100 * x:.2f}%"


def two_places(x: float | None) -> str:
    return "–" if x is None else f"{x:.2f}"


#: Characters with a meaning in the report's markup.
MARKUP = "\\#$*_`<>@[]"


def escape_markup(text: str) -> str:
    return "".join(f"\\{c}" if c in MARKUP else c for c in text)
