"""Request parameters."""

from __future__ import annotations


def year_range(year: str | None = None, start: str | None = None, end: str | None = None, default: tuple[int, int] = (1900, 2100)) -> tuple[int, int]:
    """A single year, or a range by its ends; what is no number is as if not given."""

    def number(text: str | None) -> int | None:
        try:
            return int(text) if text else None
        except ValueError:
            return None

    one = number(year)
    if one is not None:
        return one, one
    low, high = number(start), number(end)
    return default[0] if low is None else low, default[1] if high is None else high
