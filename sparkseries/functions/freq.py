"""Frequency strings ("6H", "15T", "5min", "1S", "D") -> step in microseconds."""

from __future__ import annotations

import re

# Unit spellings accepted for a frequency string, and their
# length in microseconds.  Upper-case forms are the older pandas aliases.
UNIT_US = {
    "D": 86_400_000_000, "d": 86_400_000_000,
    "H": 3_600_000_000, "h": 3_600_000_000,
    "T": 60_000_000, "min": 60_000_000,
    "S": 1_000_000, "s": 1_000_000,
    "L": 1_000, "ms": 1_000,
    "U": 1, "us": 1,
}

DAY_US = UNIT_US["D"]

_FREQ = re.compile(r"^\s*(\d*)\s*([A-Za-z]+)\s*$")


def parse_freq(freq: str | int) -> int:
    """Step in microseconds; ``ValueError`` for calendar units (W, M, Y, ...)."""
    if isinstance(freq, int):
        if freq <= 0:
            raise ValueError("frequency must be positive")
        return freq
    m = _FREQ.match(str(freq))
    if not m or m.group(2) not in UNIT_US:
        raise ValueError(f"unsupported frequency {freq!r}; use a multiple of "
                         f"{sorted(set(UNIT_US))}")
    n = int(m.group(1)) if m.group(1) else 1
    if n <= 0:
        raise ValueError("frequency must be positive")
    return n * UNIT_US[m.group(2)]


def divides_day(step_us: int) -> bool:
    return DAY_US % step_us == 0
