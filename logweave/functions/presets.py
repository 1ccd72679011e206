"""Verbosity presets, detail levels and duration text."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Preset:
    """Caps of one verbosity level; None is no cap."""

    name: str
    content: int | None
    tool_input: int | None
    tool_result: int | None
    show_thinking: bool
    thinking: int | None
    show_args: bool
    show_results: bool


# Caps of the four presets, and the preset of each detail level.
PRESETS = {
    "minimal": Preset("minimal", 80, 0, 0, False, 0, False, False),
    "standard": Preset("standard", 500, 60, 80, False, 0, True, True),
    "verbose": Preset("verbose", 2000, 200, 500, True, 200, True, True),
    "full": Preset("full", None, None, None, True, None, True, True),
}
DETAILS = {"full": "full", "condensed": "standard", "skeleton": "minimal", "meta": "minimal"}

#: The largest and default token budget of one read.
READ_BUDGET = 8000


def preset(name: str | Preset | None) -> Preset | None:
    if name is None or isinstance(name, Preset):
        return name
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
    return PRESETS[name]


def for_read(preset_name: str | None = None, detail: str | None = None) -> Preset:
    """The preset of a read: a detail level goes before a preset; the default is standard."""
    return PRESETS[DETAILS[detail]] if detail else preset(preset_name or "standard")


def read_budget(asked: int | None = None) -> int:
    return min(asked or READ_BUDGET, READ_BUDGET)


def parse_duration(text: str) -> int:
    """Milliseconds of a text like ``7d``, ``24h``, ``30m`` or ``10s``."""
    m = re.fullmatch(r"(\d+)\s*([dhms])", text.strip())
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return int(m[1]) * {"d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1000}[m[2]]
