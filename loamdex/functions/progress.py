"""How runs tell people how far they are."""

from __future__ import annotations

#: Seconds before a rate or a remaining time says anything.
SETTLED = 1.0


def duration_text(seconds: float) -> str:
    """Tenths below ten seconds, then whole seconds, minutes with seconds, hours with minutes; parts of zero are left out."""
    if seconds < 10:
        return f"{int(seconds * 1000) / 1000:.1f} s"
    whole = int(seconds)
    for unit, name, lower, smaller in ((3600, "h", 60, "min"), (60, "min", 1, "s")):
        if whole >= unit:
            rest = whole % unit // lower
            return f"{whole // unit} {name}" + (f" {rest} {smaller}" if rest else "")
    return f"{whole} s"


def rate_text(items: float, seconds: float, unit: str) -> str | None:
    """Items a second; None while that says nothing."""
    if seconds < SETTLED or items <= 0:
        return None
    rate = items / seconds
    return f"{rate:,.0f} {unit}/s" if rate >= 10 else f"{rate:.1f} {unit}/s"


def left_text(done: int, total: int, seconds: float) -> str | None:
    """What is left at the rate so far; None while that says nothing."""
    if seconds < SETTLED or done <= 0 or total <= done:
        return None
    left = round(seconds * (total - done) / done)
    return "about " + (f"{max(1, left)} s" if left < 60 else f"{round(left / 60)} min" if left < 3600 else duration_text(left // 60 * 60)) + " left"


def progress_text(label: str, done: int, total: int, seconds: float, noun: str) -> str:
    """One line: what is done of how much, the rate, what is left."""
    parts = [f"{done:,} of {total:,} {noun}" + ("" if total == 1 else "s"), rate_text(done, seconds, noun + "s"), left_text(done, total, seconds)]
    return f"{label}: " + ", ".join(p for p in parts if p)
