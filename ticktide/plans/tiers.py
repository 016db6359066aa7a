"""Resolution tiers: which cached table answers a request, and which dated files of it."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime, timedelta

PERIODS = {"yearly": "%Y", "monthly": "%Y/%m", "daily": "%Y/%m/%d", "hourly": "%Y/%m/%d/%H", "perminute": "%Y/%m/%d/%H/%M", "persecond": "%Y/%m/%d/%H/%M/%S"}


class NoTier(LookupError):
    """No tier is as fine as asked for."""


def choose(tiers: Mapping[float, object], resolution: float) -> float:
    """The coarsest bin size not above the resolution, in seconds."""
    fit = [t for t in tiers if t <= resolution]
    if not fit:
        raise NoTier(f"no tier of {resolution:g} s or finer")
    return max(fit)


def parse_config(text: str) -> dict[str, str]:
    """key = 'value' lines; ; starts a comment outside quotes, a trailing + or \\ continues a value."""
    out: dict[str, str] = {}
    joined = re.sub(r"[\\+]\s*(?:;[^\n]*)?\n\s*", "", text)
    for line in joined.splitlines():
        m = re.match(r"\s*([^=;\s][^=;]*?)\s*=\s*(?:'([^']*)'|\"([^\"]*)\"|([^;]*?))\s*(?:;.*)?$", line)
        if m:
            out[m[1]] = next(x for x in m.groups()[1:] if x is not None)
    return out


def levels(config: Mapping[str, str], params: str | None = None) -> dict[float, dict]:
    """Bin seconds to period and parameters, of the cacheLevel_NN entries with these normalised parameters (all without)."""
    out = {}
    for key, value in config.items():
        if not re.fullmatch(r"cacheLevel_\d+", key):
            continue
        size, period, own = ([x.strip() for x in value.split("|")] + ["", ""])[:3]
        seconds = 0.0 if size == "intrinsic" else float(size.split()[0])
        if period not in PERIODS:
            raise ValueError(f"{key}: unknown period {period!r}")
        if params is None or own == params:
            out[seconds] = {"period": period, "params": own}
    return dict(sorted(out.items(), reverse=True))


def paths(period: str, begin: datetime, end: datetime) -> list[str]:
    """The period's relative paths that overlap begin to end (exclusive)."""
    form, out, at = PERIODS[period], [], begin
    step = {"yearly": timedelta(days=28), "monthly": timedelta(days=28), "daily": timedelta(days=1), "hourly": timedelta(hours=1), "perminute": timedelta(minutes=1), "persecond": timedelta(seconds=1)}[period]
    at = datetime.strptime(begin.strftime(form), form)
    while at < end:
        p = at.strftime(form)
        if not out or out[-1] != p:
            out.append(p)
        at = datetime.strptime((at + step).strftime(form), form) if step >= timedelta(days=28) and (at + step).strftime(form) != p else at + step
    return out


def plan(config: Mapping[str, str], params: str, begin: datetime, end: datetime, resolution: float) -> tuple[float, list[str]]:
    """The chosen tier's bin size and the relative paths to read."""
    own = levels(config, params)
    bin_seconds = choose(own, resolution)
    return bin_seconds, paths(own[bin_seconds]["period"], begin, end)
