"""Settings: plain values from a form, coerced once into one frozen object."""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

from rivulet.functions import labels, text
from rivulet.functions.text import NameOptions

#: Whether tags of quality, region, country and other kinds are ignored.
TAG_HANDLING = {"strip_all": [True, True, True, True], "keep_regional": [True, False, True, True], "keep_all": [False, False, False, False]}
#: Threshold of each sensitivity, and the one where none is set.
THRESHOLDS = {"relaxed": 70, "normal": 80, "strict": 90, "exact": 95}

#: Settings that hold a secret, and those that name accounts.
SECRETS, ACCOUNTS = ("webhook_url",), ("selected_m3us",)


def yes(value, default: bool = False) -> bool:
    if value is None or value == "":
        return default
    return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "yes", "1", "on")


def number(value, default: float, low: float | None = None) -> float:
    try:
        out = float(value)
    except (TypeError, ValueError):
        return default
    return out if low is None or out >= low else default


def tag_list(raw: str | None) -> list[str]:
    """Comma-separated tags; quotes keep commas and spaces."""
    if not raw:
        return []
    return [t for t in (x.strip() if not x.startswith(" ") or x.strip() else x for x in next(csv.reader([raw], skipinitialspace=True))) if t]


def priority_list(raw: str | None) -> list[str]:
    return [t.strip().lower() for t in (raw or "").split(",") if t.strip()]


def zone_info(name: str | None) -> ZoneInfo:
    try:
        return ZoneInfo(name or "UTC")
    except Exception:  # noqa: BLE001  an unknown zone is UTC
        return ZoneInfo("UTC")


def clock(raw: str | None) -> list[tuple[int, int]]:
    """'HHMM' entries as (hour, minute); malformed ones are left out."""
    out = []
    for x in (raw or "").split(","):
        x = x.strip()
        if len(x) == 4 and x.isdigit() and int(x[:2]) < 24 and int(x[2:]) < 60:
            out.append((int(x[:2]), int(x[2:])))
    return out


@dataclass(frozen=True)
class Settings:
    threshold: int = 80
    ignored_tags: tuple[str, ...] = ()
    restrict_country: bool = False
    quality_first: bool = True
    visible_limit: int = 1
    dedup_url: bool = False
    overwrite: bool = True
    starved: bool = True
    floor_kbps: float = 300.0
    margin: float = 1.0
    ttl_minutes: float = 1440.0
    audio_channels: tuple[str, ...] = ()
    audio_codecs: tuple[str, ...] = ()
    overrides: dict = field(default_factory=dict)
    rules: tuple = ()
    aliases: dict = field(default_factory=dict)
    placeholders: tuple[str, ...] = ()
    ignore: tuple[bool, bool, bool, bool] = (True, True, True, True)

    def names(self) -> NameOptions:
        """How names are read."""
        quality, regional, geographic, misc = self.ignore
        return NameOptions(quality=quality, regional=regional, geographic=geographic, misc=misc, ignored_tags=self.ignored_tags)

    @classmethod
    def of(cls, raw: dict) -> Settings:
        # A sensitivity decides; a number counts without one, within what a share can be.
        threshold = THRESHOLDS.get(str(raw.get("match_sensitivity", "")).lower())
        if threshold is None:
            threshold = max(1, min(100, int(number(raw["fuzzy_match_threshold"], 85)))) if "fuzzy_match_threshold" in raw else 80
        flags = TAG_HANDLING.get(raw.get("tag_handling", "")) or [yes(raw.get(f"ignore_{k}_tags"), True) for k in ("quality", "regional", "geographic", "misc")]
        aliases = json.loads(raw["custom_aliases"]) if raw.get("custom_aliases") else {}
        return cls(
            threshold=threshold, ignored_tags=tuple(tag_list(raw.get("ignore_tags"))), restrict_country=yes(raw.get("restrict_matching_to_country")),
            quality_first=yes(raw.get("prioritize_quality"), True), visible_limit=int(number(raw.get("visible_channel_limit"), 1, 1)),
            dedup_url=yes(raw.get("dedup_url")), overwrite=yes(raw.get("overwrite_streams"), True), starved=yes(raw.get("demote_content_starved"), True),
            floor_kbps=number(raw.get("content_bitrate_floor_kbps"), 300.0, 0), margin=number(raw.get("throughput_margin"), 1.0, 0), ttl_minutes=number(raw.get("probe_cache_ttl_minutes"), 1440.0, 0),
            audio_channels=tuple(priority_list(raw.get("audio_channels"))), audio_codecs=tuple(priority_list(raw.get("audio_codecs"))),
            overrides=labels.parse_overrides(raw.get("prefix_country_overrides")), rules=tuple(text.checked_rules(json.loads(raw["regex_rules"]))) if raw.get("regex_rules") else (),
            aliases=aliases, placeholders=tuple(tag_list(raw.get("placeholder_patterns"))), ignore=tuple(flags),
        )


def redacted(raw: dict) -> dict:
    """The settings for a report: secrets masked, of account names only their number."""

    def shown(key: str, value):
        if not value or key not in SECRETS + ACCOUNTS:
            return value
        if key in SECRETS:
            return "(set, redacted)"
        names = [n for n in value.split(",") if n.strip()] if isinstance(value, str) else value if isinstance(value, (list, tuple, set)) else [value]
        return f"(set, {len(names)} source(s), redacted)"

    return {key: shown(key, raw[key]) for key in sorted(raw)}


def eta(seconds: float | None) -> str:
    s = int(max(0, seconds or 0))
    return f"{s}s" if s < 60 else f"{s // 60}m {s % 60}s" if s < 3600 else f"{s // 3600}h {s % 3600 // 60}m"


def run_seconds(groups: int, streams: int, rate: float = 1.61) -> float:
    """Estimated seconds of a run at ``rate`` seconds a group and thousand streams."""
    return groups * streams / 1000 * min(1000.0, max(0.001, rate))


def fits(message: str, budget: int) -> str:
    """The message cut to ``budget`` UTF-8 bytes, whole characters only."""
    return message.encode()[:budget].decode(errors="ignore")
