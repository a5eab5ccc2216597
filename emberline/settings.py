"""Settings of the event warehouse: one frozen dataclass, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Tier ages in days.
    hot_days: int = 7
    cold_days: int = 15
    create_ahead: int = 2
    # Oldest accepted event age in days, by stream family.
    late_days: int = 6
    interaction_late_days: int = 2
    app_event_days: int = 20
    # Count tolerances in percent, and the retry cap.
    tolerance_pct: float = 1.0
    profile_tolerance_pct: float = 5.0
    max_retries: int = 10
    # Stream pacing.
    trigger_interval: str = "15 seconds"
    lookup_refresh_seconds: int = 120
    # Delivery zones that enter the weekly profile.
    zones: tuple[str, ...] = (
        "card-p0",
        "card-p1",
        "storypage",
        "pgi",
        "vdo-card-p1",
        "masthead",
        "instream-vdo",
        "dhtv-p0",
        "card-pp1",
    )
    # Streams whose rejects are kept, whose batches are cached, and
    # every how many batches their rejects are evaluated.
    bad_record_kinds: tuple[str, ...] = ("click", "impression", "request", "ad_inflated", "ad_response")
    cached_kinds: tuple[str, ...] = ("request", "click", "impression", "ad_response", "ad_inflated")
    bad_record_every: dict[str, int] = field(default_factory=lambda: {"request": 1})
    # A side is broadcast only when its planned size is known to be below this.
    broadcast_bytes: int = 32 * 1024 * 1024
    # Optional pacing of file sources; record limits apply to message sources.
    max_files_per_trigger: int | None = None
    # Fold a hot partition once it has this many parts.
    fold_after_parts: int = 8
