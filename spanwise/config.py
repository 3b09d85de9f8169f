"""Parameters of the operators. None means: derived from the profile's bin width."""

from __future__ import annotations

from dataclasses import dataclass

#: A profile has this many bins.
N_BINS = 100


@dataclass(frozen=True)
class DetectConfig:
    keep_intro: bool = False
    smooth_below_sec: float = 60.0
    flat_ratio: float = 2.0
    least_peak: float = 1e-6
    sd_factor: float = 1.5
    max_share: float = 0.4
    low_share: float = 0.6
    merge_gap: int = 1


@dataclass(frozen=True)
class PlanConfig:
    max_clips: int = 6
    clip_len: float | None = None
    min_gap: float | None = None
    short_sec: float = 180.0
    strict: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.max_clips <= 10:
            raise ValueError("max_clips is 1..10")
        if self.clip_len is not None and not 15 <= self.clip_len <= 180:
            raise ValueError("clip_len is 15..180")


@dataclass(frozen=True)
class RunConfig:
    """How an item was to be fetched and cut; only named in its manifest."""

    format: str = "916blur"
    source: str = "ytdlp"
    dry_run: bool = False
    full_download: bool = False
    try_sections: bool = False


@dataclass(frozen=True)
class ScoreConfig:
    window_ms: int = 45_000
    least_window_ms: int = 15_000
    cold_open_end_ms: int = 180_000
    body_start_ms: int = 240_000
    rare_df: int = 3
    shingle: int = 5
    nms_gap: float = 45.0
    max_candidates: int = 12
    w_numeric: float = 2.0
    w_pair: float = 3.0
    w_cold_open: float = 4.0
    four_beat: float = 1.3
    pair_ms: int = 15_000
    #: a pre marker counts before, a trailing one after this point of the window (0.55 of it)
    turn_ms: int = 24_750
    promo_before_ms: int = 5_000
    promo_after_ms: int = 30_000
    least_cues: int = 10


@dataclass(frozen=True)
class SubtitleConfig:
    words_per_cue: int = 4
    words_per_line: int = 4
    font_size: int = 108
    width: int = 1080
    height: int = 1920
    margin_v: int = 420
    margin_h: int = 60
