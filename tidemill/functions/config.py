"""Thresholds and switches of a classification."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

from tidemill.functions.constants import CATEGORIES


@dataclass(frozen=True)
class ClassifyConfig:
    short_video_seconds: float = 3.0
    similar_window_seconds: float = 60.0
    similar_distance: int = 6
    blur_threshold: float = 12.0
    dark_mean: float = 0.03
    dark_p99: float = 0.12
    move_all_aae: bool = False
    large_video_top: int = 100
    enabled: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(CATEGORIES, True))

    def is_enabled(self, category: str) -> bool:
        return self.enabled.get(category, True)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str | None) -> ClassifyConfig:
        """Unknown keys are dropped, missing ones take their defaults."""
        known = {f.name for f in fields(cls)}
        found = {k: v for k, v in json.loads(text or "{}").items() if k in known}
        return cls(**found)

    def with_overrides(self, **changes: object) -> ClassifyConfig:
        return replace(self, **{k: v for k, v in changes.items() if v is not None})
