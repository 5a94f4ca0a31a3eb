"""Settings of a repair run, checked, and a manifest of them."""

from __future__ import annotations

import dataclasses
import json


#: Settings that may be off, and the word for that.
NONE_WORDS = {"add_threshold": "none", "delete_threshold": "none", "cap_scale": "exempt"}


@dataclasses.dataclass(frozen=True)
class Settings:
    max_link_um: float = 14.0
    most_in_frame: int = 2600
    jump_factor: float = 2.0
    gap2_frame_part: float = 0.006
    gap2_link_part: float = 0.0045
    fill_longest: int = 3
    fill_part: float = 0.03
    readmit_um: float = 4.0
    division_frame_part: float = 0.0076
    division_link_part: float = 0.00375
    smoothing_weight: float = 0.8
    consensus_um: float = 1.625
    add_threshold: float | None = 0.3
    delete_threshold: float | None = 0.01
    cap_scale: float | None = None

    def __post_init__(self):
        for f in dataclasses.fields(self):
            value = getattr(self, f.name)
            if value is None and f.name in NONE_WORDS:
                continue
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value < 0:
                raise ValueError(f"{f.name} must be a number of at least 0, not {value!r}")
        if self.smoothing_weight > 1:
            raise ValueError("smoothing_weight must be at most 1")

    @classmethod
    def of(cls, values: dict[str, str]) -> Settings:
        """From texts by name; unknown names are errors."""
        kinds = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        if unknown := set(values) - set(kinds):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: None if v.strip().lower() == NONE_WORDS.get(k) else (float if k in NONE_WORDS else kinds[k])(v) for k, v in values.items()})

    def differs(self, expected: Settings) -> dict[str, tuple[float, float]]:
        """Settings that are not the expected ones: name to both values."""
        pairs = {f.name: (getattr(self, f.name), getattr(expected, f.name)) for f in dataclasses.fields(self)}
        return {k: v for k, v in pairs.items() if (None in v and v[0] is not v[1]) or (None not in v and abs(v[0] - v[1]) > 1e-12)}

    def manifest(self, **more) -> str:
        return json.dumps(dataclasses.asdict(self) | more, sort_keys=True, indent=1)
