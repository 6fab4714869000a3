"""Audit settings as one plain, immutable parameter object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Weights:
    """Share of each factor in a column score."""

    completeness: float = 0.40
    uniqueness: float = 0.20
    consistency: float = 0.20
    outlier: float = 0.20


@dataclass(frozen=True)
class Grades:
    """Lowest score of each grade."""

    excellent: int = 85
    good: int = 70
    fair: int = 50
    poor: int = 30


@dataclass(frozen=True)
class Settings:
    """``duplicate_subset`` is "all" for whole rows, or the columns that identify a row."""

    weights: Weights = field(default_factory=Weights)
    grades: Grades = field(default_factory=Grades)
    iqr_multiplier: float = 1.5
    duplicate_subset: str | tuple[str, ...] = "all"

    @property
    def subset(self) -> list[str] | None:
        return None if self.duplicate_subset == "all" else list(self.duplicate_subset)


DEFAULTS = Settings()
