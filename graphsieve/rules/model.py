"""Rules as data: severities, confidence and the rule record."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from ..operators.query import Query


class _Ordered(IntEnum):
    @classmethod
    def parse(cls, text: str):
        """By name, in any case."""
        try:
            return cls[text.strip().lower()]
        except KeyError:
            raise ValueError(f"{text!r} is none of {', '.join(m.name for m in cls)}") from None


class Severity(_Ordered):
    info = 1
    low = 2
    medium = 3
    high = 4
    critical = 5


class Confidence(_Ordered):
    low = 1
    medium = 2
    high = 3


@dataclass(frozen=True)
class ScanRule:
    """A named query with what a report says about its matches."""

    name: str
    query: Query
    severity: Severity = Severity.medium
    confidence: Confidence = Confidence.high
    description: str = ""
    root_cause: str = ""
    impact: str = ""

    @property
    def rule_id(self) -> str:
        return "-".join("".join(c if c.isalnum() else " " for c in self.name.lower()).split())


@dataclass(frozen=True)
class SliceRule:
    """A sink pattern for backward slices."""

    name: str
    description: str
    sink_pattern: str
    languages: tuple[str, ...] = ()
    coverage: str = "precision"
