"""Settings of the matcher, checked in the order in which each operation reports errors."""

from __future__ import annotations

from dataclasses import dataclass


def check_share(name: str, value: float) -> float:
    if not 0.0 <= value <= 1.0:  # NaN fails too
        raise ValueError(f"{name} must be between 0 and 1, not {value}")
    return float(value)


@dataclass(frozen=True)
class Normal:
    """How names are normalized before they are compared."""

    token_sort: bool = False
    strip_suffixes: bool = False
    turkish: bool = False


@dataclass(frozen=True)
class Rules:
    """What else a pair within the threshold must meet."""

    numbers_must_match: bool = False
    word_threshold: float | None = None
    turkish: bool = False

    def __post_init__(self):
        if self.word_threshold is not None:
            check_share("word_threshold", self.word_threshold)


def check_method(method: str) -> str:
    if method not in ("auto", "indexed", "brute"):
        raise ValueError(f"method must be 'auto', 'indexed' or 'brute', not {method!r}")
    return method
