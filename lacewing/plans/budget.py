"""Edit budgets and segment tables; both depend on lengths alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def max_edits(length: int, threshold: float) -> int:
    """The largest k with k / length <= threshold, in double arithmetic."""
    if not length:
        return 0
    k = min(length, int(threshold * length))
    while k and k / length > threshold:
        k -= 1
    while k < length and (k + 1) / length <= threshold:
        k += 1
    return k


def stored_budgets(length: int, threshold: float) -> list[int]:
    """The budgets that any longer name can need against a stored name of this length."""
    return sorted({k for L in range(length, 2 * length + 2) if L - (k := max_edits(L, threshold)) <= length and length > k})


def segment_start(length: Column, k: Column, seg: Column) -> Column:
    """Start of a segment, from 0, when a string is cut in k + 1 even segments, the last ones longer by one."""
    return (seg * F.floor(length / (k + 1)) + F.greatest(F.lit(0), seg - (k + 1 - length % (k + 1)))).cast("int")


def segment_length(length: Column, k: Column, seg: Column) -> Column:
    return (F.floor(length / (k + 1)) + (seg >= k + 1 - length % (k + 1)).cast("int")).cast("int")


def segment_places(small: int, big: int, k: int) -> list[tuple[int, int, int, int]]:
    """(start, size, lo, hi) of each segment of a string of length small cut in k + 1, and where it may stand in one of length
    big; nowhere where lo is above hi."""
    out, even, longer = [], small // (k + 1), k + 1 - small % (k + 1)
    for seg in range(k + 1):
        start, size, gap = seg * even + max(0, seg - longer), even + (seg >= longer), big - small
        out.append((start, size, max(start - seg, start + gap - (k - seg), 0), min(start + seg, start + gap + (k - seg), big - size)))
    return out
