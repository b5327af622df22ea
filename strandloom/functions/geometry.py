"""Column expressions on pairs of intervals (x1, x2) and (y1, y2). Ends may come in either order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the distance rules.
FAR_CENTRES = 2000
LENGTH_SLACK = 500


def _c(x: Column | str | int | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def overlaps(x1, x2, y1, y2) -> Column:
    """Closed intervals with x1 <= x2 and y1 <= y2 share a position."""
    return F.greatest(_c(x1), _c(y1)) <= F.least(_c(x2), _c(y2))


def shared_length(x1, x2, y1, y2) -> Column:
    x1, x2, y1, y2 = map(_c, (x1, x2, y1, y2))
    return F.greatest(F.lit(0), F.least(F.greatest(x1, x2), F.greatest(y1, y2)) - F.greatest(F.least(x1, x2), F.least(y1, y2)))


def min_fraction(x1, x2, y1, y2) -> Column:
    """Smaller of the two covered fractions, 0 if either interval has no length."""
    a, b = F.abs(_c(x2) - _c(x1)), F.abs(_c(y2) - _c(y1))
    shared = shared_length(x1, x2, y1, y2)
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(shared / F.greatest(a, b))


def reciprocal(x1, x2, y1, y2, least: float = 0.1) -> Column:
    """Both fractions above `least`; true if either interval has no length."""
    a, b = F.abs(_c(x2) - _c(x1)), F.abs(_c(y2) - _c(y1))
    return (a == 0) | (b == 0) | (min_fraction(x1, x2, y1, y2) > least)


def span(x1, x2) -> Column:
    return F.greatest(F.lit(1), F.abs(_c(x2) - _c(x1)))


def centre(x1, x2) -> Column:
    return (_c(x1) + _c(x2)) / 2


def centre_distance(x1, x2, y1, y2) -> Column:
    """Distance of the centres."""
    return F.abs(centre(x1, x2) - centre(y1, y2))


def span_difference(x1, x2, y1, y2) -> Column:
    """Difference of the spans over the longer one."""
    a, b = span(x1, x2), span(y1, y2)
    return F.abs(a - b) / F.greatest(a, b)


def alike_spans(x1, x2, y1, y2, norm: float, most: float, long_or_split: bool, len1=None, len2=None, trust_lengths: bool = False) -> Column:
    """Span-position rule (X04): centres within FAR_CENTRES, and for long reads or splits distance/norm + span difference
    under `most`, else both distance/longer span and span difference under it. With in-read lengths len1 and len2
    (trusted for insertions) these are the spans and the starts the centres, and they may not differ by over LENGTH_SLACK."""
    far, diff = centre_distance(x1, x2, y1, y2), span_difference(x1, x2, y1, y2)
    longest = F.greatest(span(x1, x2), span(y1, y2))
    ok = F.lit(True)
    if len1 is not None:
        l1, l2 = _c(len1), _c(len2)
        both = (l1 > 0) & (l2 > 0)
        ok = ~(both & (F.abs(l1 - l2) > LENGTH_SLACK))
        if trust_lengths:
            far = F.when(both, F.abs(_c(x1) - _c(y1))).otherwise(far)
            diff = F.when(both, F.abs(l1 - l2) / F.greatest(l1, l2)).otherwise(diff)
            longest = F.when(both, F.greatest(l1, l2)).otherwise(longest)
    near = (far / norm + diff < most) if long_or_split else (far / longest < most) & (diff < most)
    return ok & (far <= FAR_CENTRES) & near


def alike_spans_fixed(x1, x2, y1, y2) -> Column:
    """The variant with fixed thresholds 0.2 and 0.3."""
    far = centre_distance(x1, x2, y1, y2)
    return (far <= FAR_CENTRES) & (far / F.greatest(span(x1, x2), span(y1, y2)) < 0.2) & (span_difference(x1, x2, y1, y2) < 0.3)


def alike_spans_filter(x1, x2, y1, y2, far_most: float = 20.0, span_most: float = 0.3) -> Column:
    """The variant of the normal filter (X06): distance at least 1, over the longer span, and span difference."""
    far = F.greatest(F.lit(1.0), centre_distance(x1, x2, y1, y2))
    return (far / F.greatest(span(x1, x2), span(y1, y2)) < far_most) & (span_difference(x1, x2, y1, y2) < span_most)
