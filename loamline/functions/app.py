"""Small rules of the app: what is asked of a frame, a box, an alert and a setting, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.functions.decisions import severity

# The range of the sensitivity setting, and points around a box.
SENSITIVITY, PADDING = (0.3, 0.8), 4.0


def magnitude(*parts: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def frame_passes(trigger: Column, rate: Column, most: float) -> Column:
    """Whether a frame is sharp enough to look at: forced ones always, others unless the phone turns faster than ``most``."""
    return F.coalesce(trigger == "forced", F.lit(False)) | ~F.coalesce(rate > most, F.lit(False))


def healed(sensitivity: Column) -> Column:
    """A stored sensitivity, moved into the range that the app allows."""
    return F.least(F.greatest(sensitivity, F.lit(SENSITIVITY[0])), F.lit(SENSITIVITY[1]))


def guarded_severity(cls: Column, safe: int, confidence: Column, threshold: Column) -> Column:
    """Severity of a detection; a safe class and a confidence above 1 are ignored."""
    return F.when((cls >= safe) | (confidence > 1), "ignore").otherwise(severity(confidence, threshold))


def view_box(x: Column, y: Column, w: Column, h: Column, width: float, height: float) -> Column:
    """Struct (x, y, w, h) of a box in a view, in points: from shares counted from below to points from above, with some padding, cut at the view.

    A box beyond the view is all zeros.
    """
    left, top = x * width - PADDING, (1 - y - h) * height - PADDING
    right, bottom = left + w * width + 2 * PADDING, top + h * height + 2 * PADDING
    x0, y0 = F.greatest(left, F.lit(0.0)), F.greatest(top, F.lit(0.0))
    x1, y1 = F.least(right, F.lit(width)), F.least(bottom, F.lit(height))
    seen = (x1 >= x0) & (y1 >= y0)
    of = lambda c: F.when(seen, c).otherwise(0.0)
    return F.struct(of(x0).alias("x"), of(y0).alias("y"), of(x1 - x0).alias("w"), of(y1 - y0).alias("h"))
