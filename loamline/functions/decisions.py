"""Decision rules on class probabilities, as column expressions.

``probs`` are arrays with the harmful classes first and the safe class last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base thresholds of the three harmful classes, of others, and the margin below them.
BASE_THRESHOLDS = (0.40, 0.40, 0.52)
DEFAULT_THRESHOLD, MARGIN, LOWEST, HIGHEST = 0.50, 0.20, 0.15, 0.95


def softmax(z: Column, temperature: float = 1.0) -> Column:
    """Probabilities of logits, shifted by the largest."""
    e = F.transform(z, lambda x: F.exp((x - F.array_max(z)) / temperature))
    return F.transform(F.array(e), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, b: a + b)))[0]


def energy(z: Column) -> Column:
    """Minus the log of the summed exponentials of logits."""
    return -(F.array_max(z) + F.ln(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(z)))))


def argmax(probs: Column) -> Column:
    """Place of the largest value; the first of equal ones."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def alert_threshold(cls: Column, sensitivity: float = 0.5) -> Column:
    """Threshold of a class, moved by the sensitivity and held between the limits."""
    base = F.coalesce(F.get(F.array(*[F.lit(x) for x in BASE_THRESHOLDS]), cls), F.lit(DEFAULT_THRESHOLD))
    return F.least(F.greatest(base + (sensitivity - 0.5), F.lit(LOWEST)), F.lit(HIGHEST))


def severity(confidence: Column, threshold: Column) -> Column:
    """alert, uncertain or ignore."""
    return F.when(confidence >= threshold, "alert").when(confidence >= threshold - MARGIN, "uncertain").otherwise("ignore")


def decide(probs: Column, sensitivity: float = 0.5) -> Column:
    """safe if the last class leads, else the severity of the leading class."""
    top = argmax(probs)
    return F.when(top == F.size(probs) - 1, "safe").otherwise(severity(F.array_max(probs), alert_threshold(top, sensitivity)))


def app_severity(probs: Column) -> Column:
    """What the app does: ignore if the strongest harmful class is below the safe one, else its severity; a tie alerts."""
    harmful = F.slice(probs, 1, F.size(probs) - 1)
    top = F.array_max(harmful)
    return F.when(top < F.element_at(probs, -1), "ignore").otherwise(severity(top, alert_threshold(argmax(harmful))))


def emitted(probs: Column) -> Column:
    """Whether a live frame gives a row at all: a harmful class must beat the safe one."""
    return F.array_max(F.slice(probs, 1, F.size(probs) - 1)) > F.element_at(probs, -1)


def ranking_scores(probs: Column, classes: int = 4) -> dict[str, tuple[Column, Column]]:
    """Strategy: (score of which the highest comes first, value in the strategy's own unit)."""
    import math

    safe = safety_score(probs)
    return {
        "margin": (1 - margin(probs), margin(probs)),
        "least_confidence": (least_confidence(probs), least_confidence(probs)),
        "entropy": (entropy(probs) / math.log(classes), entropy(probs)),
        "safety": (safe, safe),
    }


def alert_level(confidence: Column) -> Column:
    """low, medium or high."""
    return F.when(confidence < 0.75, "low").when(confidence < 0.90, "medium").otherwise("high")


def least_confidence(probs: Column) -> Column:
    return 1 - F.array_max(probs)


def margin(probs: Column) -> Column:
    """Lead of the first class over the second."""
    s = F.sort_array(probs, asc=False)
    return s[0] - s[1]


def entropy(probs: Column) -> Column:
    """In nats; probabilities count as 1e-12 at least."""
    return F.aggregate(probs, F.lit(0.0), lambda a, p: a - F.greatest(p, F.lit(1e-12)) * F.ln(F.greatest(p, F.lit(1e-12))))


def safety_score(probs: Column, window: float = 0.20, w_boundary: float = 0.7, w_threshold: float = 0.3) -> Column:
    """How near a row is to the line between harmful and safe, and to its alert threshold."""
    if window <= 0 or min(w_boundary, w_threshold) < 0 or w_boundary + w_threshold <= 0:
        raise ValueError("the window must be above 0, and the weights not below 0 nor both 0")
    safe = F.element_at(probs, -1)
    harmful = F.slice(probs, 1, F.size(probs) - 1)
    top = argmax(harmful)
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.array_max(harmful) - alert_threshold(top)) / window)
    toxic = F.aggregate(harmful, F.lit(0.0), lambda a, x: a + x)
    total = w_boundary + w_threshold
    return (w_boundary / total) * 2 * F.least(toxic, safe) + (w_threshold / total) * near
