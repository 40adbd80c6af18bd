"""Feedback rows: cleaning, labels, contradictions, priorities and gates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The harmful classes, the safe class and statuses that are not labels.
HARMFUL = ("poison_ivy", "poison_oak", "poison_sumac")
SAFE = "safe_plants"
SKIPPED = ("discarded", "none", "")


def normalize_confidence(raw: Column) -> Column:
    """Number in 0..1: percentages are divided by 100; what is no finite number is null."""
    x = raw.try_cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    share = F.when(finite > 1, finite / 100).otherwise(finite)
    return F.when(share < 0, 0.0).when(share > 1, 1.0).otherwise(share)


def sanitize_stem(name: Column) -> Column:
    """Runs of other characters than letters, digits, dot, dash become one underscore."""
    return F.when(F.coalesce(name, F.lit("")) == "", "unnamed").otherwise(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"))


def resolve_label(status: Column, original: Column, corrected: Column) -> Column:
    """The label that the feedback stands for; null if it has none."""
    label = F.when(status == "confirmed", original).when(status == "corrected", F.coalesce(F.when(corrected != "", corrected), original))
    return F.when(label == "not_a_plant", SAFE).when(label.isin(*HARMFUL, SAFE), label)


def resolve(status: Column, original: Column, corrected: Column, synthetic: Column) -> Column:
    """Struct (label, status, error): a trainable label, or why there is none; without label and error a row is skipped.

    Made-up rows are skipped, never errors. A correction that names nothing confirms.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    state = F.lower(blank(status))
    named = F.when(state == "confirmed", blank(original)).when(state == "corrected", F.coalesce(F.nullif(blank(corrected), F.lit("")), blank(original)))
    label = F.when(named == "not_a_plant", SAFE).otherwise(named)
    made_up = F.coalesce(synthetic, F.lit(False)) | state.startswith("synthetic")
    skipped = made_up | state.isin(*SKIPPED)
    error = (
        F.when(skipped, None)
        .when(named.isNull(), F.concat(F.lit("unknown status "), state))
        .when(label == "", "no label")
        .when(~label.isin(*HARMFUL, SAFE), F.concat(F.lit("label can't be trained: "), label))
    )
    return F.struct(F.when(~skipped & error.isNull(), label).alias("label"), F.when(made_up, "synthetic").otherwise(state).alias("status"), error.alias("error"))


def parse_timestamp(raw: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 text; without a zone it is taken as UTC, otherwise null if it can't be read."""
    text = F.trim(raw)
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.contains(":")
    at = F.when(zoned, text).when(text.contains(":"), F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("T00:00:00Z")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_micros(at.try_cast("timestamp")))


def _short(x: Column, places: int) -> Column:
    """A rounded number in the shortest decimal form, with one place at least."""
    plain = F.rtrim(F.round(x, places).cast(f"decimal(20,{places})").cast("string"), F.lit("0"))
    return F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)


def observation_group(latitude: Column, longitude: Column, micros: Column, filename: Column, places: int = 4, minutes: int = 10) -> Column:
    """Id of the plant that a photo shows: its rounded place and time bucket, or the file alone where either is missing.

    Exactly 0, 0 stands for no place.
    """
    lat, lng = latitude.try_cast("double"), longitude.try_cast("double")
    there = ~F.isnan(lat) & ~F.isnan(lng) & ((F.abs(lat) > 1e-9) | (F.abs(lng) > 1e-9)) & (F.abs(lat) <= 90) & (F.abs(lng) <= 180)
    bucket = F.floor(micros / F.lit(60_000_000 * max(1, minutes))).cast("string")
    key = F.concat_ws(",", _short(lat, places), _short(lng, places), bucket)
    usable = F.coalesce(there, F.lit(False)) & micros.isNotNull()
    short = lambda c: F.substring(F.sha1(c), 1, 12)
    return F.when(usable, F.concat(F.lit("fb_obs_"), short(key))).otherwise(F.concat(F.lit("fb_single_"), short(filename)))


def inside(path: Column) -> Column:
    """Whether a relative path, its ``.`` and ``..`` resolved, never ends above the folder that it starts in; links aren't followed.

    A path that leaves the folder counts as outside even if it comes back by the folder's name.
    """
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda a, x: F.struct(
            (a["at"] + F.when(x.isin("", "."), 0).when(x == "..", -1).otherwise(1)).alias("at"),
            F.least(a["least"], a["at"] + F.when(x == "..", -1).otherwise(0)).alias("least"),
        ),
    )
    return ~path.startswith("/") & (depth["least"] >= 0)


# Fixed value: the confidence from which a row is taken by the policy high-confidence.
LEAST_TRUSTED = 0.70


def trusted(policy: str, status: Column, confidence: Column, least: float = LEAST_TRUSTED) -> Column:
    """Whether a policy takes a labelled row for training: all, corrections-only or high-confidence."""
    if policy == "all":
        return F.lit(True)
    if policy == "corrections-only":
        return status == "corrected"
    if policy == "high-confidence":
        return F.coalesce(confidence >= least, F.lit(False))
    raise ValueError(f"no trust policy {policy}")


def contradiction(original: Column, label: Column) -> Column:
    """How a label contradicts the prediction."""
    harmful = lambda c: c.isin(*HARMFUL)
    known = original.isin(*HARMFUL, SAFE)
    return (
        F.when(original == label, "none")
        .when(~F.coalesce(known, F.lit(False)), "unknown_origin")
        .when(harmful(original) & (label == SAFE), "toxic_to_safe")
        .when((original == SAFE) & harmful(label), "safe_to_toxic")
        .otherwise("toxic_to_toxic")
    )


def priority(status: Column, confidence: Column, direction: Column, label: Column) -> Column:
    """Corrections first, and more so where a harmful plant was taken for a safe one."""
    c = F.coalesce(confidence, F.lit(0.5))
    base = F.when(status == "corrected", 1 + c).otherwise(0.3 + (1 - c))
    ivy_or_oak = F.when(label.isin("poison_ivy", "poison_oak"), 0.25).otherwise(0.0)
    extra = F.when(direction == "safe_to_toxic", 1.0 + ivy_or_oak).when(direction == "toxic_to_safe", 0.5).when(direction == "unknown_origin", 0.25).otherwise(0.0)
    return base + extra


def gate(direction: Column, label: Column, confidence: Column, bound: float = 0.70, all_demotions: bool = False) -> Column:
    """True where a person has to look: a doubtful or confident demotion to safe."""
    demoted = (direction == "toxic_to_safe") & (F.lit(all_demotions) | confidence.isNull() | (confidence >= bound))
    return F.coalesce(demoted | ((direction == "unknown_origin") & (label == SAFE)), F.lit(False))
