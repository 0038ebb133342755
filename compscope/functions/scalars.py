"""Scalar helpers used across the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def seeded_hash(seed: int | Column, *parts: Column) -> Column:
    """Engine-independent hash text: md5 of ``seed|part|part``."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), *[p.cast("string") for p in parts]))


def hash_to_int(md5_text: Column, start: int = 1) -> Column:
    """32 bits of an md5 text, from hex digit ``start``, as a bigint."""
    return F.conv(F.substring(md5_text, start, 8), 16, 10).cast("bigint")


def round_half_even(col: Column, digits: int) -> Column:
    """Round the scaled double half to even, as numeric array libraries do."""
    scale = F.lit(10.0**digits)
    return F.rint(col * scale) / scale


def clip_vector(vec: Column, limit: float = 1e5) -> Column:
    """Per element: NaN and null become 0, then clip to ``[-limit, limit]``."""
    lo, hi = F.lit(-float(limit)), F.lit(float(limit))
    return F.transform(
        vec,
        lambda x: F.greatest(
            lo, F.least(hi, F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))
        ),
    )


def binarise(col: Column, threshold: float | Column, inclusive: bool = False) -> Column:
    """Positive class: strictly above the threshold, or at it too when ``inclusive``."""
    return (col >= threshold) if inclusive else (col > threshold)


def class_name(positive: Column) -> Column:
    return F.when(positive, F.lit("high")).otherwise(F.lit("low"))


def prediction_label(predicted: Column, observed: Column | None = None) -> Column:
    """Text label of a scored row, two decimals (decimal digits round half up)."""
    if observed is None:
        return F.format_string("pred: %.2f", predicted)
    return F.format_string("exp: %.2f | pred: %.2f", observed, predicted)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or ``wanted_pred`` when a column of that name exists already."""
    return f"{wanted}_pred" if wanted in columns else wanted
