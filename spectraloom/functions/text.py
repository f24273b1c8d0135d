"""Labels for names, effect sizes and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectraloom.functions.arrays import is_finite


# fixed values: characters dropped from names
DROPPED = "\"':*?<>| "


def safe_name(text: Column) -> Column:
    """Names fit for files and features: a slash reads ``_over_``, a backslash ``_``."""
    spelled = F.replace(F.replace(text, F.lit("/"), F.lit("_over_")), F.lit("\\"), F.lit("_"))
    return F.translate(spelled, DROPPED, "")


def safe_label(text: str) -> str:
    """``safe_name`` for names known when the plan is built."""
    spelled = text.replace("/", "_over_").replace("\\", "_")
    return spelled.translate({ord(c): None for c in DROPPED})


def format_delta(delta: Column) -> Column:
    """Signed effect size with two digits; empty when undefined."""
    return F.when(is_finite(delta), F.concat(F.lit("δ="), F.format_string("%+.2f", delta))).otherwise("")


def format_percent(share: Column, digits: int = 1) -> Column:
    """A share in [0, 1] as a percentage; ``n/a`` when undefined."""
    return F.when(is_finite(share), F.format_string(f"%.{digits}f%%", share * 100.0)).otherwise("n/a")
