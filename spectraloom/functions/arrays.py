"""Column expressions over ``array<double>`` spectra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def is_finite(value: Column) -> Column:
    """True for ordinary numbers; false for NULL, NaN and both infinities."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(INF)), F.lit(False))


def null_if_not_finite(value: Column) -> Column:
    return F.when(is_finite(value), value)


def all_finite(spectrum: Column) -> Column:
    return F.forall(spectrum, is_finite)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def l2_norm(spectrum: Column) -> Column:
    return F.sqrt(total(F.transform(spectrum, lambda x: x * x)))


def l1_norm(spectrum: Column) -> Column:
    return total(F.transform(spectrum, F.abs))


def max_abs(spectrum: Column) -> Column:
    return F.array_max(F.transform(spectrum, F.abs))


def divide_all(spectrum: Column, by: Column) -> Column:
    return F.transform(spectrum, lambda x: F.try_divide(x, by))


def add_all(spectrum: Column, offset: Column) -> Column:
    return F.transform(spectrum, lambda x: x + offset)


def literal_array(values: Sequence[float]) -> Column:
    """A constant array, parsed from one SQL text rather than built element by element."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def _runs(indices: Sequence[int]) -> list[list[int]]:
    """[start, length] of consecutive indices."""
    runs: list[list[int]] = []
    for i in indices:
        if runs and i == runs[-1][0] + runs[-1][1]:
            runs[-1][1] += 1
        else:
            runs.append([i, 1])
    return runs


def pick(spectrum: Column, indices: Sequence[int]) -> Column:
    """Elements at 0-based ``indices``; consecutive runs become one ``slice``."""
    parts = [F.slice(spectrum, start + 1, length) for start, length in _runs(indices)]
    if not parts:
        return F.array().cast("array<double>")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def pick_text(column: str, indices: Sequence[int]) -> str:
    """``pick`` as SQL text over a named column: one call where many bands are read."""
    parts = [f"slice({column}, {start + 1}, {length})" for start, length in _runs(indices)]
    if not parts:
        return "CAST(array() AS array<double>)"
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def finite_text(values: str) -> str:
    """SQL text for the finite entries of an array."""
    return f"filter({values}, x -> NOT isnan(x) AND abs(x) < double('infinity'))"


def hex_to_long(text: Column, start: int = 1, length: int = 8) -> Column:
    """Integer value of ``length`` hex digits (at most 15)."""
    return F.conv(F.substring(text, start, length), 16, 10).cast("bigint")


def hash_key(salt: str, *parts: Column | str) -> Column:
    """md5 over salted key parts: a repeatable stand-in for a random draw."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[F.col(p) if isinstance(p, str) else p for p in parts]))
