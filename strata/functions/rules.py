"""Classifications and penalties as column expressions; every threshold is a parameter with its default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST_FOLDERS = ("tests", "test", "benchmark")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def size_name(files: Column) -> Column:
    return F.when(files < 3, "Micro").when(files <= 10, "Small").when(files <= 50, "Medium").otherwise("Large")


def size_rule(files: Column, lines: Column) -> Column:
    """The size class before density is looked at."""
    small = (files <= 50) & (lines <= 50_000)
    return F.when(small, "small_project").when((files <= 300) & (lines <= 200_000), "mid_project").otherwise("large_framework")


def structural_class(files: Column, lines: Column, dense: float = 250.0) -> Column:
    base = size_rule(files, lines)
    return F.when((base == "large_framework") & (ratio(lines, files) >= dense), "core_engine").otherwise(base)


def class_rule(kind: Column) -> Column:
    return F.when(kind == "small_project", "size_small").when(kind == "mid_project", "size_mid").when(kind == "core_engine", "core_engine_dense_large").otherwise("size_large")


def cycle_type(n: Column) -> Column:
    return F.when(n == 2, "tight_coupling").when(n <= 5, "layer_leak").otherwise("structural_cycle")


def cycle_penalty(n: Column, base: Column) -> Column:
    """Grows with the logarithm of the cycle's size, rounded half to even."""
    return F.when(n > 1, F.rint(base * F.ln(n) / F.ln(F.lit(2.0)))).otherwise(0).cast("long")


def long_penalty(lines: Column, low: Column, high: Column, low_points: Column, high_points: Column) -> Column:
    return F.when(lines > high, high_points).when(lines > low, low_points).otherwise(0)


def cross_penalty(share: Column, low: Column, high: Column, low_points: Column, high_points: Column) -> Column:
    return F.when(share > high, high_points).when(share > low, low_points).otherwise(0)


def coupling_level(share: Column, top_folder: Column, tests: tuple[str, ...] = TEST_FOLDERS) -> Column:
    """Level of a cross-folder share, one lower where the most coupled folder is a test folder."""
    base = coupling_base(share)
    lower = F.lower(top_folder).isin(*tests)
    return F.when(lower & (base == "high"), "moderate").when(lower & (base == "moderate"), "low").otherwise(base)


def coupling_base(share: Column) -> Column:
    return F.when(share > 0.4, "high").when(share > 0.25, "moderate").otherwise("low")


def adjusted_score(score: Column, cycles: Column, growth: Column, level: Column) -> Column:
    """A reviewer's score less what the measured risks cost, within 0 to 100."""
    by_cycle = F.when(cycles <= 0, 0).when(cycles == 1, 15).otherwise(25)
    growth = F.least(F.greatest(growth, F.lit(0)), F.lit(4))
    by_growth = F.when(growth >= 3, 15).when(growth >= 2, 5).otherwise(0)
    level = F.lower(level)
    by_level = F.when(level == "high", 10).when(level == "moderate", 5).otherwise(0)
    return F.least(F.greatest(score - by_cycle - by_growth - by_level, F.lit(0)), F.lit(100))
