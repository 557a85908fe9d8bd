"""Arithmetic of formulas: (value, error) pairs of Columns; an error column is a spelling or NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cells import DIV0, NUM

NO_ERROR = F.lit


def none() -> Column:
    return F.lit(None).cast("string")


def divide(x: Column, y: Column) -> tuple[Column, Column]:
    return F.try_divide(x.cast("double"), y.cast("double")), F.when(y == 0, DIV0)


def power(x: Column, y: Column) -> tuple[Column, Column]:
    p = F.pow(x, y)
    bad = F.isnan(p) | ((x == 0) & (y < 0))
    return F.when(~bad, p), F.when(bad, NUM)


def sqrt(x: Column) -> tuple[Column, Column]:
    return F.when(x >= 0, F.sqrt(x)), F.when(x < 0, NUM)


def ln(x: Column) -> tuple[Column, Column]:
    return F.when(x > 0, F.log(x)), F.when(x <= 0, NUM)


def log10(x: Column) -> tuple[Column, Column]:
    return F.when(x > 0, F.log10(x)), F.when(x <= 0, NUM)


def round_half_away(x: Column, digits: Column | int = 0) -> Column:
    """Scaled in binary and rounded half away from zero, so 1.005 to two places is 1.0."""
    factor = F.pow(F.lit(10.0), F.lit(digits) if isinstance(digits, int) else F.floor(digits))
    y = x * factor
    return F.signum(y) * F.floor(F.abs(y) + 0.5) / factor


def floor_step(x: Column, step: Column) -> tuple[Column, Column]:
    return F.floor(F.try_divide(x, step)) * step, F.when(step == 0, DIV0)


def ceiling_step(x: Column, step: Column) -> tuple[Column, Column]:
    return F.ceil(F.try_divide(x, step)) * step, F.when(step == 0, DIV0)


def error_type(err: Column) -> Column:
    """1 to 9 by the list of errors; NULL for no error."""
    from ..cells import ERRORS

    out = F.when(F.lit(False), F.lit(0))
    for k, spelling in enumerate(ERRORS, 1):
        out = out.when(err == spelling, F.lit(k))
    return out
