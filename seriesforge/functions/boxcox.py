"""Box-Cox transform and its inverse as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def boxcox(y: Column, lam: Column) -> Column:
    """NULL lambda leaves ``y`` alone; the log needs ``y > 0`` and gives NULL otherwise."""
    log_y = F.when(y > 0, F.ln(y))
    power = F.when((y > 0) | ((y == 0) & (lam > 0)), (F.pow(y, lam) - 1) / lam)
    return F.when(lam.isNull(), y).when(lam == 0, log_y).otherwise(power)


def inverse_boxcox(z: Column, lam: Column) -> Column:
    base = z * lam + 1
    return (
        F.when(lam.isNull(), z)
        .when(lam == 0, F.exp(z))
        .otherwise(F.when(base > 0, F.pow(base, 1 / lam)))
    )
