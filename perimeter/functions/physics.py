"""Humidity and dead-fuel moisture relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnus coefficients, and the equilibrium-moisture polynomials by humidity branch.
MAGNUS_A, MAGNUS_B = 17.625, 243.04
DRY = (0.03229, 0.281073, -0.000578)
MID = (2.22749, 0.160107, -0.014784)
WET = (21.0606, 0.005565, -0.00035, -0.483199)


def _clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def humidity_from_dewpoint(t_k: Column, td_k: Column) -> Column:
    """Relative humidity in percent from temperature and dewpoint in kelvin (Magnus form)."""
    def saturation(k: Column) -> Column:
        c = k - 273.15
        return F.exp(c * MAGNUS_A / (c + MAGNUS_B))
    return _clip(saturation(td_k) / saturation(t_k) * 100.0, 0.0, 100.0)


def fuel_moisture(t_k: Column, rh: Column) -> Column:
    """Ten-hour dead fuel moisture in percent from the Fosberg equilibrium relations."""
    f = (t_k - 273.15) * 9.0 / 5.0 + 32.0
    h = _clip(rh, 0.0, 100.0)
    emc = (F.when(h < 10, DRY[0] + h * DRY[1] + h * f * DRY[2])
           .when(h < 50, MID[0] + h * MID[1] + f * MID[2])
           .otherwise(WET[0] + h * h * WET[1] + h * f * WET[2] + h * WET[3]))
    return _clip(emc * 1.28, 1.0, 40.0)
