"""Panel efficiency from an energy balance, solved for each row in NumPy batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Physical constants of the balance.
SIGMA = 5.670374419e-8
K_AIR = 0.026
NU = 1.57e-5
PRANDTL = 0.707
PANEL_M = 1.5
ALBEDO = 0.2
T_REF = 298.0
EFF_REF = 0.135
EFF_SLOPE = 0.0051


def balance(tp: np.ndarray, sun: np.ndarray, ta: np.ndarray, wind: np.ndarray, vapour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Net flux of a panel at temperature ``tp`` (K) and its derivative. The ground radiates as a black body at air temperature."""
    h = 0.036 * (K_AIR / PANEL_M) * (wind * PANEL_M / NU) ** 0.8 * PRANDTL ** (1 / 3)
    sky = 1.24 * SIGMA * (vapour / ta) ** (1 / 7) * ta**4
    eff = EFF_REF * (1 - EFF_SLOPE * (tp - T_REF))
    flux = (1 - ALBEDO - eff) * sun + sky + SIGMA * ta**4 - 2 * SIGMA * tp**4 - 2 * h * (tp - ta)
    return flux, EFF_REF * EFF_SLOPE * sun - 8 * SIGMA * tp**3 - 2 * h


def panel_efficiency(df: DataFrame, key: str, sun: str, air: str, wind: str, vapour: str, rounds: int = 25, within: float = 1e-9) -> DataFrame:
    """(key, panel_k, efficiency) by Newton steps from five kelvin above air; null where they do not settle."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s, a, w, v = (b[c].to_numpy(np.float64) for c in (sun, air, wind, vapour))
            tp = a + 5.0
            with np.errstate(all="ignore"):
                for _ in range(rounds):
                    f, slope = balance(tp, s, a, w, v)
                    tp = tp - f / slope
                good = np.abs(balance(tp, s, a, w, v)[0]) <= within * (1 + np.abs(s))
            yield pd.DataFrame({key: b[key], "panel_k": np.where(good, tp, np.nan), "efficiency": np.where(good, EFF_REF * (1 - EFF_SLOPE * (tp - T_REF)), np.nan)})

    kind = df.schema[key].dataType.simpleString()
    out = df.select(key, sun, air, wind, vapour).mapInPandas(solve, f"`{key}` {kind}, panel_k double, efficiency double")
    return out.selectExpr(key, "nullif(panel_k, double('NaN')) as panel_k", "nullif(efficiency, double('NaN')) as efficiency")
