"""Shares of a group's units, calibrated to its published means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def calibrated_shares(prior: np.ndarray, means: np.ndarray, target: np.ndarray, ridge: float = 1e-3, low: float = 0.2, high: float = 5.0, passes: int = 25) -> np.ndarray:
    """Shares s near the prior s0, with sum 1 and low <= s / s0 <= high, whose weighted means come near the target.

    Minimises sum((s - s0)^2 / s0) + |means' s - target|^2 / ridge; shares that leave their bounds are held there and the
    others solved again.
    """
    s0 = prior / prior.sum()
    ok = ~np.isnan(target) & ~np.isnan(means).any(axis=0)
    p, t = means[:, ok], target[ok]
    s, held = s0.copy(), np.zeros(len(s0), bool)
    for _ in range(passes):
        free = ~held
        if not free.any():
            break
        q, z, w = p[free], t - p[held].T @ s[held], s0[free]
        left = 1 - s[held].sum()
        a = np.diag(2 / w) + 2 / ridge * q @ q.T
        b = 2 * np.ones(free.sum()) + 2 / ridge * q @ z
        whole = np.block([[a, np.ones((len(w), 1))], [np.ones((1, len(w))), np.zeros((1, 1))]])
        s[free] = np.linalg.solve(whole, np.append(b, left))[:-1]
        out = free & ((s < low * s0) | (s > high * s0))
        if not out.any():
            break
        s = np.clip(s, low * s0, high * s0)
        held |= out
    return within(s, low * s0, high * s0)


def within(s: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The shares moved alike until they add up to one inside their bounds (least adds up to one at most, most to one at least)."""
    below, above = (least - s).min(), (most - s).max()
    for _ in range(100):
        middle = (below + above) / 2
        below, above = (middle, above) if np.clip(s + middle, least, most).sum() < 1 else (below, middle)
    return np.clip(s + above, least, most)


def calibrate(units: DataFrame, targets: DataFrame, group: str, unit: str, prior: str, columns: list[str]) -> DataFrame:
    """(group, unit, share, status) for every unit. Groups are of bounded size (a town's wards) and solved in parallel."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(unit)
        target = rows[[f"target_{c}" for c in columns]].iloc[0].to_numpy(float)
        weights = np.nan_to_num(rows[prior].to_numpy(float), nan=1.0)
        weights = np.where(weights > 0, weights, 1.0)
        if len(rows) == 1:
            share, status = np.ones(1), "single"
        elif np.isnan(target).all():
            share, status = weights / weights.sum(), "prior"
        else:
            share, status = calibrated_shares(weights, rows[columns].to_numpy(float), target), "calibrated"
        return pd.DataFrame({group: rows[group], unit: rows[unit], "share": share, "status": status})

    joined = units.join(targets.selectExpr(group, *[f"{c} as target_{c}" for c in columns]), group, "left")
    kinds = dict(units.dtypes)
    return joined.groupBy(group).applyInPandas(solve, f"{group} {kinds[group]}, {unit} {kinds[unit]}, share double, status string")
