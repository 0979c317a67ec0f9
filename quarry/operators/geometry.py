"""Rigid superposition of point sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rotations(h: np.ndarray) -> np.ndarray:
    """The proper rotations that best map centred sets onto others, from their covariances (n, 3, 3), decomposed in one call;
    identity where a covariance isn't finite."""
    usable = np.isfinite(h).all((1, 2))
    u, _, vt = np.linalg.svd(np.where(usable[:, None, None], h, np.eye(3)))
    v, ut = vt.transpose(0, 2, 1), u.transpose(0, 2, 1)
    v[:, :, 2] *= np.where(np.linalg.det(v @ ut) < 0, -1.0, 1.0)[:, None]
    return np.where(usable[:, None, None], v @ ut, np.eye(3))


def superpositions(mobile: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations (n, 3, 3) and shifts (n, 3) that bring each mobile set (n, k, 3) onto its target, over the points in its
    mask (n, k)."""
    weight = mask[..., None].astype(float)
    n = np.maximum(weight.sum(1), 1.0)
    mobile, target = np.where(weight > 0, mobile, 0.0), np.where(weight > 0, target, 0.0)
    cm, ct = mobile.sum(1) / n, target.sum(1) / n
    turn = rotations(np.einsum("nki,nkj->nij", (mobile - cm[:, None]) * weight, target - ct[:, None]))
    return turn, ct - np.einsum("nij,nj->ni", turn, cm)


def aligned_rmsd(pairs: DataFrame, group: str, mobile: tuple[str, str, str], target: tuple[str, str, str]) -> DataFrame:
    """(group, n, rmsd) after optimal superposition. Spark sums the moments of each group, so a group of any size is
    one row; only the 3 x 3 decomposition is done in Python."""
    m, t = [F.col(c).cast("double") for c in mobile], [F.col(c).cast("double") for c in target]
    sums = [F.sum(x).alias(f"m{i}") for i, x in enumerate(m)] + [F.sum(x).alias(f"t{i}") for i, x in enumerate(t)]
    sums += [F.sum(x * y).alias(f"h{i}{j}") for i, x in enumerate(m) for j, y in enumerate(t)]
    sums += [F.sum(sum((x * x for x in m), F.lit(0.0))).alias("mm"), F.sum(sum((x * x for x in t), F.lit(0.0))).alias("tt")]
    moments = pairs.groupBy(group).agg(F.count("*").alias("n"), *sums)

    @F.pandas_udf("double")
    def solve(s: pd.DataFrame) -> pd.Series:
        n = s["n"].to_numpy(float)
        cm, ct = (s[[f"{c}{i}" for i in range(3)]].to_numpy(float) / n[:, None] for c in "mt")
        h = s[[f"h{i}{j}" for i in range(3) for j in range(3)]].to_numpy(float).reshape(-1, 3, 3) - n[:, None, None] * cm[:, :, None] * ct[:, None, :]
        spread = s["mm"] + s["tt"] - n * ((cm**2).sum(1) + (ct**2).sum(1))
        fit = np.einsum("nij,nji->n", rotations(h), h)
        return pd.Series(np.sqrt(np.maximum(0.0, spread - 2 * fit) / n))

    return moments.select(group, "n", solve(F.struct(*(c for c in moments.columns if c != group))).alias("rmsd"))
