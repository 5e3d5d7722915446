"""Matrix descriptors of single structures and transport between pairs of them, in Arrow batches.

A structure is small (a few hundred atoms), so each row is worked on alone and memory follows the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 300


def coulomb_spectrum(atoms: list[dict], size: int) -> list[float]:
    """Eigenvalues of the Coulomb matrix, largest first, padded with zeros (or cut) to `size`."""
    if not atoms:
        return [0.0] * size
    z = np.array([a["z"] for a in atoms], float)
    x = np.array([[a["px"], a["py"], a["pz"]] for a in atoms])
    r = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    m = np.outer(z, z) / np.maximum(r, 1e-6)
    np.fill_diagonal(m, 0.5 * z**2.4)
    value = np.linalg.eigvalsh(m)[::-1][:size]
    return [*value.tolist(), *[0.0] * (size - len(value))]


def spectra(structures: DataFrame, size: int) -> DataFrame:
    """(gidx, spectrum) of (gidx, atoms)."""

    def work(batches):
        for batch in batches:
            out = [coulomb_spectrum(a or [], size) for a in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["gidx", "spectrum"])

    return structures.select("gidx", "atoms").mapInArrow(work, "gidx long, spectrum array<double>")


def profiles(atoms: list[dict], quantiles: int) -> tuple[np.ndarray, np.ndarray]:
    """Element and quantiles of the distances to all other atoms, for each atom."""
    x = np.array([[a["px"], a["py"], a["pz"]] for a in atoms])
    r = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    rest = r[~np.eye(len(x), dtype=bool)].reshape(len(x), -1) if len(x) > 1 else np.zeros((1, 1))
    return np.array([a["z"] for a in atoms]), np.quantile(rest, np.linspace(0, 1, quantiles), axis=1).T


def sinkhorn(cost: np.ndarray, sharpness: float = 50.0, rounds: int = ROUNDS) -> float:
    """Entropic transport cost between uniform weights, in the log domain; the sharpness is relative to the mean cost."""
    scale = cost.mean() or 1.0
    k = -cost * sharpness / scale
    a, b = np.full(cost.shape[0], -np.log(cost.shape[0])), np.full(cost.shape[1], -np.log(cost.shape[1]))
    f, g = np.zeros_like(a), np.zeros_like(b)
    for _ in range(rounds):
        f = a - np.logaddexp.reduce(k + g[None, :], axis=1)
        g = b - np.logaddexp.reduce(k + f[:, None], axis=0)
    return float((np.exp(k + f[:, None] + g[None, :]) * cost).sum())


def transport(pairs: DataFrame, alpha: float = 1.0, beta: float = 0.5, p: float = 2.0, quantiles: int = 8) -> DataFrame:
    """(i, j, d) of pairs (i, j, left, right) of atom arrays: alpha for another element, beta times the profile distance."""

    def work(batches):
        for batch in batches:
            out = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if not left or not right:
                    out.append(None)
                    continue
                (za, qa), (zb, qb) = profiles(left, quantiles), profiles(right, quantiles)
                cost = alpha * (za[:, None] != zb[None, :]) + beta * (np.abs(qa[:, None] - qb[None]) ** p).mean(-1) ** (1 / p)
                out.append(sinkhorn(cost))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["i", "j", "d"])

    return pairs.select("i", "j", "left", "right").mapInArrow(work, "i long, j long, d double")
