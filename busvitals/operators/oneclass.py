"""One-class machine on random Fourier features, trained on every normal window.

Instead of a kernel matrix over a sample, the kernel is approximated by D cosines and the primal objective
1/2 |w|^2 - rho + 1/(nu n) sum max(0, rho - w.phi(x)) is minimised. Blocks of rows are solved by Newton's method where they
lie; the driver only ever holds averages of D numbers, and a fit takes at most five passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators.kernel import scaler
from busvitals.operators.quantiles import exact_percentiles
from busvitals.sources.scratch import stored

DIMENSIONS = 256
ROUNDS = 2
ENOUGH = 1e-3
BLOCK_ROWS = 32_768
NEWTON_STEPS = 40
WIDTH = 1e-3  # over which the hinge is rounded
RIDGE = 1e-6
NEAR = 2.0
NU = 0.01


@dataclass(frozen=True)
class OneClassModel:
    mean: np.ndarray
    std: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    rho: float

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        return np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)


def ocsvm_fit(
    windows: DataFrame, nu: float = NU, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = fv.SEED, block_rows: int = BLOCK_ROWS
) -> OneClassModel:
    """Consensus of exact solutions over blocks, brought to that of the whole by gradient corrections.

    The rows are stored once as packed blocks. The first pass solves every block's own problem and averages the solutions. A
    round is two passes: the gradient of the whole objective at the average, and every block's problem again, tilted so
    that its gradient there is the whole one's. Blocks keep nothing in between. A round that gains less than ``ENOUGH`` of the
    objective is the last; one block is solved at once. Partial sums are added up in two levels.
    """
    normal = windows.where("attack_label = 0").dropna(subset=fv.FEATURES).select(*fv.FEATURES)
    mean, std = scaler(windows)
    rng = np.random.default_rng(seed)
    gamma = 1.0 / len(fv.FEATURES)
    frequencies = rng.normal(scale=np.sqrt(2.0 * gamma), size=(len(fv.FEATURES), dimensions))
    phases = rng.uniform(0.0, 2.0 * np.pi, size=dimensions)
    model = OneClassModel(mean, std, frequencies, phases, np.zeros(dimensions), 0.0)
    blocks, n_blocks = _packed(normal, block_rows)

    found = _solved(blocks, model, nu, None, None)
    best, least = found, np.inf
    for _ in range(rounds if n_blocks > 1 else 0):
        n, sums = _summed(blocks, model, lambda phi: (len(phi), _slopes(phi, found)))
        objective, gradient = _whole(found, sums / n, nu)
        gained, least, best = least - objective, min(least, objective), found if objective <= least else best
        if gained < ENOUGH * abs(objective):
            break
        found = _solved(blocks, model, nu, found, gradient)
    else:
        best = found
    fitted = OneClassModel(mean, std, frequencies, phases, best[:-1], 0.0)
    # the offset is set exactly: a share nu of the normal windows lies below it
    margins = stored(ocsvm_score(windows.where("attack_label = 0"), fitted, "_margin").select("_margin"), "margins")
    cut = exact_percentiles(margins, [], "_margin", {"cut": nu}).first()["cut"]
    return OneClassModel(mean, std, frequencies, phases, best[:-1], float(cut))


def _packed(normal: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """Rows as stored blocks of about ``block_rows``, one packed row each, dealt by hash so that blocks are alike."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch[fv.FEATURES].to_numpy(dtype="float64"))
            while sum(map(len, held)) >= 2 * block_rows:
                rows = np.concatenate(held)
                yield pd.DataFrame({"x": [rows[:block_rows].tobytes()]})
                held = [rows[block_rows:]]
        if held and sum(map(len, held)):
            yield pd.DataFrame({"x": [np.concatenate(held).tobytes()]})

    n = normal.count()
    if not n:
        raise ValueError("no complete normal windows to fit on")
    parts = max(1, round(n / block_rows))
    blocks = stored(normal.repartition(parts, *fv.FEATURES).mapInPandas(pack, "x binary"), "blocks")
    return blocks, blocks.count()


def _summed(blocks: DataFrame, model: OneClassModel, of: Callable[[np.ndarray], tuple[float, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Weight and vector of every block, summed over all: per partition, then in ``sqrt`` groups, then by the driver."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, total = 0.0, 0.0
        for batch in batches:
            for held in batch["x"]:
                own, vector = of(shared.value.features(np.frombuffer(held).reshape(-1, len(fv.FEATURES))))
                weight, total = weight + own, total + vector
        if weight:
            yield pd.DataFrame({"n": [weight], "s": [total]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, total = 0.0, 0.0
        for batch in batches:
            weight, total = weight + batch["n"].sum(), total + np.sum(batch["s"].tolist(), axis=0)
        if weight:
            yield pd.DataFrame({"n": [weight], "s": [total]})

    sums = blocks.mapInPandas(each, "n double, s array<double>")
    groups = int(np.sqrt(blocks.rdd.getNumPartitions()))
    if groups > 1:
        sums = sums.repartition(groups).mapInPandas(add, "n double, s array<double>")
    rows = sums.collect()
    shared.unpersist()
    return sum(r["n"] for r in rows), np.sum([r["s"] for r in rows], axis=0)


def _solved(blocks: DataFrame, model: OneClassModel, nu: float, start: np.ndarray | None, gradient: np.ndarray | None) -> np.ndarray:
    """The blocks' solutions (weights and offset), averaged by their rows."""

    def solve(phi: np.ndarray) -> tuple[float, np.ndarray]:
        tilt = None
        if start is not None:
            _, own = _whole(start, _slopes(phi, start) / len(phi), nu)
            tilt = own - gradient
        return len(phi), len(phi) * minimum(phi, nu, start, tilt)

    n, total = _summed(blocks, model, solve)
    return total / n


def _hinge(z: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max(0, z), rounded over ``width``: value, slope, curvature."""
    part = np.clip(z / width, 0.0, 1.0)
    return np.where(z >= width, z - width / 2, z * part / 2), part, ((z > 0) & (z < width)) / width


def _slopes(phi: np.ndarray, at: np.ndarray, width: float = WIDTH) -> np.ndarray:
    """Sums over rows: the slopes by weights and offset, and the value of the hinge."""
    value, slope, _ = _hinge(at[-1] - phi @ at[:-1], width)
    return np.concatenate([-(slope @ phi), [slope.sum(), value.sum()]])


def _whole(at: np.ndarray, means: np.ndarray, nu: float) -> tuple[float, np.ndarray]:
    """Objective and gradient from the mean slopes."""
    gradient = np.concatenate([at[:-1], [-1.0]]) + means[:-1] / nu
    return float(at[:-1] @ at[:-1] / 2 - at[-1] + means[-1] / nu), gradient


def minimum(phi: np.ndarray, nu: float, start: np.ndarray | None = None, tilt: np.ndarray | None = None) -> np.ndarray:
    """Newton's method on 1/2 |w|^2 - rho + mean(hinge) / nu, less ``tilt`` times what it is tilted by; the hinge's rounding
    is narrowed step by step down to ``WIDTH``."""
    n, d = phi.shape
    tilt = np.zeros(d + 1) if tilt is None else tilt
    if start is None:
        w = phi.mean(axis=0)
        x = np.append(w, np.quantile(phi @ w, nu))
        widths = [w_ for w_ in (0.1, 0.03, 0.01, 0.003) if w_ > WIDTH] + [WIDTH]
    else:
        x, widths = start.copy(), [WIDTH]
    # a tilted block stays near the common solution, of which its own curvature knows only its rows
    near = 0.0 if start is None else NEAR
    origin = x.copy()

    def value(x: np.ndarray, width: float) -> float:
        h, _, _ = _hinge(x[-1] - phi @ x[:-1], width)
        gap = x - origin
        return x[:-1] @ x[:-1] / 2 - x[-1] + h.sum() / (nu * n) - tilt @ x + near / 2 * gap @ gap

    for width in widths:
        for _ in range(NEWTON_STEPS):
            _, slope, curve = _hinge(x[-1] - phi @ x[:-1], width)
            gradient = np.append(x[:-1], -1.0) + np.append(-(slope @ phi), slope.sum()) / (nu * n) - tilt + near * (x - origin)
            active = curve > 0
            rows = np.column_stack([-phi[active], np.ones(active.sum())])
            hessian = (rows * curve[active, None]).T @ rows / (nu * n) + np.diag(np.append(np.ones(d), RIDGE)) + near * np.eye(d + 1)
            step = -np.linalg.solve(hessian, gradient)
            before, t = value(x, width), 1.0
            while t > 1e-9 and value(x + t * step, width) > before + 1e-4 * t * gradient @ step:
                t /= 2
            x = x + t * step
            if t <= 1e-9 or -gradient @ step < 1e-10:
                break
    return x


def ocsvm_score(windows: DataFrame, model: OneClassModel, out: str = "ocsvm_score") -> DataFrame:
    shared = windows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def decision(*columns: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series(m.features(np.column_stack([c.to_numpy(dtype="float64") for c in columns])) @ m.weights - m.rho)

    scored = windows.withColumn(out, decision(*[F.col(c) for c in fv.FEATURES]))
    return scored.withColumn(out, F.when(~F.isnan(out), F.col(out)))
