"""Networks trained by distributed gradients, with losses that weigh misses.

The rows are written once, standardised on the way in. A step is one job: every task runs its rows of the mini-batch through
all members of the ensemble and returns the sums of their gradients, which are added up in two levels; the driver holds the
weights only. Mini-batches, bootstrap weights and the validation part are hashes of row keys, so a retried task does the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import checkpointed

#: Sums of tasks that are added up together before they go to the driver.
FAN = 32


@dataclass(frozen=True)
class Loss:
    """Mix of the focal loss and of a cross entropy in which missed positives (predicted 0, label 1) weigh more."""

    focal: float = 0.7
    missed: float = 0.3
    miss_weight: float = 3.0
    alpha: float = 0.25
    gamma: float = 2.0

    def of(self, p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(loss, its slope by the logit) of every row."""
        p = np.clip(p, 1e-12, 1 - 1e-12)
        right = np.where(y == 1, p, 1 - p)
        sign = np.where(y == 1, 1.0, -1.0)
        rest, log = 1 - right, np.log(right)
        weight = np.where((y == 1) & (p < 0.5), self.miss_weight, 1.0)
        loss = -self.focal * self.alpha * rest**self.gamma * log - self.missed * weight * log
        slope = self.focal * self.alpha * (self.gamma * right * rest**self.gamma * log - rest ** (self.gamma + 1)) - self.missed * weight * rest
        return loss, sign * slope


CROSS_ENTROPY = Loss(focal=0.0, missed=1.0, miss_weight=1.0)


def start(sizes: list[int], seed: int) -> np.ndarray:
    """Weights and biases of all layers as one vector."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.concatenate([rng.normal(0, (2 / a) ** 0.5, a * b), np.zeros(b)]) for a, b in zip(sizes, sizes[1:])])


def layers(theta: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(theta: np.ndarray, sizes: list[int], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(probability of label 1, inputs of every layer)."""
    inputs = [x]
    *hidden, (w, b) = layers(theta, sizes)
    for v, c in hidden:
        inputs.append(np.maximum(inputs[-1] @ v + c, 0.0))
    return 1 / (1 + np.exp(-np.clip(inputs[-1] @ w + b, -40, 40)[:, 0])), inputs


def gradient(theta: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray, weight: np.ndarray, loss: Loss) -> tuple[float, np.ndarray]:
    """(sum of the weighted losses, sum of their gradients)."""
    p, inputs = forward(theta, sizes, x)
    value, slope = loss.of(p, y)
    back, parts = (weight * slope)[:, None], []
    for (w, _), given in zip(reversed(layers(theta, sizes)), reversed(inputs)):
        parts.append(np.concatenate([(given.T @ back).ravel(), back.sum(axis=0)]))
        back = (back @ w.T) * (given > 0)
    return float(weight @ value), np.concatenate(parts[::-1])


@dataclass
class Ensemble:
    """Members' weights, the scaling of the features, and per epoch the validation losses of all members."""

    sizes: list[int]
    thetas: list[np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    history: list[list[float]] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        return np.stack([forward(t, self.sizes, x)[0] for t in self.thetas], axis=1)


def uniform(key, salt) -> F.Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0


def poisson(u: F.Column) -> F.Column:
    """Number of times a row is drawn in a sample of its table's size."""
    cuts = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120]))
    return sum(((u > c).cast("double") for c in cuts.tolist()), F.lit(0.0))


def fit_networks(
    df: DataFrame, id_col: str, features: list[str], label: str = "label", losses: list[Loss] | None = None, hidden: tuple[int, ...] = (32, 16), epochs: int = 25,
    batches: int = 2, rate: float = 0.02, patience: int = 5, valid: float = 0.2, resample: bool = True, seed: int = 42,
) -> Ensemble:
    """One network per loss (five with the mixed loss by default), each on a bootstrap sample if `resample`.

    A member whose validation loss has not fallen for `patience` epochs stops and keeps its best weights. Null features count
    as the mean; rows without a label are left out; a table without rows gives members that say one half.
    """
    losses = losses or [Loss()] * 5
    x = [F.col(f).cast("double").alias(f) for f in features]
    rows = df.where(F.col(label).isNotNull()).select(F.col(id_col).cast("string").alias("key"), F.col(label).cast("double").alias("y"), *x)
    facts = rows.agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)]).first()
    mean, scale = np.array([facts[f"m_{i}"] or 0.0 for i in range(len(features))]), np.array([facts[f"s_{i}"] or 1.0 for i in range(len(features))])
    sizes = [len(features), *hidden, 1]
    if not facts["n"]:
        return Ensemble(sizes, [np.zeros(len(start(sizes, 0)))] * len(losses), mean, scale)
    scaled = F.array(*[(F.coalesce(F.col(f), F.lit(float(m))) - float(m)) / float(s) for f, m, s in zip(features, mean, scale)])
    drawn = F.array(*[poisson(uniform("key", f"draw {seed} {k}")) if resample else F.lit(1.0) for k in range(len(losses))])
    ready = checkpointed(rows.select("key", "y", scaled.alias("x"), drawn.alias("w"), (uniform("key", f"valid {seed}") < valid).alias("valid")))
    thetas = [start(sizes, seed + k) for k in range(len(losses))]
    best, lowest, stale = list(thetas), [np.inf] * len(losses), [0] * len(losses)
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in thetas]
    history, step = [], 0
    for epoch in range(epochs):
        for batch in range(batches):
            sums = step_sums(ready, sizes, thetas, losses, (f"{seed} {epoch}", batches, batch), check=batch == 0)
            if batch == 0:
                history.append([s["checked"] / max(s["n_checked"], 1) for s in sums])
                for k, now in enumerate(history[-1]):
                    better = now < lowest[k] - 1e-6
                    if better:
                        lowest[k], best[k] = now, thetas[k]
                    stale[k] = 0 if better else stale[k] + 1
                if min(stale) >= patience:
                    return Ensemble(sizes, best, mean, scale, history)
            step += 1
            for k, s in enumerate(sums):
                if stale[k] < patience and s["n"] > 0:
                    g = s["grad"] / s["n"]
                    m, v = moments[k] = (0.9 * moments[k][0] + 0.1 * g, 0.999 * moments[k][1] + 0.001 * g * g)
                    thetas[k] = thetas[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Ensemble(sizes, [b if np.isfinite(low) else t for b, low, t in zip(best, lowest, thetas)], mean, scale, history)


def step_sums(ready: DataFrame, sizes: list[int], thetas: list[np.ndarray], losses: list[Loss], pick: tuple[str, int, int], check: bool) -> list[dict]:
    """Per member: gradient sum and weight of the mini-batch, and with `check` loss and number of the validation rows."""
    salt, of, batch = pick
    mine = ~F.col("valid") & (F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(of)) == batch)
    rows = ready.where(mine | F.lit(check) & F.col("valid")).select("y", "x", "w", "valid")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grads, n = [np.zeros_like(t) for t in thetas], np.zeros(len(thetas))
        checked, n_checked = np.zeros(len(thetas)), 0
        for f in frames:
            if not len(f):
                continue
            x, y, w, held = np.stack(f["x"].to_numpy()), f["y"].to_numpy(), np.stack(f["w"].to_numpy()), f["valid"].to_numpy(bool)
            n_checked += int(held.sum())
            for k, theta in enumerate(thetas):
                checked[k] += losses[k].of(forward(theta, sizes, x[held])[0], y[held])[0].sum()
                grads[k] += gradient(theta, sizes, x[~held], y[~held], w[~held, k], losses[k])[1]
                n[k] += w[~held, k].sum()
        yield pd.DataFrame({"member": range(len(thetas)), "grad": [g.tobytes() for g in grads], "n": n, "checked": checked, "n_checked": n_checked})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(g) for g in frame["grad"]], axis=0)
        return pd.DataFrame([(frame["member"].iloc[0], total.tobytes(), frame["n"].sum(), frame["checked"].sum(), frame["n_checked"].sum())], columns=frame.columns[:5])

    schema = "member int, grad binary, n double, checked double, n_checked long"
    sums = rows.mapInPandas(run, schema)
    if ready.rdd.getNumPartitions() > FAN:
        sums = sums.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(FAN))).groupBy("member", "some").applyInPandas(lambda f: add(f.drop(columns="some")), schema)
    found = sums.toPandas()
    out = []
    for k in range(len(thetas)):
        mine = add(found[found["member"] == k]).iloc[0]
        out.append({"grad": np.frombuffer(mine["grad"]), "n": float(mine["n"]), "checked": float(mine["checked"]), "n_checked": int(mine["n_checked"])})
    return out


def score_networks(df: DataFrame, ensemble: Ensemble, features: list[str]) -> DataFrame:
    """Arrays `votes` and `probabilities` with one entry per member; null features count as the mean."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
            yield pd.Series(list(ensemble.probabilities(np.where(np.isnan(x), ensemble.mean, x))))

    scored = df.withColumn("probabilities", run(*[F.col(f).cast("double") for f in features]))
    return scored.withColumn("votes", F.transform("probabilities", lambda p: (p > 0.5).cast("double")))
