"""Feed-forward nets trained by mini-batches on the rows of each task, weights averaged after every round."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.session import cut

BATCH = 1024
# Steps of a task in a round at least; a task with fewer rows passes over them several times.
STEPS = 200
STEP_SIZE = 3e-3
# The step size is halved when a round gains less than `tol`; the fit ends when it was halved so often.
HALVINGS = 2
SHAPE = "n long, loss double, state binary"


def first_weights(layers: Sequence[int], seed: int) -> np.ndarray:
    """Of each layer the weights (column by column) and then the biases, as Spark ML lays them out."""
    r, parts = np.random.default_rng(seed), []
    for into, out in zip(layers, layers[1:]):
        # Four times the usual range, which suits the sigmoid.
        most = 4 * np.sqrt(6 / (into + out))
        parts += [r.uniform(-most, most, into * out), np.zeros(out)]
    return np.concatenate(parts).astype("f4")


def unrolled(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views (inputs by outputs, biases) of each layer."""
    out, at = [], 0
    for i, o in zip(layers, layers[1:]):
        out.append((weights[at : at + i * o].reshape(i, o), weights[at + i * o : at + (i + 1) * o]))
        at += (i + 1) * o
    return out


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: Sequence[int]) -> tuple[float, np.ndarray]:
    """Mean log loss of a sigmoid net with softmax output, and its gradient."""
    net, outs = unrolled(weights, layers), [x]
    for w, b in net[:-1]:
        outs.append(1 / (1 + np.exp(-np.clip(outs[-1] @ w + b, -30, 30))))
    z = outs[-1] @ net[-1][0] + net[-1][1]
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[at, y], 1e-12)).mean())
    p[at, y] -= 1
    delta, grad = p / np.float32(len(y)), np.empty_like(weights)
    own = unrolled(grad, layers)
    for k in range(len(net) - 1, -1, -1):
        own[k][0][:], own[k][1][:] = outs[k].T @ delta, delta.sum(axis=0)
        if k:
            delta = (delta @ net[k][0].T) * outs[k] * (1 - outs[k])
    return loss, grad


def fit_weights(rows: DataFrame, layers: Sequence[int], seed: int, rounds: int, tol: float) -> np.ndarray:
    """Weights fitted on all `rows` (x array<float>, y int).

    A round passes over every row once: each task takes Adam steps over mini-batches of its
    own rows, and weights and moments of the tasks are averaged, weighted by rows. The driver
    sees one set of weights per core. The fit ends after `rounds` rounds, or when the mean
    loss of a round, as met on the way, no longer falls by `tol`.
    """
    spark = rows.sparkSession
    n_tasks = spark.sparkContext.defaultParallelism
    rows = cut(rows.repartition(n_tasks))
    total = rows.count()
    if not total:
        raise ValueError("no rows to fit the net on")
    passes = max(1, -(-STEPS * BATCH * n_tasks // total)) if total < n_tasks * STEPS * BATCH else 1
    if total < n_tasks * BATCH:
        # Few rows: one task sees all of them.
        rows, passes = rows.coalesce(1), max(1, -(-STEPS // -(-total // 64)))
    size = 64 if total < n_tasks * BATCH else BATCH
    passes = min(passes, STEPS)
    size_of, shape = sum((i + 1) * o for i, o in zip(layers, layers[1:])), list(layers)
    state, done, best, halved, step = np.concatenate([first_weights(layers, seed), np.zeros(2 * size_of, "f4")]), 0, np.inf, 0, STEP_SIZE
    for round_ in range(rounds):
        start = spark.sparkContext.broadcast((state, done, step))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, t, rate = start.value
            w, m, v = (before[i * size_of : (i + 1) * size_of].copy() for i in range(3))
            n, lost = 0, 0.0

            def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                read = (
                    (b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, shape[0]), b.column(1).to_numpy(zero_copy_only=False))
                    for b in batches
                    if b.num_rows
                )
                if passes == 1:
                    yield from read
                    return
                held = list(read)  # at most STEPS * BATCH rows
                if not held:
                    return
                x, y = (np.concatenate(c) for c in zip(*held))
                r = np.random.default_rng([seed, round_])
                for _ in range(passes):
                    order = r.permutation(len(y))
                    yield x[order], y[order]

            for x, y in parts():
                for at in range(0, len(y), size):
                    loss, g = gradient(x[at : at + size], y[at : at + size], w, shape)
                    k = len(y[at : at + size])
                    n, lost, t = n + k, lost + loss * k, t + 1
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int64()), pa.array([lost]), pa.array([np.concatenate([w, m, v]).tobytes()], pa.binary())], names=["n", "loss", "state"]
                )

        found = rows.mapInArrow(learn, SHAPE).collect()  # one row per core
        start.destroy()
        seen = sum(r["n"] for r in found)
        state = sum(np.frombuffer(r["state"], "f4").astype("f8") * (r["n"] / seen) for r in found).astype("f4")
        done += max(1, seen // (size * len(found)))
        loss = sum(r["loss"] for r in found) / seen
        if best - loss < tol:
            halved, step = halved + 1, step / 2
        if halved > HALVINGS or loss < tol:
            break
        best = min(best, loss)
    return state[:size_of]
