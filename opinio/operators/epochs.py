"""Training by epochs with early stopping.

A softmax classifier is trained as a network's last layer is: in mini-batches, with Adam steps
and weight decay that is decoupled from them, a row of metrics per epoch, and a stop once the
validation loss has not improved for some epochs, after which the best state is restored.
Rows are dealt to batches by a hash of their key, and each batch is packed and written as one
partition: a step is a job of one short task over its batch only, without planning, listing or
a shuffle, since steps follow one another and there are as many as batches.  The validation
loss is added up in the tasks and then over the cluster.  The driver holds the weights, never
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.operators.features import cells
from opinio.session import checkpoint_root, work_dir

#: What is added up of a batch.
LOSS, HITS, ROWS = 0, 1, 2


def hash_share(key: Column, seed: int) -> Column:
    """A number from 0 to 2**28 - 1 that depends on the key and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")


def _forward(w: np.ndarray, labels: np.ndarray, row: np.ndarray, at: np.ndarray, x: np.ndarray):
    """Probabilities, losses and hits of rows given by their cells.  The last column of ``w``
    (classes x (features + 1)) is the intercept."""
    z = np.stack([np.bincount(row, c[at] * x, len(labels)) + c[-1] for c in w], axis=1)
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-15))
    return p, loss, p.argmax(axis=1) == labels


def _arrays(labels: pa.Array, own: pa.Array) -> tuple[np.ndarray, ...]:
    """Labels, and of each cell its row, dimension and value."""
    flat = own.flatten()
    sizes = np.diff(own.offsets.to_numpy())
    return (labels.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(own)), sizes),
            flat.field("i").to_numpy(zero_copy_only=False), flat.field("x").to_numpy(zero_copy_only=False))


class Losses:
    """Tasks' part of a pass over the validation rows: per batch loss, hits and rows."""

    def __init__(self, weights):
        self.weights = weights

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            groups = b.column("batch").to_numpy()
            _, loss, hit = _forward(self.weights.value, *_arrays(b.column("label"), b.column("cells")))
            for g in np.unique(groups).tolist():
                mine = groups == g
                sums[g] = sums.get(g, np.zeros(3)) + (loss[mine].sum(), hit[mine].sum(), mine.sum())
        names = ("loss", "hits", "rows")
        yield pa.RecordBatch.from_pydict({"batch": pa.array(list(sums), pa.int32()), **{
            n: pa.array([float(s[i]) for s in sums.values()], pa.float64()) for i, n in enumerate(names)}})


def _checked(rows: DataFrame, weights: np.ndarray) -> list[tuple[float, float, float]]:
    """Loss, hits and rows of each validation batch."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)
    found = (rows.mapInArrow(Losses(sent), "batch int, loss double, hits double, rows double")
             .groupBy("batch").agg(F.sum("loss"), F.sum("hits"), F.sum("rows")).orderBy("batch").collect())
    sent.destroy()
    return [tuple(r)[1:] for r in found]


def _pack(rows: pa.Table) -> pa.Table:
    """A batch as one row of byte strings."""
    rows = rows.combine_chunks()
    parts = _arrays(rows.column("label").combine_chunks(), rows.column("cells").combine_chunks())
    kinds = (np.int32, np.int32, np.int32, np.float64)
    packed = {n: pa.array([v.astype(k).tobytes()], pa.binary()) for n, v, k in zip(("label", "row", "at", "x"), parts, kinds, strict=True)}
    return pa.table({"batch": rows.column("batch").slice(0, 1), **packed})


class Step:
    """A batch's sums and gradient: the live entries of the weights and their values."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __call__(self, packed):
        w = self.weights
        for _, (label, row, at, x) in packed:
            labels, row, at = (np.frombuffer(v, np.int32) for v in (label, row, at))
            x = np.frombuffer(x, np.float64)
            p, loss, hit = _forward(w, labels, row, at, x)
            p[np.arange(len(labels)), labels] -= 1
            grad = np.stack([np.append(np.bincount(at, x * g[row], w.shape[1] - 1), g.sum()) for g in p.T]).ravel()
            live = np.flatnonzero(grad)
            yield (float(loss.sum()), float(hit.sum()), float(len(labels))), live, grad[live]


def _dealt(rows: DataFrame, n_batches: int):
    """The batches, packed, batch ``b`` in partition ``b``: written once to the shared folder."""
    checkpoint_root(rows.sparkSession)
    packed = rows.groupBy("batch").applyInArrow(_pack, "batch int, label binary, row binary, at binary, x binary")
    dealt = packed.rdd.map(lambda r: (r[0], tuple(bytes(v) for v in r[1:]))).partitionBy(n_batches, int)
    dealt.checkpoint()
    dealt.count()
    return dealt


def _metrics(sums: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Mean of the batches' mean losses, and accuracy over rows."""
    losses = [s[LOSS] / s[ROWS] for s in sums]
    return float(np.mean(losses)), sum(s[HITS] for s in sums) / sum(s[ROWS] for s in sums)


@dataclass(frozen=True)
class Fit:
    """``weights``: classes x (features + 1) of the best epoch.  ``epochs``: a row per epoch."""
    weights: np.ndarray
    epochs: tuple
    best_epoch: int
    stop_epoch: int | None
    n_train: int
    n_valid: int


def train_epochs(df: DataFrame, features_col: str, label_col: str, row_id: str, n_classes: int, n_features: int,
                 epochs: int = 15, batch_rows: int = 512, rate: float = 0.05, decay: float = 1e-4, patience: int = 3,
                 valid_share: float = 0.2, seed: int = 42, on_epoch: Callable[[dict], None] | None = None) -> Fit:
    """Train on ``features_col`` (ML vectors) and ``label_col`` (class numbers).

    A row is for validation or training, and in a batch of about ``batch_rows``, by hashes of
    its key; the batches come in another order each epoch.  Rows with a null label or vector
    take no part; rows with equal keys share a batch.  Without training rows there are no
    epochs and all weights are zero; without validation rows the training loss decides.
    """
    spark = df.sparkSession
    kept = df.where(F.col(label_col).isNotNull() & F.col(features_col).isNotNull())
    key = F.coalesce(F.col(row_id).cast("string"), F.lit(""))
    valid = hash_share(key, seed) < int(valid_share * (1 << 28))
    rows = kept.select(valid.alias("valid"), F.col(label_col).cast("int").alias("label"), cells(features_col).alias("cells"),
                       hash_share(key, seed + 1).alias("dealt"))
    count = {r.valid: r.n for r in rows.groupBy("valid").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_train, n_valid = count.get(False, 0), count.get(True, 0)
    n_batches, n_checks = -(-n_train // batch_rows), -(-n_valid // batch_rows)
    weights = np.zeros((n_classes, n_features + 1))
    if not n_train:
        return Fit(weights, (), -1, None, 0, n_valid)
    batch = F.pmod("dealt", F.when(F.col("valid"), F.lit(max(1, n_checks))).otherwise(F.lit(n_batches))).cast("int")
    path = work_dir(spark, "epochs")
    rows.select("valid", batch.alias("batch"), "label", "cells").write.partitionBy("valid").parquet(path)
    schema = f"batch int, label int, cells {rows.schema['cells'].dataType.simpleString()}, valid boolean"
    written = spark.read.schema(schema).parquet(path)
    checks = written.where("valid")
    dealt = _dealt(written.where("NOT valid").drop("valid"), n_batches)
    first, second, step = np.zeros_like(weights), np.zeros_like(weights), 0
    table, best, best_weights, stop = [], None, weights, None
    for epoch in range(epochs):
        seen = []
        for b in np.random.default_rng([seed, epoch]).permutation(n_batches).tolist():
            got = spark.sparkContext.runJob(dealt, Step(weights), [b])
            if not got:  # no row was dealt to it
                continue
            sums, live, values = got[0]
            seen.append(sums)
            grad = np.zeros(weights.size)
            grad[live] = values
            grad = grad.reshape(weights.shape) / sums[ROWS]
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            move = (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
            weights = weights * (1 - rate * decay) - rate * move
        train_loss, train_acc = _metrics(seen)
        valid_loss, valid_acc = _metrics(_checked(checks, weights)) if n_valid else (train_loss, train_acc)
        improved = best is None or valid_loss < table[best]["valid_loss"]
        table.append({"epoch": epoch, "train_loss": train_loss, "train_acc": train_acc, "valid_loss": valid_loss,
                      "valid_acc": valid_acc, "improved": improved})
        if on_epoch:
            on_epoch(table[-1])
        if improved:
            best, best_weights = epoch, weights
        elif epoch - best >= patience:
            stop = epoch
            break
    return Fit(best_weights, tuple(table), best, stop, n_train, n_valid)


def class_margins(df: DataFrame, features_col: str, weights: np.ndarray, out: str = "margins") -> DataFrame:
    """``df`` with the margins of a fit's classes, as an array (softmax or arg max follow)."""
    sent = df.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        w = sent.value
        for b in batches:
            own = b.column("__cells")
            offsets = own.offsets.to_numpy() - own.offsets[0].as_py()
            flat = own.flatten()
            z = np.repeat(w[:, -1][None], b.num_rows, axis=0)
            np.add.at(z, np.repeat(np.arange(b.num_rows), np.diff(offsets)),
                      w[:, flat.field("i").to_numpy()].T * flat.field("x").to_numpy()[:, None])
            names = [n for n in b.schema.names if n != "__cells"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(z.tolist(), pa.list_(pa.float64()))], [*names, out])

    kept = [c for c in df.columns if c not in (features_col, out)]
    slim = df.select(*kept, cells(features_col).alias("__cells"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "__cells")
    return slim.mapInArrow(score, f"{schema}, `{out}` array<double>")
