"""Training a sparse dictionary: batch top-k with an auxiliary loss on dead features, in numpy.

An epoch's order is a hash of token, epoch and seed, in which the activations are numbered and written. One part is
plain sequential training: a task takes the batches of a stretch of steps in that order. With more parts as many tasks
take every step together, each a share of the batch (see ``steps``), which gives the weights of one part; a small
dictionary's steps of a stretch are one stage, a large one's a job each. ``averaged``
trades that for fewer exchanges: each part is one task that takes batches of its own for an epoch, then the parts'
weights and moments are averaged. The driver holds the weights, whose size is the dictionary's, and never an
activation. Gradients are written out by hand; this does not rival a GPU.
"""

from __future__ import annotations

import math
import pickle
import secrets
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import delete_path, staged_parts
from . import steps as S
from .dictionary import WEIGHT_BYTES, Dictionary, matrix, reconstruction
from .steps import PIECES, NumberedEpoch, boundary, connected, gathered, in_pieces, joined, numbered_epoch, shares, synchronous_gradients


@dataclass
class TrainConfig:
    d_dict: int = 12288
    k: int = 32
    k_aux: int = 512
    alpha: float = 1 / 32
    lr: float = 2e-4
    lr_floor: float = 0.1
    warmup: int = 1000
    betas: tuple[float, float] = (0.9, 0.99)
    weight_decay: float = 0.0
    clip: float = 1.0
    epochs: int = 3
    batch: int = 8192
    val_fraction: float = 0.02
    ema: float = 0.999
    calibration_batches: int = 50
    dead_after: int = 1
    tangent: bool = True
    across_chunks: bool = True
    parts: int = 1
    averaged: bool = False
    log_every: int = 100
    val_every: int = 1000
    quick_batches: int = 8
    seed: int = 0

    def validate(self) -> None:
        if min(self.k, self.batch, self.epochs, self.parts, self.log_every, self.val_every) < 1 or not 0 < self.val_fraction < 1:
            raise ValueError("k, batch, epochs and parts must be positive, val_fraction between 0 and 1")


def init(d_model: int, config: TrainConfig) -> Dictionary:
    """Random decoder rows of length 1; the encoder is their transpose."""
    w = np.random.default_rng(config.seed).normal(size=(config.d_dict, d_model))
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    return Dictionary(w.T.copy(), np.zeros(config.d_dict), w, np.zeros(d_model), 0.0, np.zeros(config.d_dict, np.int64))


def batch_topk(h: np.ndarray, k: int) -> tuple[np.ndarray, float | None]:
    """Mask of the k * rows largest entries of a batch (ties of the boundary stay), and the boundary; None if all stay."""
    n = k * len(h)
    if n >= h.size:
        return np.ones_like(h, bool), None
    edge = float(np.partition(h.ravel(), h.size - n)[h.size - n])
    return h >= edge, edge


def aux_topk(h: np.ndarray, chosen: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's ``k`` largest entries that were not chosen."""
    free = np.where(chosen, -np.inf, h)
    k = min(k, h.shape[1])
    top = np.argpartition(-free, k - 1, axis=1)[:, :k]
    out = np.zeros_like(chosen)
    np.put_along_axis(out, top, True, 1)
    return out & ~chosen


def learning_rate(step: int, config: TrainConfig, total: int) -> float:
    if step < config.warmup:
        return config.lr * (step + 1) / config.warmup
    p = min(1.0, (step - config.warmup) / max(1, total - config.warmup))
    low = config.lr * config.lr_floor
    return low + 0.5 * (config.lr - low) * (1 + math.cos(math.pi * p))


def gradients(model: Dictionary, x: np.ndarray, config: TrainConfig, edge: float | None = None, rows: int | None = None) -> tuple[dict[str, np.ndarray], dict]:
    """Gradients of mean squared error plus the auxiliary term, whose target is the residual as a constant.

    For a share of a batch, ``rows`` is the batch's size and ``edge`` its boundary (None: all stay); the gradients and
    losses of all shares add up to those of the batch.
    """
    h = np.maximum(model.preactivations(x), 0)
    if rows is None:
        mask, edge = batch_topk(h, config.k)
    else:
        mask = np.ones_like(h, bool) if edge is None else h >= edge
    f = h * mask
    error = model.decode(f) - x
    size = x.size if rows is None else rows * x.shape[1]
    scale = 2 / size
    aux_mask = aux_topk(h, mask, config.k_aux)
    g = h * aux_mask
    aux_error = model.decode(g, bias=False) + error  # decode(g) - (x - decode(f))
    back = scale * error
    back_aux = config.alpha * scale * aux_error
    df = (back @ model.w_dec.T) * mask * (h > 0) + (back_aux @ model.w_dec.T) * aux_mask * (h > 0)
    grads = {"w_dec": f.T @ back + g.T @ back_aux, "b_dec": back.sum(0) - (df @ model.w_enc.T).sum(0), "w_enc": (x - model.b_dec).T @ df, "b_enc": df.sum(0)}
    return grads, {"recon_loss": float((error**2).sum() / size), "aux_loss": float((aux_error**2).sum() / size), "edge": edge, "fired": (f > 0).sum(0)}


class AdamW:
    def __init__(self, config: TrainConfig) -> None:
        self.config, self.state, self.step = config, {}, 0

    def update(self, model: Dictionary, grads: dict[str, np.ndarray], rate: float) -> None:
        """Tangent projection of decoder gradients, clipping by the overall norm, AdamW, unit decoder rows."""
        c = self.config
        if c.tangent:
            along = (grads["w_dec"] * model.w_dec).sum(1, keepdims=True)
            grads["w_dec"] = grads["w_dec"] - along * model.w_dec
        norm = math.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        shrink = min(1.0, c.clip / (norm + 1e-6))
        self.step += 1
        for name, g in grads.items():
            g = g * shrink
            m, v = self.state.get(name, (np.zeros_like(g), np.zeros_like(g)))
            m, v = c.betas[0] * m + (1 - c.betas[0]) * g, c.betas[1] * v + (1 - c.betas[1]) * g * g
            self.state[name] = m, v
            p = getattr(model, name)
            p = p * (1 - rate * c.weight_decay) - rate * (m / (1 - c.betas[0] ** self.step)) / (np.sqrt(v / (1 - c.betas[1] ** self.step)) + 1e-8)
            setattr(model, name, p)
        model.w_dec /= np.maximum(np.linalg.norm(model.w_dec, axis=1, keepdims=True), 1e-12)


def split_chunks(chunks: DataFrame, config: TrainConfig, draw: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """Adds ``val``: max(1, round(fraction * n)) chunks with the least hash; an error if none is left to train on."""
    n = chunks.count()
    n_val = max(1, round(config.val_fraction * n))
    if n - n_val < 1:
        raise ValueError(f"{n} chunk(s) leave none for training")
    place = F.row_number().over(W.orderBy(draw("chunk_idx", F.lit(config.seed)), "chunk_idx"))
    return chunks.withColumn("val", place <= n_val)


def ordered_epoch(activations: DataFrame, config: TrainConfig, epoch: int, key: str = "token_id", vector: str = "activation") -> tuple[DataFrame, str]:
    """part, activation in an order hashed from token, epoch and seed (of chunk first, where tokens stay in their chunks), written, with its path.

    A file holds a range of that order, so files may follow each other in any order: hashed ranges are shuffled anyway.
    """
    order = [F.xxhash64(key, F.lit(epoch), F.lit(config.seed)), F.col(key)]
    if not config.across_chunks:
        order = [F.xxhash64("chunk_idx", F.lit(epoch), F.lit(config.seed)), F.col("chunk_idx"), *order]
    names = [f"_o{i}" for i in range(len(order))]
    deal = F.pmod(order[0], F.lit(config.parts)).cast("int").alias("part")
    rows = activations.select(*[o.alias(n) for o, n in zip(order, names, strict=True)], F.col(vector).cast("array<float>").alias("activation"), deal)
    spread = int(activations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(max(spread, config.parts), "part", *names).sortWithinPartitions("part", *names)
    return staged_parts(ranged.select("activation", "part"), "epoch", "part")


def steps_per_epoch(counts: Sequence[int], batch: int, across_chunks: bool = True) -> int:
    """Batches of an epoch: over all tokens together, or within each chunk."""
    return math.ceil(sum(counts) / batch) if across_chunks else sum(math.ceil(n / batch) for n in counts)


@dataclass
class Trainer:
    """Weights, the optimiser's state and what an epoch adds up."""

    model: Dictionary
    config: TrainConfig
    total: int
    optimiser: AdamW
    losses: list[tuple[float, float]] = field(default_factory=list)
    rate: float = 0.0
    times: list[float] = field(default_factory=list)

    def step(self, x: np.ndarray) -> None:
        self.apply(*gradients(self.model, x, self.config))

    def apply(self, grads: dict[str, np.ndarray], seen: dict) -> None:
        """Take a step with the gradients of a batch."""
        step = self.optimiser.step
        self.rate = learning_rate(step, self.config, self.total)
        self.optimiser.update(self.model, grads, self.rate)
        self.model.firing_count = self.model.firing_count + seen["fired"]
        if seen["edge"] is not None:
            self.model.threshold = seen["edge"] if step == 0 else self.config.ema * self.model.threshold + (1 - self.config.ema) * seen["edge"]
        self.losses.append((seen["recon_loss"], seen["aux_loss"]))
        self.times.append(time.time())

    def arrays(self) -> dict[str, np.ndarray]:
        """All state that averages over parts."""
        own = {name: getattr(self.model, name) for name in WEIGHTS}
        for name, (m, v) in self.optimiser.state.items():
            own |= {f"m:{name}": m, f"v:{name}": v}
        return own


#: In the order of the dictionary's fields.
WEIGHTS = ("w_enc", "b_enc", "w_dec", "b_dec")


def batches_of(arrays: Iterator[np.ndarray], size: int, sizes: Sequence[int] = ()) -> Iterator[np.ndarray]:
    """Rows of a stream of matrices in batches of ``sizes``, then of ``size``; the last one may be shorter."""
    held: list[np.ndarray] = []
    wanted = iter(sizes)
    n, size_now = 0, next(wanted, size)
    for x in arrays:
        while len(x):
            part = x[: size_now - n]
            held.append(part)
            n, x = n + len(part), x[len(part) :]
            if n == size_now:
                yield np.concatenate(held)
                held, n, size_now = [], 0, next(wanted, size)
    if held:
        yield np.concatenate(held)


def run_round(parts: Sequence[DataFrame], trainer: Trainer, sizes: Sequence[int] = ()) -> Trainer:
    """One pass over tables of one partition each, in their order, by a task each; then the mean of their states."""
    config, spark = trainer.config, parts[0].sparkSession
    start = spark.sparkContext.broadcast(pickle.dumps(Trainer(trainer.model, config, trainer.total, trainer.optimiser)))

    def train_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Trainer = pickle.loads(start.value)
        own.model.firing_count = np.zeros(config.d_dict, np.int64)
        tokens = 0
        for x in batches_of((matrix(b.column("activation")) for b in batches if b.num_rows), config.batch, sizes):
            tokens += len(x)
            own.step(x)
        means = np.mean(own.losses, axis=0) if own.losses else np.zeros(2)
        scalars = np.array([own.optimiser.step, own.model.threshold, *means, own.rate])
        yield from in_pieces({**own.arrays(), "fired": own.model.firing_count.astype(float), "scalars": scalars}, tokens)

    def average(group: pa.Table) -> pa.Table:
        """Means weighted by tokens; firing counts are added up, and the step is the largest."""
        name, weight = group.column("name")[0].as_py(), group.column("tokens").to_numpy().astype(float)
        keep = weight > 0
        stack = np.stack([np.frombuffer(p.as_buffer(), "<f8") for p in group.column("piece").combine_chunks()])[keep]
        out = stack.sum(0) if name == "fired" else (weight[keep] / weight.sum()) @ stack
        if name == "scalars":
            out[0] = stack[:, 0].max()
        return pa.table([pa.array([name]), group.column("at")[:1].combine_chunks(), pa.array([out.tobytes()], pa.binary())], names=["name", "at", "piece"])

    one_each = [p.select("activation").mapInArrow(train_part, PIECES) for p in parts]
    merged = reduce(DataFrame.unionAll, one_each).groupBy("name", "at").applyInArrow(average, "name string, at long, piece binary").orderBy("name", "at").collect()
    start.destroy()
    whole = joined(merged)
    shape = {n: getattr(trainer.model, n).shape for n in WEIGHTS}
    step, threshold, recon, aux, rate = whole["scalars"]
    model = Dictionary(*(whole[n].reshape(shape[n]) for n in WEIGHTS), float(threshold), whole["fired"].astype(np.int64), trainer.model.info)
    model.w_dec = model.w_dec / np.maximum(np.linalg.norm(model.w_dec, axis=1, keepdims=True), 1e-12)
    optimiser = AdamW(config)
    optimiser.step, optimiser.state = int(step), {n: tuple(whole[f"{k}:{n}"].reshape(shape[n]) for k in "mv") for n in WEIGHTS}
    return Trainer(model, config, trainer.total, optimiser, [(float(recon), float(aux))], float(rate))


def synchronous_step(epoch: NumberedEpoch, at: int, trainer: Trainer) -> None:
    """One step of the trainer with the gradient of a whole batch, made by ``config.parts`` tasks together."""
    config, (first, last) = trainer.config, epoch.bounds[at]

    def local(model: Dictionary, x: np.ndarray, edge: float | None, rows: int) -> dict[str, np.ndarray]:
        grads, seen = gradients(model, x, config, edge, rows)
        scalars = np.array([seen["recon_loss"], seen["aux_loss"]])
        # the boundary is the same in all tasks that have rows; the one with the batch's mean of it takes part by its share
        return {**grads, "scalars": scalars, "fired": seen["fired"].astype(float), "edge": np.array([0.0 if edge is None else edge * len(x) / rows, float(edge is not None) * len(x) / rows])}

    found = synchronous_gradients(epoch.between(first, last), trainer.model, last - first, config.parts, config.k, local)
    grads = {n: found[n].reshape(getattr(trainer.model, n).shape) for n in WEIGHTS}
    edge = float(found["edge"][0]) if found["edge"][1] > 0.5 else None
    trainer.apply(grads, {"recon_loss": float(found["scalars"][0]), "aux_loss": float(found["scalars"][1]), "edge": edge, "fired": found["fired"].astype(np.int64)})


def synchronous_steps(epoch: NumberedEpoch, first: int, last: int, trainer: Trainer) -> Trainer:
    """The same steps ``first`` to ``last`` (without it) in one stage, whose tasks all hold the weights.

    A task reads its share of the stretch once, in order. Each step the tasks gather boundary and gradients and add the
    latter up in the same order, so their weights stay equal to the bit; the first task gives them back.
    """
    config, bounds, width = trainer.config, epoch.bounds[first:last], len(trainer.model.b_dec)
    start = epoch.rows.sparkSession.sparkContext.broadcast(pickle.dumps(Trainer(trainer.model, config, trainer.total, trainer.optimiser)))
    key = secrets.token_hex(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        own: Trainer = pickle.loads(start.value)
        shapes = [getattr(own.model, n).shape for n in WEIGHTS]
        at = np.cumsum([math.prod(s) for s in shapes])
        with connected(context, key) as gather:
            for x, (a, b) in zip(shares(batches, bounds, width), bounds, strict=True):
                rows = b - a
                edge = boundary(np.maximum(own.model.preactivations(x), 0), config.k * rows, rows * config.d_dict, gather)
                grads, seen = gradients(own.model, x, config, edge, rows)
                flat = np.concatenate([*[grads[n].ravel() for n in WEIGHTS], seen["fired"].astype(float), [seen["recon_loss"], seen["aux_loss"]]])
                *parts, rest = np.split(sum(gathered(flat, gather)), at)
                found = {n: p.reshape(s) for n, p, s in zip(WEIGHTS, parts, shapes, strict=True)}
                own.apply(found, {"recon_loss": rest[-2], "aux_loss": rest[-1], "edge": edge, "fired": rest[:-2].astype(np.int64)})
        if context.partitionId() == 0:
            yield from in_pieces({**own.arrays(), "fired": own.model.firing_count.astype(float), "losses": np.array(own.losses), "times": np.array(own.times), "scalars": np.array([own.optimiser.step, own.model.threshold, own.rate])}, bounds[-1][1] - bounds[0][0])

    rows = epoch.between(bounds[0][0], bounds[-1][1]).repartition(config.parts).sortWithinPartitions("rank")
    whole = joined(sorted(rows.mapInArrow(run, PIECES, barrier=True).collect(), key=lambda r: (r["name"], r["at"])))
    start.destroy()
    step, threshold, rate = whole["scalars"]
    shape = {n: getattr(trainer.model, n).shape for n in WEIGHTS}
    model = Dictionary(*(whole[n].reshape(shape[n]) for n in WEIGHTS), float(threshold), whole["fired"].astype(np.int64), trainer.model.info)
    optimiser = AdamW(config)
    optimiser.step, optimiser.state = int(step), {n: tuple(whole[f"{k}:{n}"].reshape(shape[n]) for k in "mv") for n in WEIGHTS}
    return Trainer(model, config, trainer.total, optimiser, [(float(r), float(a)) for r, a in whole["losses"].reshape(-1, 2)], float(rate), whole["times"].tolist())


def in_one_stage(trainer: Trainer) -> bool:
    """Whether the tasks of synchronous steps hold the weights: they send each other few bytes."""
    return trainer.config.parts > 1 and 8 * sum(getattr(trainer.model, n).size for n in WEIGHTS) * trainer.config.parts <= S.GATHERED


def run_steps(epoch: NumberedEpoch, first: int, last: int, trainer: Trainer) -> Trainer:
    """The steps ``first`` to ``last`` (without it) of an epoch, in order; firing counts go on from the trainer's."""
    before = trainer.model.firing_count
    if trainer.config.parts > 1:
        if in_one_stage(trainer):
            return synchronous_steps(epoch, first, last, trainer)
        trainer.losses, trainer.times = [], []
        for at in range(first, last):
            synchronous_step(epoch, at, trainer)
        return trainer
    bounds = epoch.bounds[first:last]
    rows = epoch.between(bounds[0][0], bounds[-1][1]).coalesce(1).sortWithinPartitions("rank")
    trainer = run_round([rows], trainer, [b - a for a, b in bounds])
    trainer.model.firing_count = trainer.model.firing_count + before
    return trainer


def quick_sample(val: DataFrame, config: TrainConfig, key: str = "token_id") -> DataFrame:
    """About ``quick_batches`` batches of the held-out tokens, the same at every validation."""
    share = min(1.0, config.quick_batches * config.batch / max(val.count(), 1))
    return val.where(F.pmod(F.xxhash64(key, F.lit(-3), F.lit(config.seed)), F.lit(1 << 30)) / (1 << 30) < share)


def calibrate(model: Dictionary, activations: DataFrame, config: TrainConfig, n: int, key: str = "token_id", vector: str = "activation") -> float:
    """Threshold: mean over some batches of the smallest kept preactivation.

    The batches are hashed groups of about ``config.batch`` tokens, at most ``calibration_batches`` of them; each is
    one task's, so neither tokens nor preactivations leave the tasks.
    """
    groups = min(config.calibration_batches, max(1, round(n / config.batch)))
    share = min(1.0, groups * config.batch / max(n, 1))
    unit = F.pmod(F.xxhash64(key, F.lit(-1), F.lit(config.seed)), F.lit(1 << 30)) / (1 << 30)
    some = activations.where(unit < share).select(F.pmod(F.xxhash64(key, F.lit(-2), F.lit(config.seed)), F.lit(groups)).cast("int").alias("g"), F.col(vector).cast("array<float>").alias("activation"))

    def edge(group: pa.Table) -> pa.Table:
        x = matrix(group.column("activation").combine_chunks())
        return pa.table([pa.array([batch_topk(np.maximum(model.preactivations(x), 0), config.k)[1]], pa.float64())], names=["edge"])

    return float(some.groupBy("g").applyInArrow(edge, "edge double").agg(F.avg("edge")).first()[0] or 0.0)


def train(activations: DataFrame, config: TrainConfig, val: DataFrame | None = None, record: Callable[[dict], None] = lambda row: None) -> tuple[Dictionary, list[dict]]:
    """Train on (token_id, activation) rows; returns the dictionary with its calibrated threshold, and the log.

    ``record`` is called with each row of the log as soon as it is known, so a run that fails leaves what it did.
    """
    config.validate()
    first = activations.select(F.size("activation")).first()
    if first is None:
        raise ValueError("no activations to train on")
    if config.across_chunks:
        counts = [activations.count()]
    else:
        counts = [r["n"] for r in activations.groupBy("chunk_idx").agg(F.count("*").alias("n")).collect()]
    n, log = sum(counts), []
    total = max(1, -(-steps_per_epoch(counts, config.batch, config.across_chunks) // (config.parts if config.averaged else 1))) * config.epochs
    if 16 * first[0] * config.d_dict > WEIGHT_BYTES:
        raise ValueError(f"the dictionary would take {16 * first[0] * config.d_dict} bytes")
    trainer = Trainer(init(first[0], config), config, total, AdamW(config))

    def say(row: dict) -> None:
        log.append(row)
        record(row)

    began = time.time()
    sample = None if val is None else quick_sample(val, config)

    def validation() -> dict:
        """Of the sample, under the running threshold."""
        row = reconstruction(sample, trainer.model).drop("firing_count").first() if sample is not None else None
        return {f"val_{c}": row[c] for c in ("fve_uncentered", "fve_overall", "l0_mean", "strict_dead_pct")} if row else {}

    for epoch in range(config.epochs):
        trainer.model.firing_count = np.zeros(config.d_dict, np.int64)
        sums, done = np.zeros(2), 0
        if config.averaged:
            rows, path = ordered_epoch(activations, config, epoch)
            trainer = run_round([rows.where(F.col("part") == p).coalesce(1) for p in range(config.parts)], trainer)
            delete_path(activations.sparkSession, path)
            sums, done = np.array(trainer.losses[0]), 1
        else:
            numbered = numbered_epoch(activations, config.batch, epoch, config.seed, config.across_chunks)
            steps = len(numbered.bounds)
            while done < steps:
                at, marked = trainer.optimiser.step, lambda step: step % config.log_every == 0 or step % config.val_every == 0
                # steps that are one stage go on to the next validation; what is logged on the way is known when it ends
                stop = min(steps, *[(at // every + 1) * every - at + done for every in ((config.val_every,) if in_one_stage(trainer) else (config.log_every, config.val_every))])
                trainer = run_steps(numbered, done, stop, trainer)
                since, last, now = at, at + stop - done, time.time()
                for mark in [s for s in range(at + 1, last) if marked(s)] + [last]:
                    recon, aux = np.mean(trainer.losses[since - at : mark - at], axis=0)
                    sums += np.array([recon, aux]) * (mark - since)
                    if marked(mark):
                        extra = validation() if mark % config.val_every == 0 else {}
                        ended = time.time() if mark == last else now - (trainer.times[-1] - trainer.times[mark - at - 1])
                        say({"at_step": mark, "in_epoch": epoch, "lr": learning_rate(mark - 1, config, total), "recon_loss": float(recon), "aux_loss": float(aux), "elapsed_s": ended - began, **extra})
                    since = mark
                done = stop
            numbered.drop()
        recon, aux = sums / max(done, 1)
        say({"epoch": epoch, "step": trainer.optimiser.step, "lr": trainer.rate, "recon_loss": float(recon), "aux_loss": float(aux), "dead": int((trainer.model.firing_count < config.dead_after).sum()), "elapsed_s": time.time() - began, **validation()})
    model = trainer.model
    model.threshold = calibrate(model, activations, config, n)
    norms = np.linalg.norm(model.w_dec, axis=1)
    if np.abs(norms - 1).max() > 1e-3:
        raise ValueError("decoder rows lost their unit length")
    if val is not None:
        row = reconstruction(val, model).drop("firing_count").first()
        say({"validation": row.asDict() if row else None})
    return model, log
