"""Steps of training over a numbered epoch: one task after the other, or many tasks that take each step together.

An epoch is written once in hashed order, in range partitions whose rows are numbered, so a step is an interval of
numbers and reads only the folders that hold it. In a synchronous step the rows of a batch are dealt to barrier tasks.
They agree on the boundary of the batch's top-k by one ``allGather`` of their own largest values, as the boundary is
the batch's and not a task's. Where the partial gradients of all tasks take at most ``GATHERED`` bytes, the tasks hold
the weights and take the steps of a stretch in one stage, telling each other boundary and gradients over connections of
their own, as ``allGather`` takes about a second each time. Larger ones are given in pieces, a job for each step; pieces meet in a shuffle by name and place, so no task holds the gradients of all others, and one
summed gradient, as large as the dictionary, comes to the driver.
Summed over tasks it is the gradient of the whole batch: any number of tasks takes the steps that one task would.
"""

from __future__ import annotations

import base64
import hmac
import socket
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from typing import TYPE_CHECKING, TextIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import delete_path, staged_parts
from .dictionary import Dictionary, matrix
from .tokens import locally_numbered

if TYPE_CHECKING:
    from pyspark import BarrierTaskContext

#: Numbers of one array that travel in a row.
PIECE = 1 << 18
PIECES = "name string, at long, tokens long, piece binary"
#: Bytes of the gradients of all tasks that one task takes in a step.
GATHERED = 1 << 24


@dataclass
class NumberedEpoch:
    """rank, activation of all tokens by folder, the first number of each folder, and the steps as intervals."""

    rows: DataFrame
    path: str
    bases: list[int]
    bounds: list[tuple[int, int]]

    def between(self, first: int, last: int) -> DataFrame:
        """The tokens with numbers of at least ``first`` and below ``last``, from the folders that hold any."""
        low, high = bisect_right(self.bases, first) - 1, bisect_right(self.bases, last - 1) - 1
        rank = F.element_at(F.lit(self.bases), F.col("_part") + 1).cast("long") + F.col("_local")
        rows = self.rows.where(F.col("_part").between(low, high))
        if low == high:  # so that a reader skips the rest of the folder, whose rows are in order
            rows = rows.where((F.col("_local") >= first - self.bases[low]) & (F.col("_local") < last - self.bases[low]))
        rows = rows.select(rank.alias("rank"), "activation")
        return rows.where((F.col("rank") >= first) & (F.col("rank") < last))

    def drop(self) -> None:
        delete_path(self.rows.sparkSession, self.path)


def bounds_of(counts: list[int], batch: int) -> list[tuple[int, int]]:
    """Intervals of at most ``batch`` numbers that do not cross the end of a group; ``counts``: of the groups, in order."""
    out, at = [], 0
    for n in counts:
        out += [(at + a, at + min(a + batch, n)) for a in range(0, n, batch)]
        at += n
    return out


def numbered_epoch(activations: DataFrame, batch: int, epoch: int, seed: int, across_chunks: bool = True, key: str = "token_id", vector: str = "activation") -> NumberedEpoch:
    """Tokens in an order hashed from token, epoch and seed (of chunk first, where batches stay in a chunk)."""
    order = [F.xxhash64(key, F.lit(epoch), F.lit(seed)), F.col(key)]
    if not across_chunks:
        order = [F.xxhash64("chunk_idx", F.lit(epoch), F.lit(seed)), F.col("chunk_idx"), *order]
    names = [f"_o{i}" for i in range(len(order))]
    rows = activations.select(*[o.alias(n) for o, n in zip(order, names, strict=True)], F.col(vector).cast("array<float>").alias("activation"))
    rows, path = staged_parts(locally_numbered(rows, names), "epoch", "_part")
    found = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row for each folder
    bases, total = [], 0
    for part in range(max(found, default=-1) + 1):
        bases.append(total)
        total += found.get(part, 0)
    groups = [total] if across_chunks else [r["n"] for r in rows.groupBy("_o0", "_o1").agg(F.count("*").alias("n")).orderBy("_o0", "_o1").collect()]
    return NumberedEpoch(rows, path, bases, bounds_of(groups, batch))


def gathered(own: np.ndarray, gather: Callable[[str], list[str]]) -> list[np.ndarray]:
    """The arrays of all tasks, in their order."""
    return [np.frombuffer(base64.b64decode(s), "<f8") for s in gather(base64.b64encode(own.astype("<f8").tobytes()).decode())]


@contextmanager
def connected(context: BarrierTaskContext, key: str) -> Iterator[Callable[[str], list[str]]]:
    """``allGather`` of texts without line breaks and spaces, over connections of all tasks with the first.

    Where the first listens goes round by one real ``allGather``; ``key`` keeps strangers out. A task that ends early
    closes its connection, which ends the others, and the stage is run again as a whole.
    """
    own, hosts = context.partitionId(), [i.address.rsplit(":", 1)[0] for i in context.getTaskInfos()]
    with ExitStack() as stack:
        opened = lambda s: s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1) or stack.enter_context(stack.enter_context(s).makefile("rw", encoding="latin-1", newline="\n"))
        if own:
            peer = opened(socket.create_connection((hosts[0], int(context.allGather("")[0]))))
            say(peer, f"{key} {own}")
        else:
            listener = stack.enter_context(socket.create_server((hosts[0], 0), backlog=len(hosts)))
            context.allGather(str(listener.getsockname()[1]))
            peers = {}
            while len(peers) < len(hosts) - 1:
                stream = opened(listener.accept()[0])
                told, _, number = stream.readline().strip().partition(" ")
                if hmac.compare_digest(told.encode(), key.encode()):
                    peers[int(number)] = stream

        def gather(text: str) -> list[str]:
            if own:
                say(peer, text)
                return heard(peer).split(" ")
            texts = [text, *[heard(peers[i]) for i in range(1, len(hosts))]]
            for i in peers:
                say(peers[i], " ".join(texts))
            return texts

        yield gather


def say(stream: TextIO, text: str) -> None:
    stream.write(f"{text}\n")
    stream.flush()


def heard(stream: TextIO) -> str:
    line = stream.readline()
    if not line.endswith("\n"):
        raise ConnectionError("another task of the step has ended")
    return line[:-1]


def shares(batches: Iterator[pa.RecordBatch], bounds: Sequence[tuple[int, int]], width: int) -> Iterator[np.ndarray]:
    """Of each interval the rows that a task holds, which may be none; ``batches`` have (rank, activation) in order of rank."""
    ends = iter([b for _, b in bounds])
    end, held = next(ends), [np.zeros((0, width))]
    for b in batches:
        if not b.num_rows:
            continue
        rank, x = b.column("rank").to_numpy(), matrix(b.column("activation"))
        while rank[-1] >= end:
            cut = int(np.searchsorted(rank, end))
            yield np.concatenate([*held, x[:cut]])
            rank, x, end, held = rank[cut:], x[cut:], next(ends), [np.zeros((0, width))]
        held.append(x)
    yield np.concatenate(held)
    for _ in ends:
        yield np.zeros((0, width))


def boundary(local: np.ndarray, keep: int, size: int, gather: Callable[[str], list[str]]) -> float | None:
    """The ``keep``-th largest of the values of all tasks, ``size`` in all; None if all are kept.

    A task sends its own ``keep`` largest at most, so what is sent is bounded by the batch's k and its size.
    """
    if keep >= size:
        return None
    own = local.ravel()
    own = own[np.argpartition(own, len(own) - keep)[len(own) - keep :]] if len(own) > keep else own
    every = np.concatenate(gathered(own, gather))
    return float(np.partition(every, len(every) - keep)[len(every) - keep])


def in_pieces(arrays: dict[str, np.ndarray], tokens: int) -> Iterator[pa.RecordBatch]:
    for name, values in arrays.items():
        flat = np.ascontiguousarray(values, "<f8").ravel()
        for at in range(0, len(flat), PIECE):
            row = [[name], [at], [tokens], [flat[at : at + PIECE].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["name", "at", "tokens", "piece"])


def joined(rows: list) -> dict[str, np.ndarray]:
    """Arrays from their pieces in order of name and place."""
    return {name: np.concatenate([np.frombuffer(r["piece"], "<f8") for r in rows if r["name"] == name]) for name in dict.fromkeys(r["name"] for r in rows)}


def add_pieces(group: pa.Table) -> pa.Table:
    stack = sum(np.frombuffer(p.as_buffer(), "<f8") for p in group.column("piece").combine_chunks())
    return pa.table([group.column("name")[:1].combine_chunks(), group.column("at")[:1].combine_chunks(), pa.array([stack.tobytes()], pa.binary())], names=["name", "at", "piece"])


def synchronous_gradients(batch: DataFrame, model: Dictionary, rows: int, parts: int, k: int, local: Callable[[Dictionary, np.ndarray, float | None, int], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums over all tasks of what ``local`` (model, rows of the task, boundary, rows of the batch) gives for each.

    ``parts`` tasks run at the same time; with fewer free cores the scheduler refuses the stage.
    """
    sent = batch.sparkSession.sparkContext.broadcast((model.w_enc, model.b_enc, model.w_dec, model.b_dec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        own = Dictionary(*sent.value, 0.0)
        width = own.w_dec.shape[1]
        held = [matrix(b.column("activation")) for b in batches if b.num_rows]
        x = np.concatenate(held) if held else np.zeros((0, width))
        h = np.maximum(own.preactivations(x), 0)
        edge = boundary(h, k * rows, rows * own.w_dec.shape[0], BarrierTaskContext.get().allGather)
        if len(x):
            yield from in_pieces(local(own, x, edge, rows), len(x))

    partial = batch.select("activation").repartition(parts).mapInArrow(run, PIECES, barrier=True)
    found = partial.groupBy("name", "at").applyInArrow(add_pieces, "name string, at long, piece binary").orderBy("name", "at").collect()
    sent.destroy()
    return joined(found)
