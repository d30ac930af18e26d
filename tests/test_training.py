"""Steps over a numbered epoch: many tasks against one and against a plain loop; validation while training."""

import socket
import threading
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from peakloom.operators import steps, training

NAMES = ("w_enc", "b_enc", "w_dec", "b_dec")


@pytest.fixture(scope="module")
def tokens(spark):
    rng = np.random.default_rng(8)
    basis = rng.normal(size=(6, 8))
    x = rng.random((500, 6)) * (rng.random((500, 6)) < 0.4) @ basis
    return spark.createDataFrame([(i, i // 90, v.tolist(), 1) for i, v in enumerate(x.astype(np.float32))], "token_id long, chunk_idx int, activation array<float>, rank int")


def plain(tokens, config, epochs=1):
    """The same batches in memory."""
    own = training.Trainer(training.init(8, config), config, 0, training.AdamW(config))
    sizes = []
    for epoch in range(epochs):
        numbered = steps.numbered_epoch(tokens, config.batch, epoch, config.seed, config.across_chunks)
        x = np.array([r["activation"] for r in numbered.between(0, 500).orderBy("rank").collect()], float)
        own.total = len(numbered.bounds) * epochs
        own.model.firing_count = np.zeros(config.d_dict, np.int64)
        for a, b in numbered.bounds:
            own.step(x[a:b])
            sizes.append(b - a)
        numbered.drop()
    return own, sizes


@pytest.mark.parametrize("across", [True, False])
def test_any_number_of_tasks_takes_the_same_steps(spark, tokens, across):
    results, logs = [], []
    for parts in (1, 3):
        config = training.TrainConfig(d_dict=12, k=3, k_aux=4, epochs=2, batch=64, warmup=3, lr=2e-2, across_chunks=across, parts=parts, clip=0.05)
        model, log = training.train(tokens, config)
        results.append(model)
        logs.append(log)
    own, sizes = plain(tokens, config, 2)
    assert len(sizes) == (16 if across else 22) and sum(sizes) == 1000
    for name in NAMES:
        assert np.abs(getattr(results[0], name) - getattr(results[1], name)).max() < 1e-6
        assert np.abs(getattr(results[1], name) - getattr(own.model, name)).max() < 1e-6
    assert results[0].firing_count.tolist() == results[1].firing_count.tolist() == own.model.firing_count.tolist()
    for a, b in zip(*logs, strict=True):
        assert a["step"] == b["step"] and np.isclose(a["recon_loss"], b["recon_loss"]) and np.isclose(a["aux_loss"], b["aux_loss"]) and a["dead"] == b["dead"]


@pytest.mark.parametrize("parts", [2, 3])
def test_steps_of_a_stretch_are_one_stage(spark, tokens, parts):
    """The jobs do not grow with the steps; batches of two leave a task of three without a row."""
    jobs, context = [], spark.sparkContext
    for batch in (64, 2):
        config = training.TrainConfig(d_dict=12, k=3, k_aux=4, epochs=1, batch=batch, warmup=3, lr=2e-2, parts=parts, log_every=100)
        context.setJobGroup(f"steps-{parts}-{batch}", "")
        model, log = training.train(tokens, config)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"steps-{parts}-{batch}")))
        context.setLocalProperty("spark.jobGroup.id", None)
        own, sizes = plain(tokens, config)
        assert log[-1]["step"] == len(sizes) == (8 if batch == 64 else 250)
        assert all(np.abs(getattr(model, name) - getattr(own.model, name)).max() < 1e-6 for name in NAMES)
        assert model.firing_count.tolist() == own.model.firing_count.tolist() and np.isclose(log[-1]["recon_loss"], np.mean(own.losses, axis=0)[0])
    assert jobs[0] == jobs[1]


def test_large_and_small_gradients_take_the_same_steps(spark, tokens, monkeypatch):
    """With validation and a log on the way; large ones meet in a shuffle."""
    config = training.TrainConfig(d_dict=12, k=3, k_aux=4, epochs=2, batch=64, warmup=3, lr=2e-2, parts=2, log_every=2, val_every=5, quick_batches=1)
    train, val = tokens.where("chunk_idx < 4"), tokens.where("chunk_idx >= 4")
    small, one = training.train(train, config, val)
    monkeypatch.setattr(steps, "GATHERED", 0)
    large, other = training.train(train, config, val)
    assert all(np.abs(getattr(small, name) - getattr(large, name)).max() < 1e-6 for name in NAMES)
    assert [r["at_step"] for r in one if "at_step" in r] == [2, 4, 5, 6, 8, 10, 12]
    for a, b in zip(one[:-1], other[:-1], strict=True):
        assert a.keys() == b.keys() and all(np.isclose(a[c], b[c]) for c in a if c != "elapsed_s")
    assert all(x["elapsed_s"] <= y["elapsed_s"] for x, y in zip(one[:-1], one[1:-1]))


def test_shares_follow_the_intervals():
    rank = [0, 3, 4, 5, 11, 12]
    rows = pa.table({"rank": pa.array(rank, pa.int64()), "activation": pa.array([[float(r), 1.0] for r in rank])})
    bounds = [(0, 4), (4, 6), (6, 9), (9, 12), (12, 15), (15, 20)]
    for size in (1, 2, 6):
        got = [x[:, 0].tolist() for x in steps.shares(iter(rows.to_batches(size)), bounds, 2)]
        assert got == [[0, 3], [4, 5], [], [11], [12], []]
    assert [x.shape for x in steps.shares(iter([]), bounds, 2)] == [(0, 2)] * 6


def test_tasks_gather_over_their_own_connections():
    """In order of the tasks, with empty texts, past a stranger; a task that ends makes the others fail."""
    port, told, results = [], threading.Event(), {}

    def all_gather(text):
        if text:
            port.append(text)
            with socket.create_connection(("127.0.0.1", int(text))) as stranger:
                stranger.sendall(b"\xff\xe9 1\n")
            told.set()
        told.wait(10)
        return [*port, "", ""]

    def task(i):
        context = SimpleNamespace(partitionId=lambda: i, allGather=all_gather, getTaskInfos=lambda: [SimpleNamespace(address="127.0.0.1:1")] * 3)
        try:
            with steps.connected(context, "key") as gather:
                results[i] = [gather(f"a{i}"), gather("" if i == 1 else "x")]
                if i != 2:
                    gather("b")
        except OSError as error:
            results[i].append(type(error))

    threads = [threading.Thread(target=task, args=(i,), daemon=True) for i in range(3)]
    [t.start() for t in threads]
    [t.join(20) for t in threads]
    assert all(results[i][:2] == [["a0", "a1", "a2"], ["x", "", "x"]] for i in range(3))
    assert len(results[2]) == 2 and all(issubclass(results[i][2], OSError) for i in (0, 1))


def test_a_boundary_is_that_of_all_tasks():
    rng = np.random.default_rng(1)
    for keep, shares in ((5, [4, 0, 9]), (30, [10, 10, 11]), (1, [3, 3]), (6, [2, 5])):
        values = [np.round(rng.random((n, 3)), 1) for n in shares]
        size = sum(v.size for v in values)
        sent = []
        for v in values:
            try:
                steps.boundary(v, keep, size, lambda text: sent.append(text) or 1 / 0)
            except ZeroDivisionError:
                pass
        got = steps.boundary(values[0], keep, size, lambda text: sent)
        assert got == sorted(np.concatenate([v.ravel() for v in values]))[-keep]
    assert steps.boundary(np.zeros((2, 3)), 6, 6, None) is None


def test_shares_of_a_batch_add_up():
    rng = np.random.default_rng(2)
    config = training.TrainConfig(d_dict=9, k=2, k_aux=3)
    model, x = training.init(5, config), rng.normal(size=(31, 5))
    whole, seen = training.gradients(model, x, config)
    shares = [training.gradients(model, part, config, seen["edge"], 31) for part in (x[:4], x[4:20], x[20:])]
    for name in NAMES:
        assert np.allclose(sum(g[name] for g, _ in shares), whole[name])
    assert np.isclose(sum(s["recon_loss"] for _, s in shares), seen["recon_loss"]) and (sum(s["fired"] for _, s in shares) == seen["fired"]).all()


def test_an_epoch_is_read_by_intervals(spark, tokens):
    numbered = steps.numbered_epoch(tokens, 64, 0, 0)
    assert numbered.bounds[0] == (0, 64) and numbered.bounds[-1] == (448, 500)
    ranks = [[r["rank"] for r in numbered.between(a, b).collect()] for a, b in numbered.bounds]
    assert [sorted(r) for r in ranks] == [list(range(a, b)) for a, b in numbered.bounds]
    assert len(numbered.between(0, 64).inputFiles()) >= 1 and "PartitionFilters" in numbered.between(0, 64)._jdf.queryExecution().toString()
    other = steps.numbered_epoch(tokens, 64, 1, 0)
    assert numbered.between(0, 500).orderBy("rank").first() != other.between(0, 500).orderBy("rank").first()
    assert steps.bounds_of([5, 0, 3], 4) == [(0, 4), (4, 5), (5, 8)]


def test_validation_while_training(spark, tokens):
    config = training.TrainConfig(d_dict=12, k=3, k_aux=4, epochs=2, batch=64, warmup=3, lr=2e-2, log_every=3, val_every=4, quick_batches=1)
    train, val = tokens.where("chunk_idx < 4"), tokens.where("chunk_idx >= 4")
    seen = []
    model, log = training.train(train, config, val, seen.append)
    assert seen == log
    assert [r["at_step"] for r in log if "at_step" in r] == [3, 4, 6, 8, 9, 12]
    assert [r["at_step"] for r in log if "at_step" in r and "val_fve_overall" in r] == [4, 8, 12]
    epochs = [r for r in log if "epoch" in r]
    assert [r["step"] for r in epochs] == [6, 12] and all(0 <= r["val_strict_dead_pct"] <= 100 and r["val_l0_mean"] >= 0 for r in epochs)
    n = training.quick_sample(val, config).count()
    assert 20 < n < 110 and "validation" in log[-1]
    again, _ = training.train(train, training.TrainConfig(**{**config.__dict__, "log_every": 100, "val_every": 1000}))
    assert np.allclose(model.w_dec, again.w_dec)  # looking on changes nothing
