"""Concept statistics, contingency metrics, false-discovery control and related reductions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.numeric import chi2_p, d, ratio
from ..plans.registry import has
from ..staging import staged


def concept_counts(labels: DataFrame, n_concepts: int, mask: str = "concepts") -> DataFrame:
    """ci, cj, n11 for every pair ci <= cj (ci = cj: the marginal), and n, from bitmasks.

    Rows are first counted by mask: few masks differ, so the pairs are expanded from thousands of rows at most.
    """
    masks = labels.groupBy(mask).agg(F.count("*").alias("n"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(n_concepts - 1)), lambda i: F.getbit(F.col(mask), i) == 1)
    own = masks.select("n", bits.alias("bits"))
    pairs = own.select("n", "bits", F.explode("bits").alias("ci")).select("n", "ci", F.explode(F.filter("bits", lambda b: b >= F.col("ci"))).alias("cj"))
    return pairs.groupBy("ci", "cj").agg(F.sum("n").alias("n11"))


def base_rates(labels: DataFrame, n_concepts: int, mask: str = "concepts") -> DataFrame:
    """concept_idx, marginal, total, base_rate of every concept, those that never hold included."""
    sums = labels.agg(F.count("*").alias("total"), *[F.sum(F.when(has(F.col(mask), i), 1).otherwise(0)).alias(f"c{i}") for i in range(n_concepts)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("concept_idx"), F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long").alias("marginal")) for i in range(n_concepts)]))
    return sums.select(each.alias("x"), "total").select("x.*", "total", (F.col("x.marginal") / F.greatest("total", F.lit(1))).alias("base_rate"))


def phi(n11: Column, ni: Column, nj: Column, n: Column) -> Column:
    n10, n01 = ni - n11, nj - n11
    n00 = n - ni - nj + n11
    product = (n11 + n10).cast("double") * (n00 + n01) * (n11 + n01) * (n00 + n10)
    return (n11.cast("double") * n00 - n10.cast("double") * n01) / F.sqrt(F.greatest(product, d(1e-12)))


def phi_matrix(labels: DataFrame, n_concepts: int, mask: str = "concepts") -> DataFrame:
    """ci, cj, n11, phi for all pairs; 1 on the diagonal."""
    counts = concept_counts(labels, n_concepts, mask)
    rates = base_rates(labels, n_concepts, mask).select("concept_idx", "marginal", "total")
    both = counts.unionByName(counts.where("ci < cj").select(F.col("cj").alias("ci"), F.col("ci").alias("cj"), "n11"))
    left = rates.select(F.col("concept_idx").alias("ci"), F.col("marginal").alias("ni"), "total")
    right = left.select(F.col("ci").alias("cj"), F.col("ni").alias("nj"))
    grid = left.withColumn("cj", F.explode(F.sequence(F.lit(0), F.lit(n_concepts - 1)))).join(right, "cj").join(both, ["ci", "cj"], "left").withColumn("n11", F.coalesce("n11", F.lit(0)))
    value = F.when(F.col("ci") == F.col("cj"), d(1)).otherwise(phi(F.col("n11"), F.col("ni"), F.col("nj"), F.col("total")))
    return grid.select("ci", "cj", "n11", value.alias("phi"))


def correlated(phis: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs of different concepts with |phi| over a threshold."""
    return phis.where((F.col("ci") != F.col("cj")) & (F.abs("phi") > threshold))


def contingency_metrics(pairs: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, f1_dom, lift, chi2 and p_value to rows with n11, mf, mc, n; denominators are floored."""
    n11, mf, mc, n = (F.col(c).cast("double") for c in ("n11", "mf", "mc", "n"))
    n10, n01 = mf - n11, mc - n11
    n00 = n - mf - mc + n11
    precision, recall = ratio(n11, n11 + n10), ratio(n11, n11 + n01)
    f1 = ratio(2 * precision * recall, precision + recall)
    lift = ratio(n11 * n, mf * mc)
    chi2 = ratio(n * (n11 * n00 - n10 * n01) * (n11 * n00 - n10 * n01), (n11 + n10) * (n00 + n01) * (n11 + n01) * (n00 + n10))
    dominance = F.greatest(d(0), 1 - ratio(ratio(n10, n10 + n00), ratio(n11, n11 + n01)))
    out = pairs.withColumns({"precision": precision, "recall": recall, "f1": f1, "f1_dom": f1 * dominance, "lift": lift, "chi2": chi2})
    return out.withColumn("p_value", chi2_p(F.col("chi2")))


def bh_reject(pairs: DataFrame, q: float = 0.05, p: str = "p_value") -> DataFrame:
    """Adds ``rejected`` by Benjamini-Hochberg over all rows at once.

    The family is one row for each feature and concept. Equal p-values share their largest rank and fall together, so
    ranks are needed for distinct values only: these are counted first, then summed in order.
    """
    values = pairs.groupBy(p).agg(F.count("*").alias("_n"))
    ranked = running_sums(values, p, "_n").withColumn("_rank", F.col("before") + F.col("_n"))
    cut = ranked.join(F.broadcast(ranked.agg(F.sum("_n").alias("_m")))).where(F.col(p) <= F.col("_rank") / F.col("_m") * q).agg(F.max(p).alias("_cut"))
    return pairs.join(F.broadcast(cut)).withColumn("rejected", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def running_sums(counts: DataFrame, value: str, n: str) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over all rows with a smaller ``value`` (distinct ones), without one task for all.

    Rows are dealt to ranges and sorted there; a task adds up its own range, and one sum for each range comes to the
    driver and goes back as an offset.
    """
    schema = StructType([*counts.schema.fields, StructField("_part", IntegerType()), StructField("_local", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0.0
        for b in batches:
            sums = total + np.cumsum(b.column(n).to_numpy().astype(float))
            before = np.concatenate([[total], sums[:-1]])[: b.num_rows]
            total = float(sums[-1]) if b.num_rows else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(before)], names=schema.names)

    ranged = counts.repartitionByRange(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), value).sortWithinPartitions(value)
    rows = staged(ranged.mapInArrow(run, schema), "ranges")
    sums = {r["_part"]: float(r["s"]) for r in rows.groupBy("_part").agg(F.sum(n).alias("s")).collect()}
    offsets = np.concatenate([[0.0], np.cumsum([sums.get(i, 0.0) for i in range(max(sums, default=0) + 1)])]).tolist()
    return rows.withColumn("before", F.element_at(F.lit(offsets), F.col("_part") + 1) + F.col("_local")).drop("_part", "_local")


def gini(values: DataFrame, column: str) -> DataFrame:
    """Gini coefficient of one non-negative column; 0 if its sum is not positive. Ranks are of distinct values."""
    x = values.groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").cast("double").alias("c"))
    rows = running_sums(x, "x", "c").withColumn("ranks", F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2)
    s = rows.agg(F.sum(F.col("ranks") * F.col("x")).alias("w"), F.sum(F.col("x") * F.col("c")).alias("s"), F.sum("c").alias("n"))
    return s.select(F.when(F.col("s") > 0, (2 * F.col("w") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))).otherwise(d(0)).alias("gini"))


#: Bins of a pass over the values, and values of a bin that are sorted at once.
BINS, FEW = 1024, 4096


def exact_quantiles(rows: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float], few: int = FEW) -> DataFrame:
    """keys, n, q: the exact quantiles of each group in an array, interpolated as ``percentile`` does; nulls are left out.

    No task holds a group's values. Each pass counts the bins of the ranges that still hold a wanted rank, and narrows
    a range to the bin of its rank, until the bin has one value only or at most ``few`` rows, which are then sorted.
    Counts, not values, are shuffled: at most groups x ranks x bins of them from a task.
    """
    by = list(keys)
    x = rows.select(*by, F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    sizes = staged(x.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")), "sizes")
    place = lambda s: (F.col("n") - 1) * d(s)
    wanted = [F.struct(F.lit(i).alias("i"), f.alias("up"), r(place(s)).cast("long").alias("rank")) for i, s in enumerate(shares) for f, r in ((F.lit(0), F.floor), (F.lit(1), F.ceil))]
    ranges = sizes.withColumn("w", F.explode(F.array(*wanted))).select(*by, "w.i", "w.up", "w.rank", "low", "high", "n")
    state = ["i", "up", "rank", "low", "high", "n"]
    done: list[DataFrame] = []
    while True:
        open_ = ranges.where((F.col("low") < F.col("high")) & (F.col("n") > few))
        done.append(ranges.where((F.col("low") == F.col("high")) | (F.col("n") <= few)))
        if not open_.limit(1).count():
            break
        own = staged(open_, "ranges")
        distinct = F.broadcast(own.select(*by, "low", "high").distinct())
        inside = x.join(distinct, by) if by else x.join(distinct)
        inside = inside.where(F.col("x").between(F.col("low"), F.col("high")))
        width = F.col("high") / BINS - F.col("low") / BINS
        number = F.least(F.floor((F.col("x") - F.col("low")) / F.greatest(width, d(5e-324))), F.lit(BINS - 1))
        bins = inside.groupBy(*by, "low", "high", number.alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
        before = F.coalesce(F.sum("c").over(W.partitionBy(*by, "low", "high").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found = own.join(bins.withColumn("before", before), [*by, "low", "high"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
        ranges = staged(found.select(*by, "i", "up", (F.col("rank") - F.col("before")).alias("rank"), F.col("a").alias("low"), F.col("b").alias("high"), F.col("c").alias("n")), "ranges")
    last = reduce(DataFrame.unionByName, done).select(*by, *state)
    small = staged(last.where((F.col("low") < F.col("high"))), "small")
    ends = F.broadcast(small.select(*by, "low", "high").distinct())
    held = (x.join(ends, by) if by else x.join(ends)).where(F.col("x").between(F.col("low"), F.col("high"))).groupBy(*by, "low", "high").agg(F.sort_array(F.collect_list("x")).alias("v"))
    known = small.join(held, [*by, "low", "high"]).select(*by, "i", "up", F.element_at("v", (F.col("rank") + 1).cast("int")).alias("x"))
    values = known.unionByName(last.where("low = high").select(*by, "i", "up", F.col("low").alias("x")))
    both = values.groupBy(*by, "i").agg(F.max(F.when(F.col("up") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("up") == 1, F.col("x"))).alias("b"))
    own = both.join(sizes.select(*by, "n"), by) if by else both.join(F.broadcast(sizes.select("n")))
    share = F.element_at(F.lit([float(s) for s in shares]), F.col("i") + 1)
    at = (F.col("n") - 1) * share
    value = F.when(F.floor(at) == F.ceil(at), F.col("a")).otherwise((F.ceil(at) - at) * F.col("a") + (at - F.floor(at)) * F.col("b"))
    return own.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias("q"))


def pearson(groups: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, n, r: null for fewer than three pairs or a constant side."""
    out = groups.groupBy(*keys).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.covar_pop(x, y).alias("xy"))
    fine = (F.col("n") >= 3) & (F.col("sx") >= 1e-12) & (F.col("sy") >= 1e-12)
    return out.select(*keys, "n", F.when(fine, F.col("xy") / (F.col("sx") * F.col("sy"))).alias("r"))


def zscore(values: DataFrame, keys: Sequence[str], value: str, control: str) -> DataFrame:
    """keys, value's z against its group's controls: null for fewer than two or a spread of at most 1e-12."""
    known = F.when(~F.isnan(control), F.col(control))
    out = values.groupBy(*keys).agg(F.first(value).alias("v"), F.count(known).alias("n"), F.avg(known).alias("mean"), F.stddev_samp(known).alias("sd"))
    return out.select(*keys, "n", "mean", "sd", F.when((F.col("n") >= 2) & (F.col("sd") > 1e-12), (F.col("v") - F.col("mean")) / F.col("sd")).alias("z"))
