"""From features to examples, prompts, replies and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import d, relative
from ..plans.registry import CONCEPTS, has
from ..staging import staged
from .causal import Draw, unit_hash
from .statistics import pearson

BINS, PER_BIN, TOP_BIN, ZEROS, LEAST_ACTIVE, NEIGHBOURS, EXTRA = 10, 2, 6, 8, 12, 6, 4


STRATA = ("causal", "concept", "unlabelled")


def select_strata(stats: DataFrame, causal: DataFrame, n: int = 40, seed: int = 0, strata: Sequence[str] = STRATA, draw: Draw = unit_hash) -> DataFrame:
    """feature_idx, stratum: causal by |selectivity|, then concept by f1_dom, then unlabelled by hash; one stratum each, and only ``strata``."""
    if odd := set(strata) - set(STRATA):
        raise ValueError(f"no such strata: {sorted(odd)}")
    c = causal.select("feature_idx", F.abs("selectivity").alias("s"))
    first = c.where(F.lit("causal" in strata)).orderBy(F.coalesce(F.nanvl(F.col("s"), F.lit(None).cast("double")), d(-1)).desc(), "feature_idx").limit(n).select("feature_idx", F.lit("causal").alias("stratum"))
    open_1 = stats.join(first.select("feature_idx"), "feature_idx", "left_anti")
    second = open_1.where("n_significant_concepts > 0").orderBy(F.col("max_f1_dom").desc(), "feature_idx").limit(n).select("feature_idx", F.lit("concept").alias("stratum"))
    third = open_1.where("n_significant_concepts = 0 AND firing_rate > 0").orderBy(draw("feature_idx", seed), "feature_idx").limit(n).select("feature_idx", F.lit("unlabelled").alias("stratum"))
    return first.unionByName(second).unionByName(third).where(F.col("stratum").isin(*strata))


def feature_scale(activations: DataFrame, top: DataFrame) -> DataFrame:
    """feature_idx, peak: the larger of the sampled and the overall maximum."""
    both = activations.select("feature_idx", "activation").unionByName(top.select("feature_idx", "activation"))
    return both.groupBy("feature_idx").agg(F.greatest(F.max("activation"), d(0)).alias("peak"))


def activation_bin(x: Column) -> Column:
    """Bin of (b/10, (b+1)/10]; null outside (0, 1]."""
    edges = F.array(*[d(b / BINS) for b in range(BINS + 1)])
    inside = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: (x > F.element_at(edges, b + 1)) & (x <= F.element_at(edges, b + 2)))
    return F.when((x > 0) & (x <= 1), F.element_at(inside, 1))


def sample_examples(activations: DataFrame, scale: DataFrame, tokens: DataFrame, keys: Sequence[str], seed: int = 0, draw: Draw = unit_hash) -> DataFrame:
    """Examples of each feature: two tokens of each bin, six of the top one, eight at zero, in hashed order.

    ``activations``: keys, feature_idx, activation (stored values); ``tokens``: keys of the sampled chunks. Features with
    fewer than twelve active tokens have none. Zeros are drawn from the few tokens with the least hash that the
    feature is not active on, so no feature is joined with all tokens but those that fire on nearly all of these; of
    such ones there are no more than features are active on a token.
    """
    rows = activations.join(F.broadcast(scale.where("peak > 0")), "feature_idx").withColumn("x", F.col("activation") / F.col("peak")).where("x > 0")
    live = rows.groupBy("feature_idx").agg(F.count("*").alias("active")).where(F.col("active") >= LEAST_ACTIVE)
    rows = rows.join(F.broadcast(live.select("feature_idx")), "feature_idx").withColumn("bin", activation_bin(F.col("x")))
    order = W.partitionBy("feature_idx", "bin").orderBy(draw("feature_idx", *keys, seed), *keys)
    want = F.when(F.col("bin") == BINS - 1, TOP_BIN).otherwise(PER_BIN)
    active = rows.where("bin IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= want).select("feature_idx", *keys, F.col("x").alias("activation"))
    fired = activations.where("activation != 0").select("feature_idx", *keys)
    nearest = W.partitionBy("feature_idx").orderBy(draw(*keys, seed), *keys)

    def zeros_of(features: DataFrame, pool: DataFrame) -> DataFrame:
        free = features.select("feature_idx").join(F.broadcast(pool) if pool is not tokens else pool.select(*keys)).join(fired, ["feature_idx", *keys], "left_anti")
        return free.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= ZEROS).select("feature_idx", *keys, d(0).alias("activation"))

    near = staged(zeros_of(live, tokens.select(*keys).orderBy(draw(*keys, seed), *keys).limit(64 * ZEROS)), "zeros")
    short = live.join(near.groupBy("feature_idx").agg(F.count("*").alias("n")).where(F.col("n") == ZEROS), "feature_idx", "left_anti")
    zeros = near.join(short.select("feature_idx"), "feature_idx", "left_anti").unionByName(zeros_of(F.broadcast(short), tokens))
    shuffled = W.partitionBy("feature_idx").orderBy(draw("feature_idx", *keys, seed + 1), *keys)
    return active.unionByName(zeros).withColumn("example_id", F.row_number().over(shuffled) - 1)


def add_global_top(examples: DataFrame, top: DataFrame, scale: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Up to four of each feature's strongest tokens that lie in the sampled chunks and are not examples yet."""
    fresh = top.join(F.broadcast(chunks.select("chunk_idx").distinct()), "chunk_idx").join(examples.select("feature_idx", *keys), ["feature_idx", *keys], "left_anti")
    sized = fresh.join(F.broadcast(scale.where("peak > 0")), "feature_idx").join(examples.groupBy("feature_idx").agg(F.count("*").alias("have")), "feature_idx")
    order = W.partitionBy("feature_idx").orderBy(F.col("activation").desc(), *[F.col(k).desc() for k in keys])
    more = sized.withColumn("place", F.row_number().over(order)).where(F.col("place") <= EXTRA)
    return examples.unionByName(more.select("feature_idx", *keys, (F.col("activation") / F.col("peak")).alias("activation"), (F.col("have") + F.col("place") - 1).cast("int").alias("example_id")))


def intensity_rank(peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds peak_rank (1: most intense), n_peaks, and rel_intensity in the spectrum."""
    own = W.partitionBy(*keys)
    return peaks.withColumns({
        "peak_rank": F.row_number().over(own.orderBy(F.col("intensity").desc(), "position")), "n_peaks": F.count("*").over(own), "rel_intensity": relative(F.col("intensity"), F.max("intensity").over(own)),
    })


def nearest_peaks(peaks: DataFrame, wanted: DataFrame | None, keys: Sequence[str], k: int = NEIGHBOURS) -> DataFrame:
    """keys, position, neighbour_mzs: the ``k`` peaks next in m/z (ties: the earlier one), the peak itself left out by key, in stored order, 4 decimals.

    For all peaks, or those of ``wanted`` (keys, position). Peaks of a spectrum with equal m/z are one row, and the
    ``k`` rows before and after it in order of m/z hold all that can be next to it; so the work grows with a spectrum's
    peaks, not their square. A peak without others has an empty list, one without m/z no row.
    """
    own = peaks.where(F.col("mz").isNotNull()).select(*keys, "position", "mz")
    if wanted is not None:
        own = own.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    level = own.repartition(*keys).groupBy(*keys, "mz").agg(F.sort_array(F.collect_list("position")).alias("_p"))
    frame = W.partitionBy(*keys).orderBy("mz").rowsBetween(-k, k)
    around = level.withColumn("_near", F.collect_list(F.struct(F.slice("_p", 1, k + 1).alias("p"), F.col("mz").alias("m"))).over(frame))
    rows = around.select(*keys, "mz", "_near", F.explode("_p").alias("position"))
    if wanted is not None:
        rows = rows.join(wanted.select(*keys, "position").distinct(), [*keys, "position"])
    each = F.flatten(F.transform("_near", lambda x: F.transform(x["p"], lambda p: F.struct(F.abs(F.col("mz") - x["m"]).alias("d"), p.alias("p"), x["m"].alias("m")))))
    best = F.slice(F.array_sort(F.filter(each, lambda x: x["p"] != F.col("position"))), 1, k)
    listed = F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m")))), lambda x: F.round(x["m"], 4))
    return rows.select(*keys, "position", listed.alias("neighbour_mzs"))


def concept_names(mask: Column) -> Column:
    return F.filter(F.array(*[F.when(has(mask, i), F.lit(c)) for i, c in enumerate(CONCEPTS)]), lambda x: x.isNotNull())


def csv_safe(text: Column) -> Column:
    return F.translate(text.cast("string"), ",\n\r", ";  ")


def example_rows(examples: DataFrame, with_activation: bool, with_concepts: bool) -> DataFrame:
    """feature_idx, table_text: one text table for each feature, a line for each example in order of its id."""
    head = ["example_id", *COLUMNS]
    cells = [
        F.col("example_id").cast("string"), F.format_string("%.4f", "peak_mz"), F.format_string("%.3f", "rel_intensity"), F.col("peak_rank").cast("string"), F.col("n_peaks").cast("string"),
        csv_safe(F.when(F.col("is_latent"), "LATENT_SUMMARY_TOKEN").otherwise(F.col("ion_type"))), csv_safe(F.col("peptide")), F.format_string("%.4f", "precursor_mz"), F.col("precursor_charge").cast("string"),
        F.array_join(F.transform("neighbour_mzs", lambda m: F.format_string("%.2f", m)), " "),
    ]
    if with_concepts:
        head, cells = [*head, "concepts"], [*cells, csv_safe(F.array_join("concepts", " "))]
    if with_activation:
        head, cells = [head[0], "activation", *head[1:]], [cells[0], F.format_string("%.3f", "activation"), *cells[1:]]
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example_id", F.concat_ws(",", *cells).alias("line")))), lambda x: x["line"]), "\n")
    return examples.groupBy("feature_idx").agg(F.concat(F.lit(",".join(head) + "\n"), lines).alias("table_text"))


# The columns of the table, in order; ours: how each is made.
COLUMNS = {
    "peak_mz": "m/z, 4 decimals",
    "rel_intensity": "intensity over the largest one of the spectrum",
    "intensity_rank": "place among the spectrum's peaks sorted by falling intensity, from 1",
    "n_peaks": "number of peaks that the spectrum keeps",
    "matched_ion": "series of the best fragment within the tolerance, or noise if none fits; LATENT_SUMMARY_TOKEN in a row that stands for its whole spectrum",
    "peptide_proforma": "annotated sequence; a bracket holds the mass added to the residue before it",
    "precursor_mz": "m/z of the unbroken peptide",
    "precursor_z": "its charge",
    "nearby_mz": "m/z of the nearest other peaks, ascending, 2 decimals",
}
_LINE = "{} = {}\n".format
LEGEND = "Each line of the table is a peak of the fragment spectrum of a peptide. Its values:\n" + "".join(_LINE(*c) for c in COLUMNS.items())
CONCEPTS_LEGEND = _LINE("concepts", "labels that hold for the row")
ACTIVATION_LEGEND = _LINE("activation", "the feature's response over its largest one; 0: none")
DESCRIBE_END = """
Find what tells the activations apart: the region of m/z, intensity and charge, a series or a loss, a residue or a
modification, a distance between peaks (with its mass), the peak itself or its surroundings. Others will predict the
activation of tokens they have not seen from your words and the other columns. If there is no pattern, say so. Answer as

DESCRIPTION: a paragraph
SUMMARY: one sentence
"""
PREDICT = "\nA feature is described below. Predict its activation, from 0 to 1, on each token of the table; many are 0.\n\n"
PREDICT_END = "\nAnswer with lines of example_id,activation under that header and nothing else.\n"


def description_prompt(table: Column, with_concepts: bool = False) -> Column:
    """The legend of the columns, the task and the table."""
    return F.concat(F.lit(LEGEND + (CONCEPTS_LEGEND if with_concepts else "") + ACTIVATION_LEGEND + DESCRIBE_END + "\n"), table)


def prediction_prompt(description: Column, table: Column, with_concepts: bool = False) -> Column:
    return F.concat(F.lit(LEGEND + (CONCEPTS_LEGEND if with_concepts else "") + PREDICT), description, F.lit("\n" + PREDICT_END + "\n"), table)


def half(examples: DataFrame, keys: Sequence[str], seed: int = 0, draw: Draw = unit_hash) -> DataFrame:
    """Adds ``describe``: true for the half of each feature's examples with the lower hashes."""
    own = W.partitionBy("feature_idx")
    place = F.row_number().over(own.orderBy(draw("feature_idx", *keys, seed + 2), *keys))
    return examples.withColumn("describe", place <= F.floor(F.count("*").over(own) / 2))


def parse_description(reply: Column) -> tuple[Column, Column]:
    """Description and first line of the summary; a reply without the marks is the description."""
    text = F.regexp_extract(reply, r"(?s)DESCRIPTION:\s*(.*?)\s*SUMMARY:", 1)
    marked = reply.rlike(r"(?s)DESCRIPTION:\s*(.*?)\s*SUMMARY:")
    summary = F.split(F.btrim(F.regexp_extract(reply, r"(?s)SUMMARY:\s*(.*)", 1), F.lit(" \n\r\t")), "\n")[0]
    return F.when(marked, F.btrim(text, F.lit(" \n\r\t"))).otherwise(F.btrim(reply, F.lit(" \n\r\t"))), summary


def parse_predictions(replies: DataFrame, valid: DataFrame) -> DataFrame:
    """feature_idx, example_id, predicted: lines of id,value among known ids, clamped to 0..1; the last line of an id counts."""
    lines = replies.select("feature_idx", F.posexplode(F.split("reply", r"\r\n|\n|\r")).alias("line_no", "line"))
    parts = lines.withColumn("parts", F.split("line", ",")).where(F.size("parts") >= 2)
    typed = parts.select("feature_idx", "line_no", F.trim(F.col("parts")[0]).try_cast("int").alias("example_id"), F.trim(F.col("parts")[1]).try_cast("double").alias("value")).where("example_id IS NOT NULL AND value IS NOT NULL")
    known = typed.join(valid.select("feature_idx", "example_id"), ["feature_idx", "example_id"], "left_semi")
    clamped = F.least(F.greatest(F.col("value"), d(0)), d(1))
    return known.groupBy("feature_idx", "example_id").agg(F.max_by(clamped, "line_no").alias("predicted"))


def description_scores(predictions: DataFrame, examples: DataFrame) -> DataFrame:
    """feature_idx, n, r between predicted and measured activations."""
    return pearson(predictions.join(examples.select("feature_idx", "example_id", "activation"), ["feature_idx", "example_id"]), ["feature_idx"], "predicted", "activation")


def results(scores: DataFrame, strata: DataFrame, stats: DataFrame, causal: DataFrame, summaries: DataFrame) -> DataFrame:
    """The 13 columns of the descriptions file; what a feature lacks stays null."""
    best = causal.select("feature_idx", F.col("concept").alias("causal_concept"), F.col("selectivity").alias("causal_selectivity"), F.col("selectivity_z").alias("causal_selectivity_z"), F.col("mean_delta_ce").alias("causal_mean_delta_ce"))
    out = strata.join(scores.select("feature_idx", F.col("r").alias("pearson_r"), F.col("n").alias("n_predicted")), "feature_idx", "left").join(stats, "feature_idx", "left").join(best, "feature_idx", "left").join(summaries, "feature_idx", "left")
    return out.select("feature_idx", "stratum", "pearson_r", "n_predicted", "firing_rate", "max_f1_dom", "best_concept", "n_significant_concepts", "causal_concept", "causal_selectivity", "causal_selectivity_z", "causal_mean_delta_ce", "summary")


def median_by_stratum(rows: DataFrame) -> DataFrame:
    return rows.where("pearson_r IS NOT NULL AND NOT isnan(pearson_r)").groupBy("stratum").agg(F.median("pearson_r").alias("median_r"), F.count("*").alias("n"))
