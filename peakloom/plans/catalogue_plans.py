"""Queries of plans, samples, causal reports and interpretation, with their SQL; samples are drawn by a number that both engines compute."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import associations as A
from ..operators import causal as C
from ..operators import interpretation as I
from ..operators import statistics as S
from ..operators import training as R
from ..operators.crosscheck import mean_jaccard as mean_overlap
from ..session import table
from ..staging import staged
from . import catalogue as base
from . import fixtures as fx
from .fixtures import KEY, N, PAIRS, lcg, lcg_sql, sql
from .registered import query, r6
from .stages import FORMATS, summary_table

# targets and plans -------------------------------------------------------------------------------------------------
_EDGES = "[" + ", ".join(f"quantile_cont(x, {i / 5})" for i in range(6)) + "]"
_PLAN = sql(*PAIRS) + f""", rates AS (SELECT feature_idx, log10(greatest(max(mf) / max(n), 1e-12)) AS x FROM pairs GROUP BY 1), rej AS (SELECT concept_idx, feature_idx, f1_dom, lift, x FROM pairs JOIN rates USING (feature_idx) WHERE rejected),
 e AS (SELECT concept_idx, {_EDGES} AS e FROM rej GROUP BY 1), b AS (SELECT rej.concept_idx, feature_idx, f1_dom, bin FROM rej JOIN e ON e.concept_idx = rej.concept_idx CROSS JOIN range(5) r(bin) WHERE x >= e[bin + 1] AND x < e[bin + 2] + 1e-9),
 k AS (SELECT *, row_number() OVER (PARTITION BY concept_idx, bin ORDER BY -ln({lcg_sql("feature_idx", "bin", 0)}) / greatest(f1_dom, 1e-6), feature_idx) AS place FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY concept_idx ORDER BY bin, place) AS i FROM k WHERE place <= 2),
 grp AS (SELECT DISTINCT concept_idx, feature_idx FROM o WHERE i <= 10),
 cand AS (SELECT g.concept_idx, CAST(rep AS INTEGER) AS replicate, p.feature_idx, row_number() OVER (PARTITION BY g.concept_idx, rep, g.feature_idx ORDER BY {lcg_sql("p.feature_idx", "g.feature_idx", "rep", 0)}, p.feature_idx) AS r
  FROM grp g JOIN rates t ON t.feature_idx = g.feature_idx JOIN rates p ON abs(p.x - t.x) < 0.3 LEFT JOIN grp h ON h.concept_idx = g.concept_idx AND h.feature_idx = p.feature_idx CROSS JOIN range(5) q(rep) WHERE h.feature_idx IS NULL),
 ctl AS (SELECT DISTINCT concept_idx, replicate, feature_idx FROM cand WHERE r = 1), one AS (SELECT concept_idx, CAST(row_number() OVER (PARTITION BY concept_idx ORDER BY f1_dom DESC, feature_idx) AS INTEGER) AS replicate, feature_idx FROM rej),
 sets AS (SELECT concept_idx, 'group' AS kind, CAST(0 AS INTEGER) AS replicate, string_agg(CAST(feature_idx AS VARCHAR), ' ' ORDER BY feature_idx) AS features FROM grp GROUP BY 1
  UNION ALL SELECT concept_idx, 'control', replicate, string_agg(CAST(feature_idx AS VARCHAR), ' ' ORDER BY feature_idx) FROM ctl GROUP BY 1, 3 UNION ALL SELECT concept_idx, 'single', replicate, CAST(feature_idx AS VARCHAR) FROM one WHERE replicate <= 4)"""


def _planned(spark: SparkSession, d: str) -> DataFrame:
    pairs = staged(base._pairs(spark, d), "pairs")
    rates = pairs.groupBy("feature_idx").agg((F.max("mf") / F.max("n")).alias("firing_rate"))
    return C.numbered_sets(C.ablation_plan(pairs, rates, 10, 4, draw=lcg))


@query(_PLAN + " SELECT concept_idx, kind, replicate, features FROM sets")
def ablation_plan(spark: SparkSession, d: str) -> DataFrame:
    """Groups, matched controls and single features of every concept."""
    return _planned(spark, d).select("concept_idx", "kind", F.col("replicate").cast("int").alias("replicate"), F.array_join(F.transform("features", lambda f: f.cast("string")), " ").alias("features"))


@query(_PLAN + " SELECT count(DISTINCT features) AS n_sets, count(*) AS n_planned FROM sets")
def ablation_sets(spark: SparkSession, d: str) -> DataFrame:
    """Equal sets are run once."""
    return _planned(spark, d).agg((F.max("set_idx") + 1).cast("long").alias("n_sets"), F.count("*").alias("n_planned"))


@query(sql(*PAIRS) + "SELECT feature_idx, round(f1_dom, 6) AS f1_dom FROM pairs WHERE rejected AND concept_idx = 3 ORDER BY pairs.f1_dom DESC, feature_idx LIMIT 5")
def single_targets(spark: SparkSession, d: str) -> DataFrame:
    return A.feature_targets(base._pairs(spark, d), 3, 5).select("feature_idx", r6("f1_dom"))


# losses and causal reports -----------------------------------------------------------------------------------------
@query("SELECT l_orderkey AS global_spectrum, round(avg(l_tax), 6) AS mean_ce, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS valid FROM lineitem GROUP BY 1")
def spectrum_losses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("global_spectrum"), F.col("l_tax").alias("ce"), (F.col("l_returnflag") == "R").alias("hit"))
    return C.spectrum_ce(rows).select("global_spectrum", r6("mean_ce"), "correct", "valid")


@query("SELECT l_orderkey AS global_spectrum, round(avg(l_tax), 6) AS mean_ce FROM lineitem GROUP BY 1")
def cached_losses(spark: SparkSession, d: str) -> DataFrame:
    """Stored losses where every chunk has them."""
    chunk = F.floor(F.col("l_orderkey") / 100).alias("chunk_idx")
    rows = table(spark, d, "lineitem").select(chunk, F.col("l_orderkey").alias("global_spectrum"), F.col("l_tax").alias("ce"), (F.col("l_returnflag") == "R").alias("hit"))
    found = C.cached_clean_ce(rows.select("chunk_idx").distinct(), rows)
    assert found is not None and C.cached_clean_ce(rows.select("chunk_idx").distinct(), rows.where("chunk_idx > 1")) is None
    return found.select("global_spectrum", r6("mean_ce"))


#: Planned sets of made-up ablations: a group, five controls and three single features of each of three concepts.
_KINDS = [(c, kind, rep) for c in (3, 4, 8) for kind, reps in (("group", [0]), ("control", range(5)), ("single", [1, 2, 3])) for rep in reps]
_SETS = [(c, kind, rep, i % 23) for i, (c, kind, rep) in enumerate(_KINDS)]
_VALUES = ", ".join(f"({c}, '{k}', {r}, {s})" for c, k, r, s in _SETS)


def _moved(spark: SparkSession, d: str) -> DataFrame:
    ce = fx.fx_ce(spark, d).select("global_spectrum", "ce_sae").repartition("global_spectrum")  # runs are made where they meet
    plan = spark.createDataFrame(_SETS, "concept_idx int, kind string, replicate int, set_idx int")
    sets = plan.select("set_idx").distinct()
    change = ((F.col("global_spectrum") * (F.col("set_idx") + 3)) % 101 - 20) / 100.0
    ablated = ce.crossJoin(F.broadcast(sets)).select(F.lit("ablate").alias("mode"), "set_idx", "global_spectrum", (F.col("ce_sae") + change).alias("mean_ce"))
    runs = ce.select(F.lit("sae").alias("mode"), F.lit(0).alias("set_idx"), "global_spectrum", F.col("ce_sae").alias("mean_ce")).unionByName(ablated)
    labels = fx.fx_labels(spark, d).withColumnRenamed("spectrum_idx", "global_spectrum")
    return C.ablation_rows(plan, runs, staged(C.prevalence_lists(C.prevalence(labels, N), N), "prevalence"))


_MOVED = (
    base._PHI
    + f""", ce0 AS (SELECT o_orderkey AS g, CAST(0.05 AS DOUBLE) * (o_orderkey % 7) + 1 + (o_custkey % 97) / CAST(97 AS DOUBLE) AS sae FROM orders), plan(c, kind, rep, s) AS (VALUES {_VALUES}),
 prev AS (SELECT spectrum_idx AS g, concept_idx AS c, avg(v) AS p FROM long_labels GROUP BY 1, 2), mv AS (SELECT plan.c, kind, rep, ce0.g, (sae + ((ce0.g * (s + 3)) % 101 - 20) / CAST(100 AS DOUBLE)) - sae AS delta, p FROM plan CROSS JOIN ce0 JOIN prev ON prev.g = ce0.g AND prev.c = plan.c),
 cuts AS (SELECT c, quantile_cont(p, 1.0/3.0) AS lo, quantile_cont(p, 2.0/3.0) AS hi, count(*) AS n FROM mv WHERE kind = 'group' GROUP BY 1),
 sel AS (SELECT mv.c, kind, rep, any_value(n) AS n, avg(delta) AS mean, CASE WHEN any_value(n) >= 6 AND any_value(lo) <> any_value(hi) THEN avg(CASE WHEN p >= hi THEN delta END) - avg(CASE WHEN p <= lo THEN delta END) END AS sel FROM mv JOIN cuts ON cuts.c = mv.c GROUP BY 1, 2, 3)"""
)


@query(
    _MOVED
    + """, bad AS (SELECT DISTINCT prev.g, phi.ci AS c FROM prev JOIN phi ON phi.cj = prev.c WHERE ci <> cj AND abs(phi) > 0.3 AND p > 0), alone AS (SELECT mv.* FROM mv LEFT JOIN bad ON bad.g = mv.g AND bad.c = mv.c WHERE kind = 'group' AND bad.g IS NULL),
 oc AS (SELECT c, quantile_cont(p, 1.0/3.0) AS lo, quantile_cont(p, 2.0/3.0) AS hi, count(*) AS n FROM alone GROUP BY 1), orth AS (SELECT alone.c, any_value(n) AS n, CASE WHEN any_value(n) >= 6 AND any_value(lo) <> any_value(hi) THEN avg(CASE WHEN p >= hi THEN delta END) - avg(CASE WHEN p <= lo THEN delta END) END AS sel FROM alone JOIN oc ON oc.c = alone.c GROUP BY 1),
 ctl AS (SELECT c, avg(sel) AS ms, stddev_samp(sel) AS ss, count(sel) AS ns, avg(mean) AS mm, stddev_samp(mean) AS sm FROM sel WHERE kind = 'control' GROUP BY 1), cor AS (SELECT ci AS c, count(*) AS k FROM phi WHERE ci <> cj AND abs(phi) > 0.3 GROUP BY 1)
 SELECT CAST(sel.c AS INTEGER) AS concept_idx, round(mean, 6) AS mean_delta_ce, round(sel.sel, 6) AS selectivity, round(orth.sel, 6) AS orthogonalised_selectivity, round(ms, 6) AS control_mean_selectivity, round((mean - mm) / sm, 4) AS magnitude_z, round((sel.sel - ms) / ss, 4) AS selectivity_z, sel.n AS n_spectra, coalesce(orth.n, 0) AS n_orthogonal_spectra, coalesce(k, 0) AS n_correlated_controlled
 FROM sel LEFT JOIN orth ON orth.c = sel.c LEFT JOIN ctl ON ctl.c = sel.c LEFT JOIN cor ON cor.c = sel.c WHERE kind = 'group'"""
)
def causal_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every figure of the causal report, of three concepts at once."""
    groups, _ = C.causal_reports(_moved(spark, d), C.correlated_masks(S.phi_matrix(fx.fx_labels(spark, d), N)))
    names = ("mean_delta_ce", "selectivity", "orthogonalised_selectivity", "control_mean_selectivity")
    return groups.select("concept_idx", *[r6(c) for c in names], F.round("magnitude_z", 4).alias("magnitude_z"), F.round("selectivity_z", 4).alias("selectivity_z"), "n_spectra", "n_orthogonal_spectra", F.col("n_correlated_controlled"))


@query(_MOVED + " SELECT CAST(c AS INTEGER) AS concept_idx, CAST(rep AS INTEGER) AS replicate, round(mean, 6) AS mean_delta_ce, round(sel, 6) AS selectivity FROM sel WHERE kind = 'single'")
def causal_singles(spark: SparkSession, d: str) -> DataFrame:
    _, singles = C.causal_reports(_moved(spark, d), C.correlated_masks(S.phi_matrix(fx.fx_labels(spark, d), N)))
    return singles.select("concept_idx", "replicate", r6("mean_delta_ce"), r6("selectivity"))


@query("SELECT round(avg(CASE WHEN o_orderkey % 9 <> 7 AND o_orderstatus <> 'P' THEN o_totalprice END), 4) AS mean_selectivity_z FROM orders")
def mean_selectivity_z(spark: SparkSession, d: str) -> DataFrame:
    """Over concepts that are not diagnostic, without the undefined ones."""
    z = F.when(F.col("o_orderstatus") == "P", float("nan")).otherwise(F.col("o_totalprice"))
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 9).cast("int").alias("concept_idx"), z.alias("selectivity_z"))
    return C.mean_selectivity_z(rows, fx.fx_concepts(spark)).select(F.round("mean_selectivity_z", 4).alias("mean_selectivity_z"))


@query(sql(*PAIRS) + """SELECT concept_idx AS layer, printf('%.4f', avg(f1_dom) * 1.01) AS fve, printf('%.1f', avg(lift) * 1.001) AS l0, format('{:,}', CAST(sum(n11) AS BIGINT)) AS n_sig_pairs, CASE WHEN concept_idx = 2 THEN '-' ELSE printf('%.3f', avg(recall) * 1.0001) END AS mean_selectivity_z FROM pairs GROUP BY 1""")
def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    """Printed figures of layers, with a dash where there is none."""
    p = base._pairs(spark, d).groupBy(F.col("concept_idx").alias("layer")).agg((F.avg("f1_dom") * 1.01).alias("fve"), (F.avg("lift") * 1.001).alias("l0"), F.sum("n11").cast("long").alias("n_sig_pairs"), (F.avg("recall") * 1.0001).alias("mean_selectivity_z"))
    assert set(p.columns) - {"layer"} <= set(FORMATS)
    return summary_table(p.withColumn("mean_selectivity_z", F.when(F.col("layer") == 2, float("nan")).otherwise(F.col("mean_selectivity_z"))))


@query(
    """WITH t AS (SELECT o_orderpriority AS concept, CAST(o_orderkey % 4 AS INTEGER) AS seed, CAST(o_custkey % 40 AS INTEGER) AS feature_idx, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY concept, seed ORDER BY n DESC, feature_idx) AS rank FROM t), k AS (SELECT * FROM r WHERE rank <= 10),
 j AS (SELECT a.concept, b.seed, count(*) / CAST(20 - count(*) AS DOUBLE) AS jaccard FROM k a JOIN k b ON a.concept = b.concept AND a.feature_idx = b.feature_idx WHERE a.seed = 0 AND b.seed > 0 GROUP BY 1, 2) SELECT concept, round(avg(jaccard), 6) AS mean_jaccard, count(*) AS n_seeds FROM j GROUP BY 1"""
)
def mean_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of top features with the other seeds that share any."""
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("concept"), (F.col("o_orderkey") % 4).cast("int").alias("seed"), (F.col("o_custkey") % 40).cast("int").alias("feature_idx")).agg(F.count("*").alias("n"))
    return mean_overlap(base.met_lists(t)).select("concept", r6("mean_jaccard"), F.size("per_seed").cast("long").alias("n_seeds"))


# training ----------------------------------------------------------------------------------------------------------
_BATCH = sql("dictionary") + ", h AS (SELECT CAST(floor(token_id / 128) AS INTEGER) AS batch, token_id, feature_idx, greatest(h, 0) AS h FROM pre), n AS (SELECT batch, count(DISTINCT token_id) AS n FROM h GROUP BY 1), r AS (SELECT h.batch, token_id, feature_idx, h, n, row_number() OVER (PARTITION BY h.batch ORDER BY h DESC) AS r FROM h JOIN n ON n.batch = h.batch), e AS (SELECT batch, min(h) AS edge FROM r WHERE r <= 2 * n GROUP BY 1)"


def _topk(spark: SparkSession, d: str) -> DataFrame:
    """token_id, feature_idx, activation, chosen (batch top-2), aux (each row's best two of the rest), edge."""
    model = fx.fx_dictionary(spark, d)[1]

    def run(group: pa.Table) -> pa.Table:
        x = np.array(group.column("activation").to_pylist(), float)
        h = np.maximum(model.preactivations(x), 0)
        mask, edge = R.batch_topk(h, 2)
        aux = R.aux_topk(h, mask, 2)
        row, feature = np.nonzero(mask | aux)
        columns = [group.column("token_id").combine_chunks().take(pa.array(row)), pa.array(feature, pa.int32()), pa.array(h[row, feature]), pa.array(mask[row, feature]), pa.array(aux[row, feature]), pa.array([edge] * len(row), pa.float64())]
        return pa.table(columns, names=["token_id", "feature_idx", "activation", "chosen", "aux", "edge"])

    rows = fx.fx_activations(spark, d).select("token_id", F.col("activation").cast("array<double>").alias("activation"), F.floor(F.col("token_id") / 128).alias("batch"))
    return rows.groupBy("batch").applyInArrow(run, "token_id long, feature_idx int, activation double, chosen boolean, aux boolean, edge double")


@query(_BATCH + " SELECT token_id, CAST(feature_idx AS INTEGER) AS feature_idx, round(h, 6) AS activation, round(edge, 6) AS edge FROM r JOIN e ON e.batch = r.batch WHERE h >= edge")
def batch_topk(spark: SparkSession, d: str) -> DataFrame:
    """The largest preactivations of a whole batch and their boundary."""
    return _topk(spark, d).where("chosen").select("token_id", "feature_idx", r6("activation"), r6("edge"))


@query(_BATCH + ", f AS (SELECT token_id, feature_idx, h, row_number() OVER (PARTITION BY token_id ORDER BY h DESC, feature_idx) AS p FROM r JOIN e ON e.batch = r.batch WHERE h < edge) SELECT token_id, CAST(feature_idx AS INTEGER) AS feature_idx, round(h, 6) AS activation FROM f WHERE p <= 2 AND h > 0")
def aux_topk(spark: SparkSession, d: str) -> DataFrame:
    """The largest of each token among the rest; zeros, which tie, are left out here."""
    return _topk(spark, d).where("aux AND activation > 0").select("token_id", "feature_idx", r6("activation"))


@query(f"WITH c AS (SELECT DISTINCT CAST(floor(o_orderkey / 16) AS INTEGER) AS chunk_idx FROM orders), n AS (SELECT greatest(1, CAST(round(count(*) * 0.1) AS INTEGER)) AS k FROM c), r AS (SELECT chunk_idx, row_number() OVER (ORDER BY {lcg_sql('chunk_idx', 0)}, chunk_idx) AS r FROM c) SELECT chunk_idx, r <= k AS val FROM r, n")
def train_split(spark: SparkSession, d: str) -> DataFrame:
    """Chunks for training and for validation."""
    chunks = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 16).cast("int").alias("chunk_idx")).distinct()
    return R.split_chunks(chunks, R.TrainConfig(val_fraction=0.1), lcg)


@query("WITH n AS (SELECT l_orderkey % 8 AS chunk_idx, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(ceil(sum(n) / CAST(100 AS DOUBLE)) AS BIGINT) AS steps_across, CAST(sum(ceil(n / CAST(100 AS DOUBLE))) AS BIGINT) AS steps_within FROM n")
def epoch_steps(spark: SparkSession, d: str) -> DataFrame:
    counts = [r["n"] for r in table(spark, d, "lineitem").groupBy(F.col("l_orderkey") % 8).agg(F.count("*").alias("n")).collect()]
    return spark.createDataFrame([(R.steps_per_epoch(counts, 100), R.steps_per_epoch(counts, 100, False))], "steps_across long, steps_within long")


# interpretation ----------------------------------------------------------------------------------------------------
_STRATA = sql(*PAIRS) + f""", {base._CONCEPTS}, st AS (SELECT feature_idx, max(f1_dom) AS f, max(mf) AS mf, count(CASE WHEN rejected AND feature_idx % 4 <> 3 THEN 1 END) AS k FROM pairs GROUP BY 1), ca AS (SELECT feature_idx, max(f1_dom) AS s FROM pairs WHERE feature_idx % 5 = 0 GROUP BY 1),
 a AS (SELECT feature_idx FROM ca ORDER BY s DESC, feature_idx LIMIT 3), b AS (SELECT feature_idx FROM st WHERE feature_idx NOT IN (SELECT feature_idx FROM a) AND k > 0 ORDER BY f DESC, feature_idx LIMIT 3),
 c AS (SELECT feature_idx FROM st WHERE feature_idx NOT IN (SELECT feature_idx FROM a) AND k = 0 AND mf > 0 ORDER BY {lcg_sql("feature_idx", 0)}, feature_idx LIMIT 3)"""


def _strata_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both from one pass over the tokens: the pairs are written before they are ranked."""
    found = base._pairs(spark, d)
    pairs = found.withColumn("rejected", F.col("rejected") & (F.col("feature_idx") % 4 != 3))
    causal = found.where("feature_idx % 5 = 0").groupBy("feature_idx").agg((-F.max("f1_dom")).alias("selectivity"))
    return A.per_feature_stats(pairs, fx.fx_concepts(spark)), causal


@query(_STRATA + " SELECT feature_idx, 'causal' AS stratum FROM a UNION ALL SELECT feature_idx, 'concept' FROM b UNION ALL SELECT feature_idx, 'unlabelled' FROM c")
def strata(spark: SparkSession, d: str) -> DataFrame:
    """Features to describe: causal, then concept, then unlabelled ones."""
    return I.select_strata(*_strata_inputs(spark, d), 3, draw=lcg)


_TOKEN = "spectrum_idx, position"
_EXAMPLES = sql("peaks", "features") + f""", acts AS (SELECT * FROM features WHERE activation > 0), top AS (SELECT feature_idx, max(activation) AS m FROM features GROUP BY 1), sc AS (SELECT a.feature_idx, greatest(max(a.activation), any_value(m)) AS peak, count(*) AS active FROM acts a JOIN top ON top.feature_idx = a.feature_idx GROUP BY 1),
 x AS (SELECT a.feature_idx, {_TOKEN}, activation / peak AS x FROM acts a JOIN sc ON sc.feature_idx = a.feature_idx WHERE active >= 12), bn AS (SELECT *, CAST(b AS INTEGER) AS bin FROM x, range(10) r(b) WHERE x > b / CAST(10 AS DOUBLE) AND x <= (b + 1) / CAST(10 AS DOUBLE)),
 pl AS (SELECT *, row_number() OVER (PARTITION BY feature_idx, bin ORDER BY {lcg_sql("feature_idx", "spectrum_idx", "position", 0)}, {_TOKEN}) AS r FROM bn), pos AS (SELECT feature_idx, {_TOKEN}, x FROM pl WHERE r <= CASE WHEN bin = 9 THEN 6 ELSE 2 END),
 pool AS (SELECT {_TOKEN}, {lcg_sql("spectrum_idx", "position", 0)} AS u FROM peaks), free AS (SELECT sc.feature_idx, pool.spectrum_idx, pool.position, row_number() OVER (PARTITION BY sc.feature_idx ORDER BY u, pool.spectrum_idx, pool.position) AS r FROM sc CROSS JOIN pool LEFT JOIN acts a ON a.feature_idx = sc.feature_idx AND a.spectrum_idx = pool.spectrum_idx AND a.position = pool.position WHERE a.feature_idx IS NULL AND active >= 12),
 ex AS (SELECT * FROM pos UNION ALL SELECT feature_idx, {_TOKEN}, CAST(0 AS DOUBLE) FROM free WHERE r <= 8), ids AS (SELECT *, CAST(row_number() OVER (PARTITION BY feature_idx ORDER BY {lcg_sql("feature_idx", "spectrum_idx", "position", 1)}, {_TOKEN}) - 1 AS INTEGER) AS example_id FROM ex)"""


def _examples(spark: SparkSession, d: str) -> DataFrame:
    f = fx.fx_features(spark, d)
    return I.sample_examples(f, I.feature_scale(f, A.top_tokens(f, 20, KEY)), fx.fx_peaks(spark, d).select(*KEY), KEY, draw=lcg)


@query(_EXAMPLES + f" SELECT feature_idx, {_TOKEN}, round(x, 6) AS activation, example_id FROM ids")
def example_sample(spark: SparkSession, d: str) -> DataFrame:
    """Examples of every feature by bins of activation, with zeros, in drawn order."""
    return _examples(spark, d).select("feature_idx", *KEY, r6("activation"), F.col("example_id").cast("int").alias("example_id"))


@query(_EXAMPLES + f", h AS (SELECT *, row_number() OVER (PARTITION BY feature_idx ORDER BY {lcg_sql('feature_idx', 'spectrum_idx', 'position', 2)}, {_TOKEN}) AS p, count(*) OVER (PARTITION BY feature_idx) AS n FROM ids) SELECT feature_idx, {_TOKEN}, p <= floor(n / 2) AS describe FROM h")
def example_halves(spark: SparkSession, d: str) -> DataFrame:
    """One half to describe from, the other one to predict."""
    return I.half(_examples(spark, d), KEY, draw=lcg).select("feature_idx", *KEY, "describe")


@query(sql("peaks", "features") + "SELECT feature_idx, round(max(activation) * CASE WHEN feature_idx % 2 = 0 THEN 2 ELSE 1 END, 6) AS peak FROM features GROUP BY 1")
def feature_scales(spark: SparkSession, d: str) -> DataFrame:
    """The larger of the examples' maximum and that of the stored top tokens, which is twice as large for even features and half as large for others."""
    f = fx.fx_features(spark, d)
    factor = F.when(F.col("feature_idx") % 2 == 0, 2.0).otherwise(0.5)
    stored = A.top_tokens(f.withColumn("activation", F.col("activation") * factor), 20, KEY)
    return I.feature_scale(f, stored).select("feature_idx", r6("peak"))


@query(sql("peaks", "features") + """, t AS (SELECT spectrum_idx % 16 AS chunk_idx, spectrum_idx * 100 + position AS token_in_chunk, feature_idx, activation FROM features), r AS (SELECT *, row_number() OVER (PARTITION BY feature_idx ORDER BY activation DESC, chunk_idx, token_in_chunk) AS r FROM t),
 ex AS (SELECT * FROM r WHERE r % 3 = 1 AND r <= 20), o AS (SELECT r.*, m.have, m.peak, row_number() OVER (PARTITION BY r.feature_idx ORDER BY r.activation DESC, chunk_idx DESC, token_in_chunk DESC) AS p FROM r JOIN (SELECT feature_idx, count(*) AS have, max(activation) AS peak FROM ex GROUP BY 1) m ON m.feature_idx = r.feature_idx WHERE r <= 20 AND r % 3 <> 1 AND chunk_idx < 8)
 SELECT feature_idx, token_in_chunk, round(activation / peak, 6) AS activation, CAST(have + p - 1 AS INTEGER) AS example_id FROM o WHERE p <= 4""")
def global_top_added(spark: SparkSession, d: str) -> DataFrame:
    """A feature's strongest tokens in the sampled chunks that are not examples yet."""
    keys = ["chunk_idx", "token_in_chunk"]
    f = fx.fx_features(spark, d).select((F.col("spectrum_idx") % 16).alias("chunk_idx"), (F.col("spectrum_idx") * 100 + F.col("position")).alias("token_in_chunk"), "feature_idx", "activation")
    top = A.top_tokens(f)
    seen = top.where("rank % 3 = 0").select("feature_idx", *keys, "activation", F.lit(0).alias("example_id"))
    scale = seen.groupBy("feature_idx").agg(F.max("activation").alias("peak"))
    rows = I.add_global_top(seen, top, scale, f.where("chunk_idx < 8").select("chunk_idx"), keys)
    return rows.join(seen.select("feature_idx", *keys), ["feature_idx", *keys], "left_anti").select("feature_idx", "token_in_chunk", r6("activation"), "example_id")


_HEAD = "example_id,activation,peak_mz,rel_intensity,intensity_rank,n_peaks,matched_ion,peptide_proforma,precursor_mz,precursor_z,nearby_mz,concepts"
_ROWS = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS e FROM lineitem),
 t AS (SELECT l_orderkey AS feature_idx, e, printf('%.3f', l_quantity / 50) AS a, printf('%.4f', l_extendedprice) AS mz, printf('%.3f', l_tax) AS rel, CASE WHEN l_linenumber = 1 THEN 'LATENT_SUMMARY_TOKEN' ELSE l_returnflag || ';' || l_linestatus END AS ion, printf('%.4f', l_discount) AS pmz, printf('%.2f', l_quantity) || ' ' || printf('%.2f', l_tax) AS near, l_linenumber, l_partkey, l_suppkey FROM l)"""
_LINE = "CAST(e AS VARCHAR) || ',' || a || ',' || mz || ',' || rel || ',' || CAST(l_linenumber AS VARCHAR) || ',' || CAST(l_partkey AS VARCHAR) || ',' || ion || ',PEP[+1; 2],' || pmz || ',' || CAST(l_suppkey AS VARCHAR) || ',' || near || ',is_b_ion mz_low'"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("feature_idx"), place.alias("example_id"), (F.col("l_quantity") / 50).alias("activation"), (F.col("l_linenumber") == 1).alias("is_latent"), F.col("l_extendedprice").alias("peak_mz"), F.col("l_tax").alias("rel_intensity"), F.col("l_linenumber").alias("peak_rank"), F.col("l_partkey").alias("n_peaks"),
        F.concat("l_returnflag", F.lit(","), "l_linestatus").alias("ion_type"), F.lit("PEP[+1, 2]").alias("peptide"), F.col("l_discount").alias("precursor_mz"), F.col("l_suppkey").alias("precursor_charge"), F.array("l_quantity", "l_tax").alias("neighbour_mzs"), F.array(F.lit("is_b_ion"), F.lit("mz_low")).alias("concepts"),
    )
    return I.example_rows(rows, True, True)


@query(_ROWS + f" SELECT feature_idx, '{_HEAD}' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY e) AS table_text FROM t GROUP BY 1")
def example_tables(spark: SparkSession, d: str) -> DataFrame:
    """Text tables of examples, a line for each, free of commas and line ends within a cell."""
    return _texts(spark, d).select("feature_idx", "table_text")


def _quoted(text: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


@query(_ROWS + f" SELECT feature_idx, {_quoted(I.LEGEND + I.CONCEPTS_LEGEND + I.ACTIVATION_LEGEND + I.DESCRIBE_END)} || chr(10) || '{_HEAD}' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY e) AS prompt FROM t GROUP BY 1")
def description_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Whole prompts: the legend of the columns, the task and the table."""
    return _texts(spark, d).select("feature_idx", I.description_prompt(F.col("table_text"), True).alias("prompt"))


@query("""WITH s AS (SELECT CAST(o_orderkey AS INTEGER) AS feature_idx, CASE WHEN o_orderkey % 2 = 0 THEN 'causal' ELSE 'concept' END AS stratum FROM orders), r AS (SELECT l_orderkey AS f, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(l_quantity) >= 1e-12 AND stddev_pop(l_tax) >= 1e-12 THEN corr(l_quantity, l_tax) END AS r FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey AS f, o_totalprice AS v FROM orders WHERE o_orderkey % 3 = 0)
 SELECT feature_idx, stratum, round(r, 6) AS pearson_r, n AS n_predicted, round(v, 4) AS causal_selectivity, CASE WHEN feature_idx % 5 = 0 THEN NULL ELSE 'fires on ' || CAST(feature_idx AS VARCHAR) END AS summary FROM s LEFT JOIN r ON r.f = feature_idx LEFT JOIN c ON c.f = feature_idx""")
def description_results(spark: SparkSession, d: str) -> DataFrame:
    """Scores, statistics, causal records and summaries joined to the chosen features; what a feature lacks stays null."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    f = F.col("o_orderkey").cast("int").alias("feature_idx")
    chosen = o.select(f, F.when(F.col("o_orderkey") % 2 == 0, "causal").otherwise("concept").alias("stratum"))
    numbered = line.select(F.col("l_orderkey").cast("int").alias("feature_idx"), F.monotonically_increasing_id().alias("example_id"), "l_quantity", "l_tax")
    predicted = numbered.select("feature_idx", "example_id", F.col("l_quantity").alias("predicted"))
    scores = I.description_scores(predicted, numbered.select("feature_idx", "example_id", F.col("l_tax").alias("activation")))
    none = F.lit(None).cast("double")
    stats = o.select(f, none.alias("firing_rate"), none.alias("max_f1_dom"), F.lit("c").alias("best_concept"), F.lit(1).alias("n_significant_concepts"))
    causal = o.where("o_orderkey % 3 = 0").select(f, F.lit("c").alias("concept"), F.col("o_totalprice").alias("selectivity"), none.alias("selectivity_z"), none.alias("mean_delta_ce"))
    summaries = o.where("o_orderkey % 5 != 0").select(f, F.concat(F.lit("fires on "), F.col("o_orderkey").cast("string")).alias("summary"))
    return I.results(scores, chosen, stats, causal, summaries).select("feature_idx", "stratum", r6("pearson_r"), "n_predicted", F.round("causal_selectivity", 4).alias("causal_selectivity"), "summary")
