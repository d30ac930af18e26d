"""Feature-concept associations: contingency counts, metrics, rankings and the tables made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import d
from ..plans.registry import has
from ..sources.bucketed import co_located
from ..staging import staged
from .statistics import bh_reject, contingency_metrics


def top_tokens(features: DataFrame, k: int = 20, keys: Sequence[str] = ("chunk_idx", "token_in_chunk")) -> DataFrame:
    """The ``k`` strongest tokens of each feature, rank from 0; ties go to the earlier token.

    Only stored activations rank: a feature that fires on fewer than ``k`` tokens has fewer rows.
    """
    order = W.partitionBy("feature_idx").orderBy(F.col("activation").desc(), *keys)
    return features.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("feature_idx", "rank", "activation", *keys)


def contingency(features: DataFrame, labels: DataFrame, n_features: int, n_concepts: int, keys: Sequence[str], mask: str = "concepts") -> DataFrame:
    """feature_idx, concept_idx, n11, mf, mc, n for all pairs of a feature and a concept, ``n_features`` times ``n_concepts``.

    Features that never fire have counts of 0: they are part of the family that false discoveries are controlled in.
    Tokens meet once in an equi-join; the concepts stay bits of one number, and each task sums a counter for each, so
    no row is made for a pair of a token's feature and concept. A row without token for every feature goes into the
    same sums. A feature that the dictionary lacks is left out.
    """
    fired = features.where((F.col("activation") > 0) & F.col("feature_idx").between(0, n_features - 1)).select(*keys, "feature_idx")
    every = features.sparkSession.range(n_features).select(F.col("id").cast(features.schema["feature_idx"].dataType).alias("feature_idx"), F.lit(0).cast("long").alias(mask), F.lit(0).alias("_hit"))
    joined = co_located(fired, labels.select(*keys, mask), keys).select("feature_idx", mask, F.lit(1).alias("_hit")).unionByName(every)
    bits = [F.sum(F.when(has(F.col(mask), i), 1).otherwise(0)).alias(f"c{i}") for i in range(n_concepts)]
    counted = joined.groupBy("feature_idx").agg(F.sum("_hit").alias("mf"), *bits)
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("concept_idx"), F.col(f"c{i}").alias("n11")) for i in range(n_concepts)]))
    pairs = counted.select("feature_idx", "mf", pair.alias("x")).select("feature_idx", "x.concept_idx", "x.n11", "mf")
    totals = labels.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.when(has(F.col(mask), i), 1).otherwise(0)), F.lit(0)).alias(f"c{i}") for i in range(n_concepts)])
    marginals = totals.select("n", F.explode(F.array(*[F.struct(F.lit(i).alias("concept_idx"), F.col(f"c{i}").alias("mc")) for i in range(n_concepts)])).alias("x")).select("x.concept_idx", "x.mc", "n")
    return pairs.join(F.broadcast(marginals), "concept_idx").select("feature_idx", "concept_idx", "n11", "mf", "mc", "n")


def associations(features: DataFrame, labels: DataFrame, n_features: int, n_concepts: int, keys: Sequence[str], q: float = 0.05) -> DataFrame:
    """Contingency counts with metrics, p-values and the rejection flag, over the whole dictionary.

    The pairs, one for each feature and concept, are written before they are ranked, as ranks and rows both
    need them and the tokens should meet only once.
    """
    return bh_reject(staged(contingency_metrics(contingency(features, labels, n_features, n_concepts, keys)), "pairs"), q)


def per_concept_top(pairs: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` rejected features of each concept with the highest f1_dom * ln(1 + lift)."""
    scored = pairs.where("rejected").withColumn("score", F.col("f1_dom") * F.log1p("lift"))
    order = W.partitionBy("concept_idx").orderBy(F.col("score").desc(), "feature_idx")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("concept_idx", "rank", "feature_idx", "f1_dom", "lift", F.col("n11").alias("n_co"), "score", "p_value")


def per_family_top(pairs: DataFrame, concepts: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` features of each family by their best f1_dom over all its concepts; any rejected one makes them eligible."""
    rows = pairs.join(F.broadcast(concepts.select("concept_idx", "concept", "family")), "concept_idx")
    best = F.max_by(F.struct("concept_idx", "concept"), F.struct("f1_dom", -F.col("concept_idx")))
    grouped = rows.groupBy("family", "feature_idx").agg(F.max("f1_dom").alias("f1_dom"), best.alias("best"), F.bool_or("rejected").alias("any"))
    order = W.partitionBy("family").orderBy(F.col("f1_dom").desc(), "feature_idx")
    top = grouped.where("any").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("family", "rank", "feature_idx", F.col("best.concept_idx").alias("best_concept_idx"), F.col("best.concept").alias("best_concept_name"), "f1_dom")


def per_feature_stats(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """feature_idx, firing_rate, max_f1_dom, best_concept (even if not significant), n_significant_concepts."""
    rows = pairs.join(F.broadcast(concepts.select("concept_idx", "concept")), "concept_idx")
    best = F.max_by("concept", F.struct("f1_dom", -F.col("concept_idx")))
    return rows.groupBy("feature_idx").agg(
        (F.first("mf") / F.greatest(F.first("n"), F.lit(1))).alias("firing_rate"), F.max("f1_dom").alias("max_f1_dom"), best.alias("best_concept"), F.sum(F.col("rejected").cast("long")).alias("n_significant_concepts")
    )


def significant_totals(pairs: DataFrame) -> DataFrame:
    """Rejected pairs, and features with at least one."""
    return pairs.where("rejected").agg(F.count("*").alias("n_significant_pairs"), F.countDistinct("feature_idx").alias("n_features_with_concept"))


def association_rows(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Rejected pairs under the names of the report file."""
    rows = pairs.where("rejected").join(F.broadcast(concepts.select("concept_idx", "concept")), "concept_idx")
    return rows.select("feature_idx", "concept", "f1", "f1_dom", "lift", F.col("n11").alias("n_co"), "chi2", "p_value", F.col("rejected").alias("p_value_bh_significant"))


def anchors(pairs: DataFrame, most: int = 100) -> DataFrame:
    """Up to ``most`` features with the highest positive f1_dom among rejected pairs."""
    best = pairs.where("rejected").groupBy("feature_idx").agg(F.max("f1_dom").alias("f1_dom"))
    return best.where(F.col("f1_dom") > 0).orderBy(F.col("f1_dom").desc(), "feature_idx").limit(most)


def feature_targets(pairs: DataFrame, concept_idx: int, n: int) -> DataFrame:
    """The ``n`` rejected features of a concept with the highest f1_dom."""
    return pairs.where((F.col("concept_idx") == concept_idx) & F.col("rejected")).orderBy(F.col("f1_dom").desc(), "feature_idx").limit(n).select("feature_idx", "f1_dom")


def restored(significant: DataFrame, features: DataFrame, concepts: DataFrame) -> DataFrame:
    """All pairs of ``features`` (with what else it holds) from a report of the significant ones: others get p 1, metrics 0, not rejected.

    Names in the report that the tables do not know are an error, as is a feature without marginal.
    """
    odd = significant.join(F.broadcast(concepts.select("concept")), "concept", "left_anti").limit(1).count() + significant.join(features.select("feature_idx"), "feature_idx", "left_anti").limit(1).count()
    if odd:
        raise ValueError("the association table names features or concepts that are not there")
    grid = features.join(F.broadcast(concepts.select("concept_idx", "concept")))
    out = grid.join(significant, ["feature_idx", "concept"], "left")
    filled = {c: F.coalesce(c, d(0)) for c in ("f1", "f1_dom", "lift", "chi2")}
    return out.withColumns({**filled, "p_value": F.coalesce("p_value", d(1)), "n_co": F.coalesce("n_co", F.lit(0)), "rejected": F.coalesce("p_value_bh_significant", F.lit(False))}).drop("p_value_bh_significant")
