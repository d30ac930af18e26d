"""Tables, manifests, reports and checkpoints of the stages: writers, readers and the checks between them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import Dictionary, from_table
from ..staging import delete_path, path_exists

VERSION = 1
# Columns of the report files.
CSV_COLUMNS = {
    "top_activating_tokens": ("feature_idx", "rank", "activation", "chunk_idx", "token_in_chunk"),
    "feature_label_associations": ("feature_idx", "concept", "f1", "f1_dom", "lift", "n_co", "chi2", "p_value", "p_value_bh_significant"),
    "per_feature_stats": ("feature_idx", "firing_rate", "max_f1_dom", "best_concept", "n_significant_concepts"),
    "causal_ablation": ("concept", "family", "diagnostic", "n_eligible", "mean_delta_ce", "selectivity", "selectivity_z", "orthogonalised_selectivity", "control_mean_selectivity", "magnitude_z", "n_correlated_controlled"),
    "feature_descriptions": ("feature_idx", "stratum", "pearson_r", "n_predicted", "firing_rate", "max_f1_dom", "best_concept", "n_significant_concepts", "causal_concept", "causal_selectivity", "causal_selectivity_z", "causal_mean_delta_ce", "summary"),
}
CSV_TYPES = {
    "feature_idx": "int", "rank": "int", "chunk_idx": "int", "token_in_chunk": "bigint", "n_co": "bigint", "n_significant_concepts": "bigint", "n_predicted": "bigint", "n_eligible": "bigint", "n_correlated_controlled": "bigint",
    "concept": "string", "best_concept": "string", "family": "string", "stratum": "string", "causal_concept": "string", "summary": "string", "diagnostic": "boolean", "p_value_bh_significant": "boolean",
}


class Artefacts:
    """The folder of one run. Tables are Parquet; a table is complete if its ``_SUCCESS`` is there, a table of chunks as far as its manifest says."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def sub(self, name: str) -> Artefacts:
        """A folder of its own below this one."""
        return Artefacts(self.spark, self.path(name))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def done(self, name: str) -> bool:
        return any(path_exists(self.spark, f"{self.path(name)}{kind}/_SUCCESS") for kind in ("", ".manifest"))

    def write(self, df: DataFrame, name: str, partition: Sequence[str] = (), mode: str = "overwrite") -> None:
        df.withColumn("schema_version", F.lit(VERSION)).write.mode(mode).partitionBy(*partition).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        """A table without its version; another version is an error. Of a table of chunks only what is committed."""
        rows = self.spark.read.parquet(self.path(name))
        odd = rows.where(F.col("schema_version") != VERSION).limit(1).count() if "schema_version" in rows.columns else 1
        if odd:
            raise ValueError(f"{name} has another schema version than {VERSION}")
        if "write_id" in rows.columns:
            done = self.committed(name)
            keys = [c for c in done.columns if c not in ("n_rows", "n_files")]
            rows = rows.join(F.broadcast(done.select(*keys)), keys, "left_semi").select(*[c for c in rows.columns if c != "write_id"])
        return rows.drop("schema_version")

    def write_chunks(self, df: DataFrame, name: str, layer: bool = False) -> None:
        """Chunk metadata, labels or activations: a folder for each (layer and) chunk, then a row of the manifest for each.

        A chunk counts from its row on, which names the write that its files come from. What a write that was cut short
        has left is not read, and the next write of the chunk takes its place.
        """
        keys, write = [*(["layer"] if layer else []), "chunk_idx"], uuid.uuid4().hex
        rows = df.withColumns({"schema_version": F.lit(VERSION), "write_id": F.lit(write)})
        rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(self.path(name))
        self.commit(name, keys, write)

    def commit(self, name: str, keys: Sequence[str], write: str) -> None:
        """Rows (keys, write_id, n_rows, n_files) for the chunks of one write, counted in the files themselves."""
        files = F.countDistinct(F.col("_metadata.file_path")).alias("n_files")
        own = self.spark.read.parquet(self.path(name)).where(F.col("write_id") == write).groupBy(*keys, "write_id").agg(F.count("*").alias("n_rows"), files)
        own.coalesce(1).write.mode("append").parquet(self.path(f"{name}.manifest"))

    def committed(self, name: str) -> DataFrame:
        """The manifest of a table of chunks."""
        path = self.path(f"{name}.manifest")
        if path_exists(self.spark, f"{path}/_SUCCESS"):
            return self.spark.read.parquet(path)
        return self.spark.createDataFrame([], "chunk_idx int, write_id string, n_rows long, n_files long")

    def missing_chunks(self, df: DataFrame, name: str, layers: Sequence[int] | None = None) -> DataFrame:
        """Rows of the chunks that a table does not hold yet (for one of ``layers`` at least)."""
        done = self.committed(name)
        if layers is None:
            whole = done.select("chunk_idx").distinct()
        elif "layer" not in done.columns:
            return df
        else:
            whole = done.where(F.col("layer").isin([int(x) for x in layers])).groupBy("chunk_idx").agg(F.countDistinct("layer").alias("n")).where(F.col("n") == len(set(layers))).select("chunk_idx")
        return df.join(F.broadcast(whole), "chunk_idx", "left_anti")

    def undone(self, df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
        """Rows whose ``keys`` are not committed yet."""
        done = self.committed(name)
        return df.join(F.broadcast(done.select(*keys)), list(keys), "left_anti") if set(keys) <= set(done.columns) else df

    def layer(self, layer: int, name: str = "activations") -> DataFrame:
        """Activations of one layer by partition pruning; an absent layer is an error."""
        rows = self.read(name).where(F.col("layer") == layer)
        if not rows.limit(1).count():
            raise ValueError(f"no activations of layer {layer}")
        return rows

    def width(self, layer: int, name: str = "activations") -> int:
        return int(self.layer(layer, name).select(F.size("activation")).first()[0])

    def write_json(self, value: dict, name: str) -> None:
        text = json.dumps(value, default=str, sort_keys=True)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self.path(name))

    def read_json(self, name: str) -> dict:
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(self.path(name), wholetext=True).collect()))

    def write_csv(self, df: DataFrame, name: str) -> None:
        """One of the report files by its columns; top tokens skip rows that are not finite or have chunk -1."""
        if name == "top_activating_tokens":
            df = df.where(~F.isnan("activation") & (F.abs("activation") < float("inf")) & (F.col("chunk_idx") >= 0))
        if name == "causal_ablation":
            df = df.where("mean_delta_ce IS NOT NULL")
        columns = CSV_COLUMNS.get(name, tuple(df.columns))
        df.select(*columns).write.mode("overwrite").option("header", True).csv(self.path(f"{name}.csv"))

    def write_rows_json(self, df: DataFrame, name: str) -> None:
        """A JSON object in a line for each row; nulls are written."""
        df.write.mode("overwrite").option("ignoreNullFields", False).json(self.path(name))

    def append_log(self, row: dict, name: str) -> None:
        """One more line of a log, kept whatever happens next."""
        self.spark.createDataFrame([(json.dumps(row, default=str),)], "value string").coalesce(1).write.mode("append").text(self.path(name))

    def read_csv(self, name: str) -> DataFrame:
        schema = ", ".join(f"{c} {CSV_TYPES.get(c, 'double')}" for c in CSV_COLUMNS[name])
        return self.spark.read.schema(schema).option("header", True).csv(self.path(f"{name}.csv"))

    def extraction_manifest(self, spectra: DataFrame, tokens: DataFrame, config: dict) -> dict:
        """Counts taken from the tables themselves, so that a resumed run lists every chunk; the chunks are a table."""
        per_chunk = tokens.groupBy("chunk_idx").agg(F.count("*").alias("n_tokens"), F.countDistinct("spectrum_idx").alias("n_spectra"))
        self.write(per_chunk.orderBy("chunk_idx"), "chunks")
        row = self.read("chunks").agg(F.count("*").alias("n_chunks"), F.sum("n_spectra").alias("n_spectra"), F.sum("n_tokens").alias("n_tokens")).first()
        manifest = {"schema_version": VERSION, "config": config, "n_spectra_read": spectra.count(), **{k: int(row[k] or 0) for k in ("n_chunks", "n_spectra", "n_tokens")}}
        self.write_json(manifest, "extraction_manifest.json")
        return manifest

    def cached_tokens(self) -> int:
        """n_tokens of a cached report; an older report, or one without tokens, is an error."""
        report = self.read_json("report.json")
        n = (report.get("phase_1_2") or {}).get("n_tokens") or 0
        if report.get("schema_version") != VERSION or n <= 0:
            raise ValueError("the cached report is of another version or has no tokens")
        return int(n)

    def feature_marginals(self) -> DataFrame:
        """feature_idx, mf: firing counts from rates and the report's number of tokens."""
        return self.read_csv("per_feature_stats").select("feature_idx", F.round(F.col("firing_rate") * self.cached_tokens()).cast("long").alias("mf"))

    def save_dictionary(self, model: Dictionary, name: str) -> None:
        self.write_json({"threshold": model.threshold, "b_dec": model.b_dec.tolist(), "firing_count": None if model.firing_count is None else model.firing_count.tolist(), "info": model.info}, f"{name}/params.json")
        self.write(model.table(self.spark), f"{name}/weights")  # last, as it tells that the dictionary is complete

    def load_dictionary(self, name: str) -> Dictionary:
        params = self.read_json(f"{name}/params.json")
        model = from_table(self.read(f"{name}/weights"), params["threshold"], np.array(params["b_dec"]))
        model.firing_count = None if params["firing_count"] is None else np.array(params["firing_count"])
        return model

    def causal_records(self) -> DataFrame:
        """feature_idx, concept, metrics, source: what the report says of a feature alone, and of the groups that it was in."""
        per_concept = (self.read_json("report.json").get("phase_8") or {}).get("per_concept") or {}
        number = lambda v: None if v is None or v != v else float(v)
        metrics = ("selectivity", "selectivity_z", "mean_delta_ce")
        rows = []
        for concept, x in per_concept.items():
            group = (x or {}).get("causal")
            rows += [(int(f), concept, *[number(group.get(k)) for k in metrics], "group") for f in (x or {}).get("top_n_features") or [] if group]
            rows += [(int(f["feature_idx"]), concept, number(f.get("selectivity")), None, number(f.get("mean_delta_ce")), "per_feature") for f in (x or {}).get("per_feature_ablation") or []]
        return self.spark.createDataFrame(rows, "feature_idx int, concept string, selectivity double, selectivity_z double, mean_delta_ce double, source string")

    def clear(self, name: str) -> bool:
        delete_path(self.spark, self.path(f"{name}.manifest"))
        return delete_path(self.spark, self.path(name))

    def size(self) -> int:
        """Bytes below the folder."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return int(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength())


def check_alignment(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("chunk_idx",)) -> None:
    """Token counts of both sides must agree in every chunk."""
    odd = misaligned(left, right, keys).limit(3).collect()
    if odd:
        raise ValueError(f"token counts differ, for example {[r.asDict() for r in odd]}")


def misaligned(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("chunk_idx",)) -> DataFrame:
    """keys, n_left, n_right where the sides hold different numbers of rows; null for a side that has none."""
    n = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    return n(left, "n_left").join(n(right, "n_right"), list(keys), "full_outer").where(~F.col("n_left").eqNullSafe(F.col("n_right")))


def load_dotenv(text: str, environment: dict[str, str]) -> dict[str, str]:
    """Settings of a ``.env`` text that the environment lacks: a BOM, ``export`` and quotes are dropped."""
    out = dict(environment)
    for line in text.lstrip("﻿").splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, _, value = line.removeprefix("export ").partition("=")
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out.setdefault(key.strip(), value)
    return out


def is_model_id(source: str) -> bool:
    """True for the id of a published model, false for a path: a checkpoint's name, or anything with a separator."""
    return not (source.endswith(".ckpt") or "/" in source or "\\" in source)
