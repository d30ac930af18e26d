"""Sources of spectra: Parquet, MGF and mzML, with the column fallbacks of the input tables."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import global_index, running_offset
from ..staging import staged

SCHEMA = "spectrum_id string, sequence string, modified_sequence string, precursor_mz double, precursor_charge int, mz_array array<double>, intensity_array array<double>"


def read_spectra(spark: SparkSession, source: str) -> DataFrame:
    """Spectra of a Parquet file, folder or glob, of MGF or of mzML, by the name's ending."""
    if source.lower().endswith(".mgf"):
        return read_mgf(spark, source)
    if source.lower().endswith(".mzml"):
        return read_mzml(spark, source)
    return spark.read.parquet(source)


def numbered_spectra(spark: SparkSession, source: str, name: str = "global_spectrum") -> DataFrame:
    """Spectra with their number in the order of files and rows, which does not hang on how files are split for tasks.

    Rows of Parquet files know their place, so only a count for each file is needed. Others are parsed once, written in
    the order that they are read in, and numbered by the counts of the blocks of files that tasks read.
    """
    reader = next((r for ending, r in ((".mzml", read_mzml), (".mgf", read_mgf)) if source.lower().endswith(ending)), None)
    if reader:
        block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        read = reader(spark, source, block)
        # Rows of a task count up one by one, and those of one block of a file follow each other.
        read = read.withColumnsRenamed({read.columns[-1]: "_block"}).withColumn("_row", F.monotonically_increasing_id())
        rows = staged(read, "parsed")
        blocks = running_offset(rows.groupBy("_block").agg(F.count("*").alias("n"), F.min("_row").alias("first")), "_block", "n")
        before = blocks.select("_block", (F.col("offset") - F.col("first")).alias("offset"))  # one row for each block
        return rows.join(F.broadcast(before), "_block").withColumn(name, F.col("offset") + F.col("_row")).drop("_block", "_row", "offset")
    rows = spark.read.parquet(source).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = running_offset(rows.groupBy("_file").agg(F.count("*").alias("n")), "_file", "n").select("_file", "offset")
    return rows.join(before, "_file").withColumn(name, F.col("offset") + F.col("_row")).drop("_file", "_row", "offset")


def read_mgf(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """Blocks end at ``END IONS``, so large files are split; fields and peaks are cut out in column expressions."""
    blocks = spark.read.option("lineSep", "END IONS").text(path).where(F.col("value").contains("BEGIN IONS"))
    text = F.col("value")
    field = lambda name: F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^{name}=([^\r\n]*)", 1)), F.lit(""))
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^([0-9][0-9.eE+-]*[ \t]+[0-9][0-9.eE+-]*)"), F.lit(1))
    number = lambda i: F.transform(lines, lambda x: F.split(x, r"[ \t]+")[i].try_cast("double"))
    return blocks.select(
        field("TITLE").alias("spectrum_id"), field("SEQ").alias("sequence"), F.lit(None).cast("string").alias("modified_sequence"), F.split(field("PEPMASS"), r"[ \t]+")[0].try_cast("double").alias("precursor_mz"),
        F.regexp_extract(field("CHARGE"), r"(\d+)", 1).try_cast("int").alias("precursor_charge"), number(0).alias("mz_array"), number(1).alias("intensity_array"), *more,
    )


def _values(node: ElementTree.Element, ns: str) -> tuple[str, list[float]]:
    names = {p.get("name", ""): p.get("value", "") for p in node.iter(f"{ns}cvParam")}
    raw = base64.b64decode(node.findtext(f"{ns}binary") or "")
    raw = zlib.decompress(raw) if "zlib compression" in names else raw
    kind, size = ("d", 8) if "64-bit float" in names else ("f", 4)
    what = "mz" if "m/z array" in names else "intensity" if "intensity array" in names else ""
    return what, list(struct.unpack(f"<{len(raw) // size}{kind}", raw))


ARROW = pa.schema([("spectrum_id", pa.string()), ("sequence", pa.string()), ("modified_sequence", pa.string()), ("precursor_mz", pa.float64()), ("precursor_charge", pa.int32()), ("mz_array", pa.list_(pa.float64())), ("intensity_array", pa.list_(pa.float64()))])
_OPEN, _EMPTY = re.compile(r"<spectrum(?:\s[^>]*[^/>]|\s)?>"), re.compile(r"<spectrum\s[^>]*/>")


def _mzml_rows(block: str) -> Iterator[dict]:
    """MS2 spectra of the text up to an end tag: elements without content, then the one that the tag closes."""
    opened = [m.start() for m in _OPEN.finditer(block)]
    texts = [m.group() for m in _EMPTY.finditer(block)] + ([block[opened[-1] :] + "</spectrum>"] if opened else [])
    for text in texts:
        node = ElementTree.fromstring(text)
        values = {p.get("name"): p.get("value") for p in node.iter("cvParam")}
        if values.get("ms level", "2") == "1":
            continue
        arrays = dict(_values(x, "") for x in node.iter("binaryDataArray"))
        charge, mz = values.get("charge state"), values.get("selected ion m/z")
        yield {"spectrum_id": node.get("id"), "sequence": None, "modified_sequence": None, "precursor_mz": float(mz) if mz else None, "precursor_charge": int(charge) if charge else None, "mz_array": arrays.get("mz", []), "intensity_array": arrays.get("intensity", [])}


def read_mzml(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """MS2 spectra of mzML files of any size, with ``more`` columns of the block that a spectrum lies in.

    The text reader ends records at the end tag of a spectrum, so Spark splits a file by byte ranges as it splits lines,
    and a task holds one spectrum's text at a time. Element names must be without a prefix, as usual.
    """
    extra = [f"_m{i}" for i in range(len(more))]
    blocks = spark.read.option("lineSep", "</spectrum>").text(path)
    blocks = blocks.select("value", *[m.alias(n) for m, n in zip(more, extra, strict=True)]).where(F.col("value").contains("<spectrum"))
    kinds = "".join(f", {n} {blocks.schema[n].dataType.simpleString()}" for n in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []
            for i, text in enumerate(b.column("value")):
                own = list(_mzml_rows(text.as_py()))
                rows += own
                at += [i] * len(own)
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array([r[f.name] for r in rows], f.type) for f in ARROW], *[b.column(n).take(place) for n in extra]], names=[*ARROW.names, *extra])

    return blocks.mapInArrow(run, SCHEMA + kinds)


def write_mzml(spectra: DataFrame, path: str, files: int | None = None) -> None:
    """Spectra (the columns of ``SCHEMA``) as text files of mzML spectrum elements, arrays in 64 bits and zlib."""

    def array(name: str, values: list[float] | None) -> str:
        raw = zlib.compress(np.asarray(values or [], "<f8").tobytes())
        return f'<binaryDataArray><cvParam name="64-bit float"/><cvParam name="zlib compression"/><cvParam name="{name}"/><binary>{base64.b64encode(raw).decode()}</binary></binaryDataArray>'

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                values = {"ms level": 2, "selected ion m/z": r["precursor_mz"], "charge state": r["precursor_charge"]}
                params = "".join(f'<cvParam name="{k}" value="{v!r}"/>' for k, v in values.items() if v is not None)
                out.append(f"<spectrum id={quoteattr(r['spectrum_id'] or '')}>{params}{array('m/z array', r['mz_array'])}{array('intensity array', r['intensity_array'])}</spectrum>")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    text = spectra.select("spectrum_id", "precursor_mz", "precursor_charge", "mz_array", "intensity_array").mapInArrow(run, "value string")
    (text.coalesce(files) if files else text).write.mode("overwrite").text(path)


def merge_splits(parts: Sequence[DataFrame], order: Sequence[str] = ()) -> DataFrame:
    """All splits in one table; where there is no spectrum_id it becomes the row's number in ``order``."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if "spectrum_id" in merged.columns:
        return merged
    return global_index(merged, list(order) or merged.columns[:1], "_row").withColumn("spectrum_id", F.col("_row").cast("string")).drop("_row")


def normalised(rows: DataFrame, index: str | None = None) -> DataFrame:
    """The spectra columns, whatever the input has.

    sequence, then peptide; modified_sequence, then proforma, then the bare sequence: each falls through where empty or
    missing. spectrum_id (``row_<i>``, i from the column ``index``), charge (0) and m/z (0.0) have defaults only where the column is missing.
    """
    has = set(rows.columns)

    def first_of(*names: str, last: Column) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in has], last)

    sequence = first_of("sequence", "peptide", last=F.lit(""))
    if not index and "spectrum_id" not in has:
        raise ValueError("rows without spectrum_id need a column that numbers them")
    number = F.col(index) if index else F.lit("")
    keep = [c for c in ("mz_array", "intensity_array", index) if c and c in has]
    return rows.select(
        (F.col("spectrum_id").cast("string") if "spectrum_id" in has else F.concat(F.lit("row_"), number)).alias("spectrum_id"), sequence.alias("sequence"), first_of("modified_sequence", "proforma", last=sequence).alias("modified_sequence"),
        (F.col("precursor_charge").cast("long") if "precursor_charge" in has else F.lit(0).cast("long")).alias("precursor_charge"), (F.col("precursor_mz").cast("double") if "precursor_mz" in has else F.lit(0.0)).alias("precursor_mz"), *keep,
    )


def loader_mismatches(loader: DataFrame, source: DataFrame, key: str = "global_spectrum", tolerance: float = 1e-5) -> DataFrame:
    """Rows that differ between what a loader gave and the source: identity, sequences, charge, precursor m/z, or a missing side."""
    a, b = loader.alias("a"), source.alias("b")
    same = F.lit(True)
    for c in ("spectrum_id", "sequence", "modified_sequence", "precursor_charge"):
        if c in loader.columns and c in source.columns:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    near = F.coalesce(F.abs(F.col("a.precursor_mz") - F.col("b.precursor_mz")) <= tolerance, F.col("a.precursor_mz").isNull() & F.col("b.precursor_mz").isNull())
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.where(~F.coalesce(same & near & F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull(), F.lit(False))).select(F.coalesce(f"a.{key}", f"b.{key}").alias(key))


def check_loader(loader: DataFrame, source: DataFrame, **options) -> None:
    bad = loader_mismatches(loader, source, **options).limit(5).collect()
    if bad:
        raise ValueError(f"loader and source differ, for example at {[r[0] for r in bad]}")
