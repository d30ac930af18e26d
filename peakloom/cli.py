"""Command line: ``spark-submit -m peakloom.cli STAGE --out DIR ...``; the models are stand-ins unless code injects others."""

from __future__ import annotations

import argparse
import json
import logging
import os

from .operators.adapters import EchoClient, HashModel, residue_ids, usable_model
from .operators.interpretation import STRATA
from .operators.training import TrainConfig
from .plans import stages
from .session import build_session
from .sources.artefacts import Artefacts, is_model_id, load_dotenv

LOG = logging.getLogger("peakloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="peakloom")
    p.add_argument("stage", choices=("extract", "annotate", "train", "evaluate", "interpret", "summary", "all"))
    # The names of options, here and below.
    p.add_argument("--out", "--output-dir", required=True)
    p.add_argument("--layers", "--target-layer", default="2", help="comma-separated")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--log-level", default="INFO")
    g = p.add_argument_group("extract")
    g.add_argument("--source", "--spectra-path", "--dataset-path", help="Parquet file, folder or glob, .mgf or .mzML")
    g.add_argument("--model-path", help="checkpoint or id, handed to the model that code injects")
    g.add_argument("--chunk-size", type=int, default=1024)
    g.add_argument("--batch-size", type=int, default=32)
    g.add_argument("--n-peaks", type=int, default=200)
    g.add_argument("--max-spectra", type=int)
    g.add_argument("--no-baseline", action="store_true")
    g = p.add_argument_group("annotate")
    g.add_argument("--ion-types", default="byIp")
    g.add_argument("--no-internal", action="store_true")
    g.add_argument("--fragment-tol", type=float, default=20.0)
    g.add_argument("--fragment-tol-mode", choices=("ppm", "Da"), default="ppm")
    g.add_argument("--ptm-table", help="JSON object of notations and UNIMOD ids or names")
    g = p.add_argument_group("train")
    g.add_argument("--d-dict", type=int, default=12288)
    g.add_argument("--k", type=int, default=32)
    g.add_argument("--k-aux", type=int, default=512)
    g.add_argument("--epochs", "--n-epochs", type=int, default=3)
    g.add_argument("--train-batch", type=int, default=8192)
    g.add_argument("--lr", type=float, default=2e-4)
    g.add_argument("--warmup", "--warmup-steps", type=int, default=1000)
    g.add_argument("--lr-min-ratio", type=float, default=0.1, help="rate at the end, as a share of --lr")
    g.add_argument("--alpha-aux", type=float, default=1 / 32, help="weight of the loss on dead features")
    g.add_argument("--grad-clip-norm", type=float, default=1.0)
    g.add_argument("--tangent-grad-projection", action=argparse.BooleanOptionalAction, default=True, help="take from decoder gradients what would change a row's length")
    g.add_argument("--log-every", type=int, default=100, help="steps between rows of the log")
    g.add_argument("--val-every", type=int, default=1000, help="steps between validations on a sample of the held-out tokens")
    g.add_argument("--val-fraction", type=float, default=0.02)
    g.add_argument("--within-chunks", action="store_true", help="shuffle chunks and tokens within them, not all tokens together")
    g.add_argument("--parts", type=int, default=1, help="tasks that take every step together")
    g.add_argument("--averaged", action="store_true", help="let parts train apart for an epoch and average their weights")
    g = p.add_argument_group("evaluate")
    g.add_argument("--skip", nargs="*", default=[], choices=stages.PHASES)
    g.add_argument("--fdr-q", type=float, default=0.05)
    g.add_argument("--ablation-spectra", type=int, default=5000)
    g.add_argument("--ablation-top-n", type=int, default=10)
    g.add_argument("--ablation-per-feature-top", type=int, default=100)
    g.add_argument("--cross-layer-tokens", type=int, default=100_000)
    g.add_argument("--other-layers", default="", help="comma-separated layers that have dictionaries")
    g.add_argument("--other-seeds", default="", help="comma-separated seeds that have reports")
    g.add_argument("--phase4-cache-dir")
    g.add_argument("--force", action="store_true", help="evaluate and interpret anew where results are there")
    g = p.add_argument_group("interpret")
    g.add_argument("--strata", nargs="+", default=list(STRATA), choices=STRATA)
    g.add_argument("--n-per-stratum", type=int, default=40)
    g.add_argument("--n-sample-chunks", type=int, default=12)
    g.add_argument("--include-concept-labels", action="store_true")
    g.add_argument("--env-file", help="settings for the language model that the environment lacks")
    g.add_argument("--dry-run", action="store_true")
    g = p.add_argument_group("all")
    g.add_argument("--drop-activations", action="store_true", help="delete the activations when all stages have ended")
    return p


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x]


def main(argv: list[str] | None = None, model: object = None, client: object = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level, format="%(asctime)s %(levelname)s %(message)s")
    layers, wanted = _numbers(args.layers), lambda *names: args.stage in (*names, "all")
    spark = build_session()
    if args.env_file:
        text = "\n".join(r["value"] for r in spark.read.text(args.env_file).collect())
        os.environ.update(load_dotenv(text, dict(os.environ)))
    if args.model_path:
        LOG.info("model %s is %s", args.model_path, "an id" if is_model_id(args.model_path) else "a checkpoint")
    out, model = Artefacts(spark, args.out), usable_model(model or HashModel())
    if wanted("extract"):
        if not args.source:
            parser().error("extract needs --source")
        LOG.info("extract %s", args.source)
        stages.extract(spark, args.source, out, model, layers, args.chunk_size, args.batch_size, args.max_spectra, args.n_peaks, not args.no_baseline)
    if wanted("annotate"):
        LOG.info("annotate")
        table = json.loads("\n".join(r["value"] for r in spark.read.text(args.ptm_table, wholetext=True).collect())) if args.ptm_table else {}
        stages.label(out, args.fragment_tol, args.fragment_tol_mode, args.ion_types, not args.no_internal, residue_ids(table, getattr(model, "residues", None)) or None)
    for layer in layers:
        if wanted("train"):
            LOG.info("train layer %d", layer)
            stages.train_layer(out, layer, TrainConfig(d_dict=args.d_dict, k=args.k, k_aux=args.k_aux, lr=args.lr, warmup=args.warmup, epochs=args.epochs, batch=args.train_batch, val_fraction=args.val_fraction, across_chunks=not args.within_chunks, parts=args.parts, averaged=args.averaged, lr_floor=args.lr_min_ratio, alpha=args.alpha_aux, clip=args.grad_clip_norm, tangent=args.tangent_grad_projection, log_every=args.log_every, val_every=args.val_every, seed=args.seed))
    for layer in layers:
        if wanted("evaluate"):
            LOG.info("evaluate layer %d", layer)
            others = tuple(x for x in _numbers(args.other_layers) if x != layer)
            stages.evaluate(out, stages.EvaluationConfig(layer, args.seed, tuple(args.skip), args.fdr_q, ablation_spectra=args.ablation_spectra, ablation_top_n=args.ablation_top_n, ablation_singles=args.ablation_per_feature_top, cross_tokens=args.cross_layer_tokens, other_layers=others, other_seeds=tuple(x for x in _numbers(args.other_seeds) if x != args.seed), phase4_cache=args.phase4_cache_dir, force=args.force), model)
        if wanted("interpret"):
            LOG.info("interpret layer %d", layer)
            stages.describe(out, layer, client or EchoClient(), args.n_per_stratum, args.n_sample_chunks, args.seed, args.dry_run, args.strata, args.include_concept_labels, args.seed, args.force)
    if wanted("summary"):
        stages.summary(out, layers, args.seed).show(len(layers), truncate=False)
    if args.drop_activations and args.stage == "all":
        LOG.info("%d bytes before the activations go", out.size())
        out.clear("activations")
    LOG.info("%d bytes below %s", out.size(), out.root)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
