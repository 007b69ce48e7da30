"""Command line: ``python -m spindrift COMMAND CHECKPOINT ...`` over a Spark session of the environment's settings."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import build as plans
from .sources import datasets

READERS = {"ml1m": datasets.read_ml1m, "ml20m": datasets.read_ml20m, "goodbooks": datasets.read_goodbooks}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spindrift")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **options):
        p = commands.add_parser(name)
        p.add_argument("checkpoint")
        for o, kind in options.items():
            p.add_argument(f"--{o}", type=kind, default=None)
        return p

    build = command("build", data=str, ratings=str, metadata=str, split_mode=str, seed=int, val_users=int, test_users=int, user_min_support=int, item_min_support=int, min_value=float, set_values_to=float, eval_fold=int,
                    val_items=int, test_items=int, item_val_frac=float, item_test_frac=float, temporal_test_frac=float, min_source_items=int, min_target_items=int, text_fields=str, min_text_words=int,
                    category=str, annotation_source=str, annotation_min_count=int)
    build.add_argument("--dataset", required=True, choices=sorted(datasets.SPECS))
    build.add_argument("--history", nargs=3, metavar=("TRAIN", "VALID", "TEST"), help="parts of a temporal split whose rows hold their past")
    build.add_argument("--images", action="store_const", const=True, help="keep image addresses")
    elsa = dict(dim=int, epochs=int, batch=int, lr=float, ema=float, ema_every=int, clip=float, accumulate=int, weight_decay=float, seed=int)
    command("train-elsa", **elsa)
    command("train-compressed-elsa", **elsa, k_target=int, stages=int, mask_every=int, window=int, threshold=float, ste_alpha=float, score=str)
    command("train-text", dim=int)
    command("train-sae", stage=str, hidden=int, k=int, loss=str, epochs=int, batch=int, lr=float, seed=int, score=str, ste_alpha=float, norm_p=float)
    evaluate = command("evaluate")
    evaluate.add_argument("--stages", nargs="*")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = {k: v for k, v in vars(parser().parse_args(arguments)).items() if v is not None}
    command, path = given.pop("command"), given.pop("checkpoint")
    spark = spark or SparkSession.builder.appName(f"spindrift {command}").getOrCreate()
    if command == "build":
        data, ratings, metadata, category, history, images = (given.pop(k, None) for k in ("data", "ratings", "metadata", "category", "history", "images"))
        options = plans.BuildOptions(**given, labelled_text=given["dataset"] == "amazon2023")
        data, past = data or "data", None
        if options.dataset != "amazon2023":
            rows, items = READERS[options.dataset](spark, data)
        elif ratings and metadata:
            rows, items = datasets.read_amazon(spark, ratings, metadata, bool(images), options.text_fields)
        elif category:
            rows, items = datasets.read_amazon_category(spark, data, category, bool(images), options.text_fields)
        else:
            raise SystemExit("amazon2023 needs --category, or --ratings and --metadata")
        if options.dataset == "amazon2023" and options.split_mode == "temporal":
            if not (history or category):
                raise SystemExit("a temporal split of amazon2023 needs --category or --history")
            past = datasets.read_amazon_history(spark, *history) if history else datasets.read_amazon_category_history(spark, data, category)
        plans.build(spark, path, rows, options, items, history=past, annotation_root=data)
    elif command in ("train-elsa", "train-compressed-elsa"):
        if command == "train-compressed-elsa":
            given.setdefault("k_target", 128)
        print(json.dumps(plans.train_elsa(spark, path, **given)))
    elif command == "train-text":
        plans.train_text(spark, path, **given)
    elif command == "train-sae":
        print(json.dumps(plans.train_sae(spark, path, **given)))
    else:
        plans.evaluate(spark, path, given.get("stages")).show(truncate=False)


if __name__ == "__main__":
    main()
