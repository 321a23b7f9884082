"""Command line: python -m murmuration [--root FOLDER] COMMAND ARGUMENTS."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from .plans.stages import Workspace

#: The run's coordinates, as most commands take them.
_RUN = (("model", str), ("layer", int), ("gamma", float), ("n_clusters", int))
COMMANDS = {
    "extract_alignment": (("align_dir", str),),
    "extract_features": (("audio_dir", str), ("audio_ext", str), ("model", str), ("layer", int)),
    "kmeans": (("audio_dir", str), ("model", str), ("layer", int), ("n_clusters", int)),
    "encode_features": (("audio_dir", str), ("align_dir", str), *_RUN),
    "distance": _RUN,
    "graph": (*_RUN, ("align_dir", str), ("threshold", float)),
    "cluster": (*_RUN, ("features_dir", str), ("align_dir", str), ("threshold", float), ("resolution", float)),
    "evaluate": (*_RUN, ("threshold", float), ("align_dir", str)),
    "samediff": (*_RUN, ("align_dir", str)),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="murmuration")
    out.add_argument("--root", default=".", help="the workspace folder")
    out.add_argument("--encoder", default="", help="extract_features: module:function from bytes to a matrix of frames")
    out.add_argument("--target", type=int, default=13_967, help="cluster: number of clusters to come close to")
    commands = out.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        one = commands.add_parser(name)
        for argument, kind in arguments:
            one.add_argument(argument, type=kind)
    return out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("murmuration").getOrCreate()
    w = Workspace(spark, a.root)
    run = (getattr(a, "model", None), getattr(a, "layer", None), getattr(a, "gamma", None), getattr(a, "n_clusters", None))
    if a.command == "extract_alignment":
        print(f"{w.extract_alignment(a.align_dir).count()} words")
    elif a.command == "extract_features":
        module, _, name = a.encoder.partition(":")
        encode = getattr(importlib.import_module(module), name) if module else None
        print(f"{w.extract_features(a.audio_dir, a.audio_ext, a.model, a.layer, encode).count()} frames")
    elif a.command == "kmeans":
        print(f"{w.kmeans(a.model, a.layer, a.n_clusters).count()} codes")
    elif a.command == "encode_features":
        print(f"{w.encode_features(a.align_dir, *run).count()} words")
    elif a.command == "distance":
        print(f"{w.distance(*run).count()} pairs")
    elif a.command == "graph":
        vertices, edges = w.graph(*run, a.align_dir, a.threshold)
        print(f"{vertices.count()} vertices, {edges.count()} edges")
    elif a.command == "cluster":
        print(w.cluster(*run, a.align_dir, a.threshold, a.resolution, a.target))
    elif a.command == "evaluate":
        print("NED %.4f, WP %.4f" % w.evaluate(*run, a.threshold, a.align_dir))
    elif a.command == "samediff":
        _, auc, _ = w.samediff(*run, a.align_dir)
        print(f"AUC {auc.first()['auc']}")


if __name__ == "__main__":
    main()
