"""Command line: ``python -m chronomesh.cli COMMAND``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

import yaml

from chronomesh.plans.recipes import get_recipe, list_datasets, list_recipes
from chronomesh.registry import SOURCES, get_default_adapter_registry, get_default_registry
from chronomesh.schema import RecipeConfig

__version__ = "0.1.0"


def _config(path: str) -> RecipeConfig:
    with open(path) as f:
        return RecipeConfig.model_validate(yaml.safe_load(f))


def _run(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from chronomesh.sources.crime import load_crime
    from chronomesh.sources.sinks import FileSink

    config = _config(args.config)
    recipe = get_recipe(config.dataset, config.recipe)(config)
    SparkSession.builder.appName("chronomesh").getOrCreate()
    frame = recipe.run(load_crime(args.input))
    out = config.output
    FileSink(args.output, out.get("format", "parquet"), out.get("compression", "snappy"), out.get("partition_by", ())).write(frame)
    print(f"wrote {args.output}")
    return 0


def _validate(args: argparse.Namespace) -> int:
    config = _config(args.config)
    get_recipe(config.dataset, config.recipe)(config).get_pipeline()
    print(f"{args.config} is valid")
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chronomesh", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("run", help="run a recipe on a dataset and write the result")
    one.add_argument("config")
    one.add_argument("--input", required=True)
    one.add_argument("--output", required=True)
    one = commands.add_parser("validate", help="check a recipe's config")
    one.add_argument("config")
    commands.add_parser("list-datasets")
    one = commands.add_parser("list-recipes")
    one.add_argument("dataset", nargs="?")
    one = commands.add_parser("list-steps")
    one.add_argument("--tag")
    for name in ("list-context-sources", "list-output-adapters", "version"):
        commands.add_parser(name)
    args = parser.parse_args(argv)
    if args.command in ("run", "validate"):
        try:
            return (_run if args.command == "run" else _validate)(args)
        except (ValueError, KeyError, OSError) as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
    shown = {
        "version": lambda: [__version__],
        "list-datasets": list_datasets,
        "list-recipes": lambda: list_recipes(args.dataset),
        "list-steps": lambda: [f"{s.name}: {s.description}" for s in get_default_registry().list(tag=args.tag)],
        "list-context-sources": lambda: [f"{s.name}: {s.description}" for s in _sources()],
        "list-output-adapters": lambda: [f"{s.name}: {s.description}" for s in get_default_adapter_registry().list()],
    }
    print("\n".join(shown[args.command]()))
    return 0


def _sources():
    from chronomesh.sources import context  # noqa: F401

    return SOURCES.list()


if __name__ == "__main__":
    sys.exit(main())
