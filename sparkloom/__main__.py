"""Command line: build, inspect, search, queries."""

from __future__ import annotations

import argparse
import os

from .plans import config, pipelines
from .session import local_session, ship_package
from .sources import index_store, records

DOCUMENT = "id string, title string, text string, url string, language string, published_at timestamp, metadata map<string,string>"


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkloom")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="index documents, one JSON object a line")
    build.add_argument("input")
    build.add_argument("index")
    inspect = commands.add_parser("inspect", help="show the shards of an index")
    inspect.add_argument("index")
    search = commands.add_parser("search", help="the best documents for a question")
    search.add_argument("index")
    search.add_argument("question")
    search.add_argument("--mode", default="hybrid", choices=["lexical", "dense", "hybrid"])
    for command in (build, search):
        command.add_argument("--config")
    own = parser.parse_args(argv)
    spark = local_session()
    ship_package(spark)
    made = config.settings(config.of_file(getattr(own, "config", None)), config.of_environment(os.environ))
    if own.command == "build":
        pipelines.build(records.read_json_lines(spark, own.input, DOCUMENT), own.index, made)
    elif own.command == "inspect":
        index_store.read_index(spark, own.index)["shards"].select("shard_id", "title", "summary").orderBy("shard_id").show(1000, False)
    else:
        pipelines.run_search(spark, own.index, own.question, made, own.mode).show(100, False)


if __name__ == "__main__":
    main()
