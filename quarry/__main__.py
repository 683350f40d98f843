"""python -m quarry COMMAND: the engine on the command line; answers are JSON."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--root", default=".")
    p.add_argument("--store", default=".quarry")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("reindex")
    sub.add_parser("status")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=8)
    c.add_argument("--mode", default="auto")
    c.add_argument("--kind")
    c = sub.add_parser("symbols")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=24)
    c.add_argument("--prefix")
    c.add_argument("--kind")
    for name in ("related", "impact"):
        sub.add_parser(name).add_argument("name")
    c = sub.add_parser("neighborhood")
    c.add_argument("file")
    c.add_argument("line", type=int)
    c = sub.add_parser("inspect")
    c.add_argument("handle")
    c.add_argument("--offset", type=int, default=0)
    c.add_argument("--max-lines", type=int, default=24)
    c.add_argument("--max-chars", type=int, default=4000)
    c = sub.add_parser("evidence-pack")
    c.add_argument("question")
    c.add_argument("--tokens", type=int, default=8000)
    return p


def main(argv: list[str]) -> int:
    options = vars(parser().parse_args(argv))
    command, root, store = (options.pop(k) for k in ("command", "root", "store"))
    from pyspark.sql import SparkSession

    from quarry.plans.engine import Engine

    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out = getattr(Engine(spark, root, store), command.replace("-", "_"))(**options)
    except ValueError as e:
        print(json.dumps({"error": "invalid_params", "message": str(e)}))
        return 2
    print(json.dumps(out, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
