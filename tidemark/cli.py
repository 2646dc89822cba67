"""Command line: run, backfill, leaderboard, retrain."""

from __future__ import annotations

import argparse
from collections.abc import Sequence


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--config", required=True)
    p.add_argument("--bars", required=True, help="Parquet of entity_id, ts_utc, open, high, low, close, volume")
    p.add_argument("--store", required=True, help="folder that all executors share")
    p.add_argument("--checkpoint", help="shared folder for checkpoints; that of spark.checkpoint.dir if it is not given")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "retrain"):
        c = sub.add_parser(name)
        c.add_argument("--date", required=True)
        c.add_argument("--model", action="append")
    c = sub.add_parser("backfill")
    c.add_argument("--start", required=True)
    c.add_argument("--end", required=True)
    c = sub.add_parser("leaderboard")
    c.add_argument("--ticker", required=True)
    c.add_argument("--date", required=True)
    return p


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .operators.store import Store
    from .plans import race

    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    if args.checkpoint:
        spark.sparkContext.setCheckpointDir(args.checkpoint)
    config, bars, store = race.load_config(args.config), spark.read.parquet(args.bars), Store(spark, args.store)
    if args.command in ("run", "retrain"):
        race.run(spark, bars, store, config, f"{args.date} 00:00:00", force=args.command == "retrain", only=args.model).show()
    elif args.command == "backfill":
        race.backfill(spark, bars, store, config, args.start, args.end)
    else:
        board = config.get("leaderboard", {})
        store.leaderboard(args.ticker, f"{args.date} 00:00:00", board.get("window", 252), board.get("primary", "qlike")).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
