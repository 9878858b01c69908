"""Command line: index, browse, score, cluster, export."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .catalog import Library
from .functions import vectors
from .operators import browse, media, scoring
from .plans import ingest, jobs
from .plans.params import Filters, SortCriterion, parse_sort
from .sources import json_schema

#: Scorers that this package brings; others are registered by adding them here.
SCORERS = {"simple": media.SimpleScorer}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="silverleaf", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.add_argument("root", help="folder that holds the album folders")
        p.add_argument("--library", required=True, help="folder of the library's tables")
        return p

    command("index", "scan a tree into the library")
    command("hash", "compute perceptual hashes that are missing")
    b = command("browse", "list assets")
    b.add_argument("--sort", help="scorer:variant:metric")
    b.add_argument("--favorited", action="store_true", default=None)
    b.add_argument("--page", type=int, default=1)
    s = command("score", "run the built-in scorer")
    s.add_argument("--scorer", default="simple", help="a registered scorer")
    s.add_argument("--variant", default=None)
    s.add_argument("--rerun", action="store_true")
    c = command("cluster", "find near duplicates")
    c.add_argument("--method", choices=["phash", "clip"], default="phash")
    c.add_argument("--metric", choices=vectors.METRICS, default="cosine")
    c.add_argument("--single-linkage", action="store_true")
    c.add_argument("--threshold", type=float, default=None)
    c.add_argument("--window", type=int, default=200)
    c.add_argument("--min-size", type=int, default=2)
    c.add_argument("--max-size", type=int, default=None)
    p = sub.add_parser("profile", help="the schema of a folder's JSON files")
    p.add_argument("root")
    p.add_argument("--pattern", default="*.json")
    p.add_argument("--limit", type=int, default=None)
    e = command("export", "copy the best of every cluster")
    e.add_argument("--out", required=True)
    e.add_argument("--scorer", default="")
    e.add_argument("--metric", default="")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("silverleaf").getOrCreate()
    if args.command == "profile":
        made, parsed, failed = json_schema.profile_files(spark, args.root, args.pattern, args.limit)
        for r in made.orderBy("path").collect():
            print(r["path"], "/".join(r["kinds"]), r["seen"], "required" if r["required"] else "optional", ", ".join(r["examples"]), sep="\t")
        print(f"{parsed} parsed, {failed} failed")
        return 0 if parsed + failed else 2
    lib, now = Library(spark, args.library), int(time.time())
    if args.command == "index":
        ingest.index(lib, args.root, now)
        print(f"{lib.read('assets').count()} assets")
    elif args.command == "hash":
        jobs.hash_images(lib, args.root, now)
        print(f"{lib.read('phash').count()} hashes")
    elif args.command == "browse":
        key, filters, offset = parse_sort(args.sort), Filters(favorited=args.favorited), 50 * (max(1, args.page) - 1)
        rows = browse.list_by_score(lib.read("assets"), lib.read("asset_scores"), SortCriterion(*key), filters, 50, offset) if key else browse.list_deduped(lib.read("assets"), filters, 50, offset)
        for r in rows.select("id", "relpath").collect():
            print(r["id"], r["relpath"], sep="\t")
    elif args.command == "score":
        seen, scored = jobs.score_images(lib, args.root, scoring.by_id(SCORERS, args.scorer), now, args.variant, not args.rerun)
        print(f"{scored} of {seen} assets scored")
    elif args.command == "cluster":
        print(f"{jobs.cluster_images(lib, now, args.method, args.metric, args.threshold, args.window, args.min_size, args.max_size, args.single_linkage)} clusters")
    else:
        done = jobs.export(lib, args.root, args.out, args.scorer, args.metric).groupBy("copied").count().collect()
        print(", ".join(f"{r['count']} {'copied' if r['copied'] else 'missing'}" for r in done) or "nothing to export")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
