"""Command line: every command prints one JSON document.

    python -m strandline.cli convert SOURCE DESTINATION --to 3.0
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from .operators.edit import episode_selection
from .plans import datasets as D
from .plans.doctor import doctor, gate, portability
from .plans.planner import plan_and_convert, plan_conversion
from .plans.record import JobStore
from .plans.sizing import environment_report
from .sources import default_registry, presets
from .sources.layouts import open_dataset


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="strandline", description="Convert, merge, edit, check and compare episodic datasets.")
    sub = parser.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="write a dataset in the other layout")
    c.add_argument("source")
    c.add_argument("destination")
    c.add_argument("--to", required=True)
    c.add_argument("--source-format", default="auto")
    c.add_argument("--options", default="{}", help="JSON options of the source format")
    c.add_argument("--preset", help="a saved mapping of an HDF5 source")
    c.add_argument("--data-mb", type=float, default=100)
    c.add_argument("--video-mb", type=float, default=200)
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--deep", action="store_true", help="check the frames and videos of the result too")
    c.add_argument("--dry-run", action="store_true", help="open the source and say what would be written")
    p = sub.add_parser("plan", help="file sizes and partitions for a conversion, and with --run the conversion")
    p.add_argument("source")
    p.add_argument("--to", required=True)
    p.add_argument("--run", metavar="DESTINATION")
    p.add_argument("--overwrite", action="store_true")
    x = sub.add_parser("merge-check", help="whether datasets can be merged")
    x.add_argument("sources", nargs="+")
    g = sub.add_parser("gate", help="whether a policy can be trained on a dataset")
    g.add_argument("source")
    g.add_argument("--policy", required=True)
    g.add_argument("--chunk-size", type=int)
    o = sub.add_parser("portability", help="what hinders moving a dataset")
    o.add_argument("source")
    z = sub.add_parser("status", help="the state of a conversion in parts")
    z.add_argument("folder")
    sub.add_parser("presets", help="saved mappings of HDF5 sources")
    m = sub.add_parser("merge", help="the ordered union of datasets")
    m.add_argument("sources", nargs="+")
    m.add_argument("--destination", required=True)
    m.add_argument("--overwrite", action="store_true")
    e = sub.add_parser("edit", help="delete episodes, drop features, relabel tasks")
    e.add_argument("source")
    e.add_argument("destination")
    e.add_argument("--delete", type=episode_selection, default=[])
    e.add_argument("--drop", action="append", default=[])
    e.add_argument("--task", action="append", default=[], metavar="EPISODE=TEXT")
    e.add_argument("--overwrite", action="store_true")
    v = sub.add_parser("validate", help="check a dataset against its metadata")
    v.add_argument("source")
    v.add_argument("--deep", action="store_true")
    k = sub.add_parser("compare", help="whether two datasets say the same")
    k.add_argument("left")
    k.add_argument("right")
    k.add_argument("--no-data", action="store_true")
    k.add_argument("--videos", action="store_true", help="compare the videos' packets too")
    i = sub.add_parser("inspect", help="the first episodes of a dataset")
    i.add_argument("source")
    i.add_argument("--limit", type=int, default=10)
    h = sub.add_parser("doctor", help="a report on quality")
    h.add_argument("source")
    sub.add_parser("environment", help="versions and optional packages")
    sub.add_parser("sources", help="the known source formats")
    return parser


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[dict[str, Any], bool]:
    """(document, success) of a parsed command."""
    registry = default_registry()
    registry.discover()
    if args.command == "convert":
        source: Any = args.source
        if args.preset:
            source = registry.get("hdf5").open(spark, args.source, presets.load(args.preset).mapping)
        elif args.source_format not in ("auto", "lerobot"):
            provider = registry.get(args.source_format)
            source = provider.open(spark, args.source, provider.config_from_dict(json.loads(args.options)))
        return D.convert(spark, source, args.destination, args.to, data_mb=args.data_mb, video_mb=args.video_mb, overwrite=args.overwrite, deep=args.deep, dry_run=args.dry_run), True
    if args.command == "plan":
        if args.run:
            return plan_and_convert(spark, args.source, args.run, args.to, overwrite=args.overwrite), True
        plan, found = plan_conversion(spark, args.source, args.to)
        return {"plan": plan.to_json(), "profile": dataclasses.asdict(found)}, True
    if args.command == "merge-check":
        report = D.merge_check(spark, args.sources)
        return report.to_json(), report.ok
    if args.command == "gate":
        report = gate(open_dataset(spark, args.source), args.policy, chunk_size=args.chunk_size)
        return report.to_json(), report.ok
    if args.command == "portability":
        report = portability(spark, args.source)
        return report.to_json(), report.ok
    if args.command == "status":
        return JobStore(spark, args.folder).status(), True
    if args.command == "presets":
        return {"presets": [{"name": p.name, "description": p.description} for p in presets.listed()]}, True
    if args.command == "merge":
        return D.merge_datasets(spark, args.sources, args.destination, overwrite=args.overwrite), True
    if args.command == "edit":
        tasks = {int(k): t for k, _, t in (x.partition("=") for x in args.task)}
        return D.edit_dataset(spark, args.source, args.destination, D.EditConfig(tuple(args.delete), tuple(args.drop), tasks), overwrite=args.overwrite), True
    if args.command == "validate":
        report = D.validate(spark, args.source, deep=args.deep)
        return report.to_json(), report.ok
    if args.command == "compare":
        report = D.compare(open_dataset(spark, args.left), open_dataset(spark, args.right), check_data=not args.no_data, check_videos=args.videos)
        return report.to_json(), report.ok
    if args.command == "inspect":
        rows = open_dataset(spark, args.source).episodes.select("episode_index", "length", "tasks").orderBy("episode_index").limit(args.limit).collect()
        return {"episodes": [r.asDict() for r in rows]}, True
    if args.command == "doctor":
        report = doctor(spark, args.source)
        return report, report["ok"]
    if args.command == "environment":
        return environment_report(spark), True
    return {"sources": [{"name": p.name, "aliases": list(p.aliases), "origin": p.origin} for p in registry.infos()]}, True


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from .shipping import ship

    ship(spark)
    try:
        document, ok = run(spark, args)
    except (ValueError, OSError, KeyError, RuntimeError) as error:
        document, ok = {"error": str(error)}, False
    print(json.dumps(document))
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
