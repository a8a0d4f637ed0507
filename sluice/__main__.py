"""Command line: ``python -m sluice {ingest,run,plan} ...``.

* ``ingest ROOT``   config folder -> problems report -> metadata tables
* ``run NAME``      run one declared pipeline from the metadata tables (batch or stream)
* ``plan``          inventory vs deployed pipelines/jobs -> create/update/delete plan tables

The session comes from ``spark-submit`` (or a local one when run directly).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    from sluice.session import build_session
    active = SparkSession.getActiveSession()
    return active if active is not None else build_session()


def _tables(spark, database):
    return [spark.table(f"{database}.{s}") for s in ("sources", "transformations", "destinations")]


def cmd_ingest(args) -> int:
    from sluice.plans.ingest import load_configs, write_metadata
    spark = _session()
    res = load_configs(spark, args.root, strict_xor=args.strict)
    problems = res.problems.limit(args.max_problems).collect()
    for p in problems:
        print(f"{p['kind']}: {p['path']}: {p['detail']}", file=sys.stderr)
    if problems:
        print(f"{res.problems.count()} problem(s), {len(problems)} shown", file=sys.stderr)
        return 1
    if not args.dry_run:
        write_metadata(spark, res, args.database)
    return 0


def cmd_run(args) -> int:
    from sluice.plans.runner import PipelineRun, PipelineSpec, run_stream
    from sluice.sources.settings import run_mode
    spark = _session()
    spec = PipelineSpec.from_tables(*_tables(spark, args.database), args.name, args.schema, args.catalog)
    if args.stream:
        continuous = args.continuous
        if not continuous and spark.catalog.tableExists(f"{args.database}.pipeline_settings"):
            continuous = run_mode(spark.table(f"{args.database}.pipeline_settings"), args.name, args.schema, args.catalog)
        run_stream(spark, spec, args.checkpoint, stream_target=args.streams or None, continuous=continuous,
                   full_refresh=args.full_refresh, audit_path=args.audit).awaitTermination()
    else:
        run = PipelineRun(spark, spec, checkpoint_failable=args.checkpoint_fail_stages,
                          count_logged=args.audit is not None)
        run.run(full_refresh=args.full_refresh)
        if args.audit:
            run.write_audit(args.audit)
    return 0


def cmd_plan(args) -> int:
    from sluice.plans.deploy import build_deploy_plan
    spark = _session()
    deployed = spark.read.parquet(args.deployed)
    jobs = spark.read.parquet(args.jobs) if args.jobs else spark.createDataFrame(
        [], "job_name string, job_id string, pipeline_id string")
    plan = build_deploy_plan(spark, *_tables(spark, args.database), deployed, jobs,
                             destructive=not args.non_destructive)
    plan.pipelines.write.mode("overwrite").parquet(f"{args.out}/pipelines")
    plan.jobs.write.mode("overwrite").parquet(f"{args.out}/jobs")
    return 0


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="python -m sluice")
    sub = ap.add_subparsers(dest="cmd", required=True)

    p = sub.add_parser("ingest", help="config folder -> metadata tables")
    p.add_argument("root")
    p.add_argument("--database", default="sluice")
    p.add_argument("--dry-run", action="store_true", help="only report problems")
    p.add_argument("--strict", action="store_true", help="strict mapping-xor-SQL check")
    p.add_argument("--max-problems", type=int, default=100)
    p.set_defaults(fn=cmd_ingest)

    p = sub.add_parser("run", help="run one pipeline")
    p.add_argument("name")
    p.add_argument("--database", default="sluice")
    p.add_argument("--schema")
    p.add_argument("--catalog")
    p.add_argument("--stream", action="store_true")
    p.add_argument("--checkpoint", help="checkpoint folder for --stream")
    p.add_argument("--streams", nargs="*", help="targets of the streamed sources with --stream (default: the first)")
    p.add_argument("--continuous", action="store_true", help="run on; by default as the pipeline's settings file says")
    p.add_argument("--full-refresh", action="store_true")
    p.add_argument("--checkpoint-fail-stages", action="store_true")
    p.add_argument("--audit", help="append the rule counts (batch or per micro-batch) to this path")
    p.set_defaults(fn=cmd_run)

    p = sub.add_parser("plan", help="create/update/delete plan")
    p.add_argument("--database", default="sluice")
    p.add_argument("--deployed", required=True, help="parquet of (name, pipeline_id)")
    p.add_argument("--jobs", help="parquet of (job_name, job_id, pipeline_id)")
    p.add_argument("--non-destructive", action="store_true")
    p.add_argument("--out", required=True)
    p.set_defaults(fn=cmd_plan)

    args = ap.parse_args(argv)
    if args.cmd == "run" and args.stream and not args.checkpoint:
        ap.error("--stream needs --checkpoint")
    return args.fn(args)


if __name__ == "__main__":
    sys.exit(main())
