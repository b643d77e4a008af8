"""python -m pagewarden.plans.cli --config DIR (--responses FILE | --client MODULE:FUNCTION) --state DIR [--report FILE]: one run over recorded or live answers."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib

from pyspark.sql import SparkSession

from pagewarden.functions.urls import Policy
from pagewarden.plans import crawl, daily, report
from pagewarden.sources import config, workbook
from pagewarden.sources.state import State, read_fixture
from pagewarden.sources.transport import RESPONSE

SCHEMA = f"target_id string, {RESPONSE}"


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: all sources were read; 2: some failed, and the baseline stays; 1: the run can't be made."""
    p = argparse.ArgumentParser()
    p.add_argument("--config", required=True)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--responses", help="a JSON array of answers")
    source.add_argument("--client", help="module:function that answers a URL; pages are asked for breadth first, each host in turn, within the configured limits")
    p.add_argument("--state", required=True, help="a folder of any Hadoop file system")
    p.add_argument("--report", help="a workbook to write")
    p.add_argument("--target", default="all")
    p.add_argument("--crawl", action="store_true", help="follow links within a site, too")
    p.add_argument("--force", action="store_true", help="don't use cached checks")
    p.add_argument("--at", type=dt.datetime.fromisoformat, default=None)
    a = p.parse_args(args)
    try:
        held = config.load(a.config)
    except config.ConfigError as e:
        print(e)
        return daily.FAILED
    spark = spark or SparkSession.builder.getOrCreate()
    at = a.at or dt.datetime.now().replace(microsecond=0)
    targets = config.targets_frame(spark, held)
    if a.target != "all":
        targets = targets.where(targets.target_id == a.target)
    state = State(spark, a.state)
    if a.client:
        module, _, name = a.client.partition(":")
        limits, policy = held.rules["crawl"], Policy.of(held.exclusions)
        rounds = f"{state.root}/crawls/{at.strftime('%Y%m%dT%H%M%S')}"
        answers = crawl.crawl(targets, getattr(importlib.import_module(module), name), rounds, budget=int(limits["max_urls"]), interval=float(limits["request_interval_seconds"]), retries=int(limits.get("max_retries", 1)), policy=policy).drop("depth", "turn")
    else:
        answers = read_fixture(spark, a.responses, SCHEMA).join(targets.select("target_id"), "target_id", "left_semi")
    run = daily.run(answers, targets, rules=held.rules, exclusions=held.exclusions, at=at, old=daily.loaded(state), crawl=a.crawl, force=a.force)
    code = daily.saved(state, run, at.isoformat())
    if a.report:
        workbook.save(report.frames(run, at), a.report)
    run.release()
    return code


if __name__ == "__main__":
    raise SystemExit(main())
