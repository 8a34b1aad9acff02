"""python -m utterline COMMAND --folder F --config C [--provider module:function]"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import asdict

from .plans import stages


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="utterline")
    p.add_argument("command", choices=["run-all", "detect-criteria", "llm-process", "report", "status", "validate-config"])
    p.add_argument("--folder")
    p.add_argument("--config")
    p.add_argument("--provider")
    a = p.parse_args(argv)
    config = stages.validate(a.config) if a.config else stages.Config()
    if a.command == "validate-config":
        print(json.dumps(asdict(config), ensure_ascii=False))
        return 0
    if not a.folder:
        p.error("--folder is needed")
    if a.command == "llm-process" and not a.provider:
        p.error("--provider is needed")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("utterline").getOrCreate()
    provider = stages.provider_of(a.provider) if a.provider else None
    if a.command == "run-all":
        stages.run_all(spark, a.folder, config, provider)
    elif a.command == "detect-criteria":
        stages.detect_criteria(spark, a.folder, config)
    elif a.command == "llm-process":
        stages.llm_process(spark, a.folder, config, provider)
    elif a.command == "report":
        stages.report(spark, a.folder, config)
    print(json.dumps(stages.status(spark, a.folder)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
