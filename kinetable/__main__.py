"""python -m kinetable generate|build|score: the end-to-end plans from the command line.

    python -m kinetable generate --folder <exports> --out <folders> [--frames <parquet>] [--config <file>]
    python -m kinetable build --base <folders> --out <folder> [--config <file>]
    python -m kinetable score --responses <parquet> --out <folder>

``score`` reads responses (question_id, model, expected, predicted_letter, correct, tag, response_time) and
writes summaries, comparisons and the responses by model.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import evaluation
from .plans import catalogue_run, config, dataset_build
from .sources import sinks


def main(given: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kinetable", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    generate = jobs.add_parser("generate", help="item folders of exported episodes")
    generate.add_argument("--folder", required=True)
    generate.add_argument("--out", required=True)
    generate.add_argument("--frames")
    generate.add_argument("--config")
    build = jobs.add_parser("build", help="train and test sets of item folders")
    build.add_argument("--base", required=True)
    build.add_argument("--out", required=True)
    build.add_argument("--config")
    score = jobs.add_parser("score", help="summaries and comparisons of responses")
    score.add_argument("--responses", required=True)
    score.add_argument("--out", required=True)
    args = parser.parse_args(given)
    spark = SparkSession.builder.getOrCreate()
    settings = config.load(args.config) if getattr(args, "config", None) else config.Config()
    if args.job == "generate":
        frames = spark.read.parquet(args.frames) if args.frames else None
        catalogue_run.generate(spark, args.folder, args.out, settings.generation, frames).write.mode("overwrite").parquet(f"{args.out}/_written")
        return
    if args.job == "build":
        dataset_build.build(spark, args.base, args.out, settings.build)
        return
    rows = spark.read.parquet(args.responses)
    models = sorted(r["model"] for r in rows.select("model").distinct().collect())
    sinks.write_results(evaluation.results_json(rows), rows, args.out)
    sinks.write_comparison(evaluation.disagreement(rows), evaluation.tag_model_pivot(rows, models), f"{args.out}/comparison")


if __name__ == "__main__":
    main()
