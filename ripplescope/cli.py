"""python -m ripplescope check|test|init: the analysis of exported diffs, tests for them, a first configuration."""
from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplescope.functions import globs
from ripplescope.operators import test_mapping
from ripplescope.plans import analyze, report
from ripplescope.plans.storage import settled
from ripplescope.sources import cache, config, diffs, project


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="ripplescope", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("check", "the whole report"), ("test", "tests for the changes")):
        sub = commands.add_parser(name, help=what)
        sub.add_argument("--diffs", required=True, help="folder of *.diff and *.patch files, one change set each; or of such folders: staged, last-commit, refs/REF")
        sub.add_argument("--project", required=True, help="folder of the project's sources")
        source = sub.add_mutually_exclusive_group()
        source.add_argument("--staged", action="store_true", help="the diffs of the index (what holds without a choice)")
        source.add_argument("--last-commit", action="store_true", help="the diffs of the last commit")
        source.add_argument("--diff", metavar="REF", help="the diffs against a ref")
        sub.add_argument("--ignore", action="append", default=[], help="one more pattern of files to leave out")
        sub.add_argument("--json", action="store_true")
        sub.add_argument("--out", help="folder for the results as Parquet, instead of standard output")
        sub.add_argument("--cache", action="store_true", help="keep the file graph in the project's folder")
    check, test = commands.choices["check"], commands.choices["test"]
    check.add_argument("--scope", help="what the changes are meant to do")
    check.add_argument("--messages", help="folder of CHANGESET.head.txt and CHANGESET.pending.txt")
    check.add_argument("--fail-on", choices=("safe", "review", "danger", "never"))
    check.add_argument("--sarif", action="store_true")
    check.add_argument("--markdown", action="store_true")
    check.add_argument("--no-color", action="store_true")
    test.add_argument("--command-only", action="store_true")
    commands.add_parser("init", help="write a configuration file").add_argument("--project", required=True)
    return parser


def _changes(spark: SparkSession, args: argparse.Namespace, ignore: tuple[str, ...]) -> DataFrame | None:
    """The changes of the chosen source without ignored ones; None, after a word about it, if there are none."""
    at = diffs.place(args.diffs, args.last_commit, args.diff)
    if not (args.staged or args.last_commit or args.diff) and not _exists(spark, at):
        at = args.diffs  # a plain folder of diffs
    changes = diffs.parse(diffs.read(spark, at))
    if changes.isEmpty():
        print("No changes found.")
        return None
    changes = changes.filter(~globs.user_ignored(F.col("file_path"), list(ignore))) if ignore else changes
    if changes.isEmpty():
        print("All changes filtered by ignore patterns.")
        return None
    return changes


def _exists(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "init":
        try:
            print(f"Created {config.init(args.project)}")
        except FileExistsError as e:
            print(e)
            return 1
        return 0
    spark = SparkSession.builder.appName("ripplescope").getOrCreate()
    settings = config.find(args.project)
    ignore = (*settings.ignore, *args.ignore)
    changes = _changes(spark, args, ignore)
    if changes is None:
        return 0
    files = project.read(spark, args.project)
    edges = cache.edges(spark, args.project, files) if args.cache else project.edges(files.select("path", "source"))
    files = files.select("path", "source")
    if args.command == "test":
        found = test_mapping.suggest(changes, files, edges, settings.test_directories, settings.test_patterns)
        if args.command_only:
            return _show(test_mapping.command(found, settings.test_command), args.out) or 0
        return _show((report.tests_json if args.json else report.tests_text)(changes, found, settings.test_command), args.out) or 0
    settings = analyze.Config(**{**settings.__dict__, "ignore": (), "fail_on": args.fail_on})
    said = F.lit(config.prompt(args.project, settings.prompt_files)).alias("prompt"), F.lit(args.scope).cast("string").alias("cli_scope")
    inputs = changes.select("change_set_id").distinct().select("change_set_id", *said)
    if args.messages:
        inputs = inputs.join(diffs.messages(spark, args.messages), "change_set_id", "left").fillna("", ["head_message", "pending_message"])
    else:
        inputs = inputs.withColumns({"head_message": F.lit(""), "pending_message": F.lit("")})
    reports = settled(analyze.analyze(changes, inputs, files, edges, settings, listing=project.listing(spark, args.project).select("path")))  # shown, and asked for the exit code
    color = not args.no_color and not os.environ.get("NO_COLOR") and os.isatty(1)
    form = "sarif" if args.sarif else "json" if args.json else "markdown" if args.markdown else "terminal"
    _show(report.terminal(reports, color) if form == "terminal" else getattr(report, form)(reports), args.out)
    return reports.agg(F.coalesce(F.max("report.exit_code"), F.lit(0))).head()[0]


def _show(rows: DataFrame, out: str | None) -> None:
    if out:
        rows.write.mode("overwrite").parquet(out)
        return
    for row in rows.orderBy("change_set_id").toLocalIterator():
        print(row[1])
