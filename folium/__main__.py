"""python -m folium diff | compare | equal BEFORE AFTER, or series FILE FILE ...: exit code 0 equal, 1 different, 2 error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .options import ComparisonError, Limits, Options, exit_code, set_edges


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folium", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("diff", "compare", "equal", "series"):
        c = sub.add_parser(name)
        c.add_argument("files", nargs="+")
        c.add_argument("--page-matching", choices=("index", "sequence"), default="index")
        c.add_argument("--reading-order", choices=("auto", "rows", "columns"), default="auto")
        c.add_argument("--context", type=int, default=3)
        c.add_argument("--max-pages", type=int, default=1000, help="0: no limit")
        c.add_argument("--format", choices=("text", "inline", "json"), default="inline" if name == "series" else "text")
        c.add_argument("--strategy", choices=("baseline", "adjacent"), default="baseline")
        c.add_argument("--output")
        c.add_argument("--exit-zero", action="store_true", help="0 also where the files differ")
    return p


def run(args: argparse.Namespace, spark) -> tuple[str, bool]:
    """What to write, and whether all is equal."""
    from pyspark.sql import functions as F

    from . import api
    from .render import diff_text, set_text

    files = list(args.files)
    if args.command != "series" and len(files) != 2:
        raise ComparisonError("invalid-options", "two files")
    options = Options(
        mode="semantic", render="none", page_matching=args.page_matching, reading_order=args.reading_order, context_lines=args.context,
        limits=Limits(pages=args.max_pages or None),
    )
    if args.command == "equal":
        row = api.is_equal(spark, *files, options).first()
        if row.error:
            raise ComparisonError(row.error, row.error)
        return json.dumps({"equal": row.equal}) + "\n", row.equal
    if args.command == "series":
        ids = [os.path.splitext(os.path.basename(f))[0] or f for f in files]
        set_edges(ids, args.strategy)
        rows = None
        for name, f in zip(ids, files, strict=True):
            one = api.revisions(spark, f, options.limits).withColumn("revision_id", F.lit(name))
            rows = one if rows is None else rows.unionByName(one)
        if bad := rows.filter("error is not null").select("error", "message").first():
            raise ComparisonError(bad.error, bad.message or bad.error)
        result = api.compare_set(rows, ids, options, args.strategy)
        changes = [r.asDict(True) for r in result.changes().orderBy("op_ordinal").collect()]  # of at most 64 files
        equal = bool(result.verdict().first().equal)
        result.close()
        if args.format == "json":
            return json.dumps({"equal": equal, "changes": changes}, default=str) + "\n", equal
        return set_text(list(zip(ids, files, strict=True)), [as_change(c) for c in changes]), equal
    pages = [r.asDict(True) for r in api.compare(spark, *files, options).orderBy("pair_index").collect()]  # within the limit of pages
    if pages and pages[0]["error"]:
        raise ComparisonError(pages[0]["error"], pages[0]["message"] or pages[0]["error"])
    pages = [p for p in pages if p["pair_index"] is not None]
    equal = all(p["status"] == "equal" for p in pages)
    if args.command == "compare" or args.format == "json":
        return json.dumps({"equal": equal, "pages": pages}, default=str) + "\n", equal
    return diff_text(pages, *files, sided=args.format == "inline"), equal


def as_change(c: dict) -> dict:
    """A change operation's row as the renderer takes it: one comparison per edge, in their order."""
    first = {e["place"]["edge_index"]: e for e in reversed(c["evidence"])}
    diffs = [{"from": e["from_revision"], "to": e["to_revision"], "hunks": e["hunks"]} for _, e in sorted(first.items())]
    return c | {"comparisons": diffs, "visual": None if c["changed_pixels"] is None else {"changed_pixels": c["changed_pixels"], "changed_ratio": 0.0}}


def main(argv: list[str] | None = None, spark=None) -> int:
    args = arguments().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("folium").getOrCreate()
    try:
        text, equal = run(args, spark)
    except ComparisonError as e:
        print(json.dumps(e.record()), file=sys.stderr)
        return exit_code(None, e.code)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)
    return exit_code(equal, None, not args.exit_zero)


if __name__ == "__main__":
    sys.exit(main())
