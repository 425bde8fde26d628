"""extract, detect and split from the command line: python -m foliospark.cli VERB ..."""

from __future__ import annotations

import argparse
import os
import sys

from foliospark import config as C
from foliospark import report
from foliospark.errors import PARTIAL_FAILURE, EngineError


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliospark", description=__doc__)
    p.add_argument("-c", "--config", action="append", default=[])
    p.add_argument("--format", choices=("text", "json"))
    sub = p.add_subparsers(dest="verb", required=True)
    e = sub.add_parser("extract")
    e.add_argument("inputs", nargs="*")
    e.add_argument("--indir")
    e.add_argument("-o", "--outdir")
    e.add_argument("--stdout", action="store_true")
    e.add_argument("--force", action="store_true")
    d = sub.add_parser("detect")
    d.add_argument("inputs", nargs="*")
    d.add_argument("--indir")
    s = sub.add_parser("split")
    s.add_argument("input")
    s.add_argument("-o", "--outdir")
    s.add_argument("--subdir")
    s.add_argument("--name")
    front = s.add_mutually_exclusive_group()
    front.add_argument("--front")
    front.add_argument("--no-front", action="store_true")
    s.add_argument("--force", action="store_true")
    return p


def _inputs(spark, args, cfg):
    """(files, missing ids): named files as they are, names without a file by lookup, or the whole folder."""
    from foliospark.sources import files

    folder = args.indir or cfg.input_dir
    if not args.inputs:
        return files.directory(spark, folder, required=args.indir is not None), []
    paths = [i for i in args.inputs if os.path.exists(i)]
    ids = [i for i in args.inputs if not os.path.exists(i)]
    named = [f for i in ids if (f := next((f"{folder}/{i}.{x}" for x in files.EXTENSIONS if os.path.exists(f"{folder}/{i}.{x}")), None))]
    missing = [i for i in ids if not any(os.path.basename(f).rsplit(".", 1)[0] == i for f in named)]
    every = paths + named
    empty = spark.createDataFrame([], "path string, id string, ext string, length long, content binary")
    return (files.raw(spark, every, scan=False) if every else empty), missing


def _extract(spark, args, cfg, as_json: bool) -> int:
    from pyspark.sql import functions as F

    from foliospark.operators.epub import extract_books
    from foliospark.operators.extract import extract_documents
    from foliospark.sources import files, sinks

    found, missing = _inputs(spark, args, cfg)
    outdir = args.outdir or cfg.output_dir
    todo, skip = (found, found.limit(0)) if args.stdout else sinks.pending(files.one_per_id(found, args.force), outdir, args.force)
    texts = files.as_text(todo.filter("ext <> 'epub'"))
    done = extract_documents(texts.filter("reason is null"), cfg).unionByName(extract_books(todo.filter("ext = 'epub'").select("id", "content"), cfg)).persist()
    if args.stdout:
        for r in done.orderBy("id").select("markdown", "id", "reason").toLocalIterator():
            print(r.markdown if r.markdown is not None else f"  FAIL {r.id}: {r.reason}", file=sys.stdout if r.markdown is not None else sys.stderr)
        return PARTIAL_FAILURE if missing or done.filter("status = 'failed'").count() else 0
    os.makedirs(outdir, exist_ok=True)
    path = sinks.output_path(outdir)
    sinks.write_files(done.filter("status = 'ok'").select(path.alias("path"), F.col("markdown").alias("content")), True)
    none = F.lit(None).cast("string")
    rows = done.select("id", "source_format", F.when(F.col("status") == "ok", path).alias("output_path"), "bytes", "status", "reason")
    rows = rows.unionByName(skip.select("id", F.lit("skipped").alias("source_format"), path.alias("output_path"), F.lit(0).cast("long").alias("bytes"), F.lit("skipped").alias("status"), none.alias("reason")))
    rows = rows.unionByName(texts.filter("reason is not null").select("id", F.lit("unknown").alias("source_format"), none.alias("output_path"), F.lit(0).cast("long").alias("bytes"), F.lit("failed").alias("status"), "reason"))
    listed = [r.asDict() for r in report.missing_rows(spark.createDataFrame([(m,) for m in missing], "id string")).collect()] + [r.asDict() for r in rows.orderBy("id").toLocalIterator()]
    counts = {s: sum(r["status"] == s for r in listed) for s in ("ok", "skipped", "failed")}
    if as_json:
        print(report.envelope(listed))
    else:
        print("\n".join([report.text_row(r["id"], r["status"], r["bytes"], r["reason"]) for r in listed] + [report.summary(*counts.values())]))
    return PARTIAL_FAILURE if counts["failed"] else 0


def _detect(spark, args, cfg, as_json: bool) -> int:
    from foliospark.operators.extract import detect_documents
    from foliospark.sources.files import as_text

    found, missing = _inputs(spark, args, cfg)
    rows = [r.asDict() for r in detect_documents(as_text(found), cfg).orderBy("path").toLocalIterator()]
    rows += [{"id": m, "path": m, "format": "unknown", "status": "failed", "reason": "not found"} for m in missing]
    print(report.envelope(rows) if as_json else "\n".join(f"{r['id']}: {r['format'] if r['status'] == 'ok' else 'not found'}" for r in rows))
    return PARTIAL_FAILURE if missing else 0


def _split(spark, args, cfg, as_json: bool) -> int:
    from dataclasses import replace

    from foliospark.operators.epub import extract_books
    from foliospark.operators.split import split_errors, split_files
    from foliospark.sources import files, sinks

    if not os.path.exists(args.input):
        raise EngineError("not_found", f"{args.input} does not exist")
    given = {k: v for k, v in (("subdir", args.subdir), ("file", args.name), ("front", "" if args.no_front else args.front)) if v is not None}
    if args.input.endswith(".epub"):
        out = extract_books(files.raw(spark, [args.input], scan=False).select("id", "content"), cfg)
        if failed := out.filter("status = 'failed'").select("reason").first():
            raise EngineError("extraction_failed", failed.reason)
        books = out.select(out.id.alias("book"), "markdown")
    else:
        books = files.markdown(spark, [args.input])
    if bad := split_errors(books).first():
        raise EngineError(bad.kind, bad.message)
    written = split_files(books, replace(cfg.split, **given), args.outdir or cfg.output_dir).persist()
    sinks.write_files(written, args.force)
    rows = [r.asDict() for r in written.select("index", "title", "path", "bytes").orderBy("index").toLocalIterator()]
    print(report.envelope(rows) if as_json else "\n".join(f"  OK   {r['path']} ({r['bytes'] // 1024}KB)" for r in rows))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    as_json = args.format == "json" or (args.format is None and not sys.stdout.isatty())
    try:
        cfg = C.layered(*args.config)
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("foliospark").getOrCreate()
        return {"extract": _extract, "detect": _detect, "split": _split}[args.verb](spark, args, cfg, as_json)
    except EngineError as e:
        print(e.to_json() if as_json else f"error: {e.message}" + (f"\nhint: {e.hint}" if e.hint else ""), file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
