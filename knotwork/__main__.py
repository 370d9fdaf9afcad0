"""Python -m knotwork COMMAND: cases from folders or files, their analysis, paths, exports and seals.

case FOLDER -o OUT, extract FILE... -o OUT (with --register, --calls, --book FILE=OWNER, --names), analyse CASE,
path CASE FROM TO, export CASE --format F -o OUT, verify CASE. CASE is a folder that case or extract wrote; analyse, path
and export also take a graph's document, alone (.json) or in a saved page (.html).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .cases import analysing, building, graphs, reporting
from .operators import export
from .operators.memo import Memo, files_key


def _written(case: building.Case, out: str) -> None:
    reporting.save(case, out)
    reporting.seal(case).write.mode("overwrite").json(f"{out}/seal")
    print(reporting.console(case, reporting.analyse(case)))
    print(f"written to {out}")


def _is_document(path: str) -> bool:
    return path.lower().endswith((".json", ".html", ".htm"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="knotwork", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("case")
    c.add_argument("folder")
    e = sub.add_parser("extract")
    e.add_argument("files", nargs="*")
    for option in ("--register", "--calls", "--names"):
        e.add_argument(option)
    e.add_argument("--book", action="append", default=[], help="an address book, FILE or FILE=OWNER; may be given again")
    for x in (c, e):
        x.add_argument("-o", "--out", required=True)
    a = sub.add_parser("analyse")
    a.add_argument("--without-inferred", action="store_true")
    w = sub.add_parser("path")
    x = sub.add_parser("export")
    for q in (a, w, x, sub.add_parser("verify")):
        q.add_argument("case")
    w.add_argument("start")
    w.add_argument("end")
    w.add_argument("--stated", action="store_true", help="without what is only named together")
    x.add_argument("--format", default="stix")
    x.add_argument("-o", "--out", required=True)
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        if args.command == "case":
            _written(building.build(spark, [building.folder(args.folder)]), args.out)
        elif args.command == "extract":
            if not (args.files or args.calls or args.book):
                raise ValueError("give a report, --calls or --book")
            books = tuple((f, o.strip() or None) for f, _, o in (b.partition("=") for b in args.book))
            names = building.dictionary(spark, args.names) if args.names else []
            _written(building.build(spark, [building.Files("case", "", tuple(args.files), args.register, args.calls, books)], names=names), args.out)
        else:
            alone = _is_document(args.case)
            case = graphs.read(spark, args.case) if alone else reporting.load(spark, args.case)
            if args.command == "analyse":
                key = files_key(spark, *(f"{args.case}/{t}" for t in ("links", "entities")))
                classes = analysing.STATED if args.without_inferred else analysing.ALL
                print(reporting.report(case, reporting.analyse(case, classes, None if alone else Memo(spark, f"{args.case}/memo"), key)))
            elif args.command == "path":
                start, end = (analysing.one(case, t) for t in (args.start, args.end))
                print(reporting.sentence(case, analysing.path(case.links, start, end, args.stated), start))
            elif args.command == "export":
                if args.format == "json":
                    reporting.save(case, args.out)
                documents = {"graph": "case.json", "page": "case.html"}
                if args.format in documents:
                    made = {documents[args.format]: graphs.document(case, page=args.format == "page")}
                else:
                    made = reporting.lines(case, args.format) if args.format != "json" else {}
                for name, rows in made.items():
                    if args.format in ("bundle", *documents):
                        export.write_document(rows, f"{args.out}/parts")
                        export.concatenate(spark, f"{args.out}/parts", f"{args.out}/{name}")
                    else:
                        rows.write.mode("overwrite").text(f"{args.out}/{name}")
            else:
                r = reporting.verify(case, spark.read.schema("content string, n long, root string").json(f"{args.case}/seal")).first()
                print(f"{r.state} ({r.delta:+d} rows)")
                return 0 if r.state == "intact" else 2
    except (ValueError, FileNotFoundError) as err:
        print(err, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
