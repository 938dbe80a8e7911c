"""Run named result tables from the command line.

    python -m cohortspark list
    python -m cohortspark run fig3a_distribution --data DIR --out DIR [--format csv|parquet]
    python -m cohortspark batch --assay FILE --subjects FILE --out DIR   (all tables of Figures 3, 4)
    python -m cohortspark run fig3a_distribution --assay FILE --subjects FILE
        [--input-format csv|parquet] [--cutoff 40] [--plot-floor 0.01] [--test-floor 0.1]
        [--panel3 NC,M,SCT] [--panel4 NC,M,SCT,SNT] [--quarantine DIR] --out DIR

``--data`` names a folder of test tables, ``--assay`` and ``--subjects`` real
assay data.  The whole table is written to ``--out`` or, without it, printed
row by row as tab-separated text.  A CSV row that does not fit its table's
schema fails the run, or goes to ``--quarantine`` and is left out.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from .plans.batch import write_tables
from .plans.context import Inputs, StudyInputs
from .plans.registry import BUILDERS, QUERIES
from .session import build_session, scale_settings
from .sources.io import write_result


def _parameters(base, args):
    given = {name: getattr(args, name) for name in ("cutoff", "plot_floor", "test_floor")
             if getattr(args, name) is not None}
    given |= {name: getattr(args, name).split(",") for name in ("panel3", "panel4")
              if getattr(args, name)}
    return replace(base, **given)


def _input_arguments(run) -> None:
    run.add_argument("--data", help="folder of test tables")
    run.add_argument("--assay", help="assay table: lab_id, antigen, value, visit_date")
    run.add_argument("--subjects", help="subject table")
    run.add_argument("--input-format", default="parquet", choices=["csv", "parquet"])
    run.add_argument("--quarantine", help="folder for CSV rows that do not fit the schema")
    for name in ("cutoff", "plot-floor", "test-floor"):
        run.add_argument(f"--{name}", type=float)
    for name in ("panel3", "panel4"):
        run.add_argument(f"--{name}", help="analytes, comma-separated")
    run.add_argument("--out")
    run.add_argument("--format", default="csv", choices=["csv", "parquet"])
    run.add_argument("--master")
    run.add_argument("--shuffled-bytes", type=int, help="size the session for this much data")
    run.add_argument("--cores", type=int, default=8, help="cores of the cluster, for sizing")


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="cohortspark")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the registered result tables")
    one = sub.add_parser("run", help="compute one result table")
    one.add_argument("key", choices=sorted(QUERIES))
    many = sub.add_parser("batch", help="write all tables of Figures 3 and 4 from one read")
    for run in (one, many):
        _input_arguments(run)
    args = ap.parse_args(argv)

    if args.cmd == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if bool(args.data) == bool(args.assay and args.subjects):
        ap.error("give --data, or --assay and --subjects")
    spark = build_session(args.master, extra=scale_settings(args.shuffled_bytes, args.cores)
                          if args.shuffled_bytes else None)
    inp = (Inputs(spark, args.data) if args.data else
           StudyInputs.read(spark, args.assay, args.subjects, args.input_format,
                            quarantine=args.quarantine))
    inp.parameters = _parameters(inp.parameters, args)
    if args.cmd == "batch":
        if not args.out:
            ap.error("give --out")
        for key, path in write_tables(spark, inp, args.out, fmt=args.format).items():
            print(f"{key}\t{path}")
        return 0
    df = BUILDERS[args.key](inp)
    if args.out:
        write_result(df, args.out, args.format)
    else:
        print("\t".join(df.columns))
        for row in df.toLocalIterator():  # partition by partition, nothing left out
            print("\t".join("" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
