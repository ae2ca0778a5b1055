"""Command line: ``python -m caseloom``.

    queries                              names of all queries
    run NAME DIR [--out PATH] [--format parquet|json|csv]
                                         runs a query over the tables of a directory; prints it or writes it to a new path
    check NAME DIR                       runs a query whose rows are problems
    overlap DIR                          fails if training and dev records overlap

Exit status: 0 done, 2 wrong arguments or input, 3 problems were found.
"""

from __future__ import annotations

import argparse
import sys

from caseloom.plans import catalog
from caseloom.session import session

#: Queries whose rows are problems.
CHECKS = ("structure_problems", "strict_structure_problems", "response_problems", "binding_problems", "event_problems", "review_plan_problems", "pair_problems", "prediction_problems", "span_problems", "ledger_rebuilt_differs", "repeated_ids", "foreign_predictions", "screened_arm_pairing")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="caseloom", description="Case-corpus queries on Spark")
    parser.add_argument("--master", default=None, help="Spark master; by default that of the environment, else local[*]")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("queries")
    run = verbs.add_parser("run")
    run.add_argument("name")
    run.add_argument("dir")
    run.add_argument("--out")
    run.add_argument("--format", default="parquet", choices=("parquet", "json", "csv", "orc"))
    check = verbs.add_parser("check")
    check.add_argument("name", choices=CHECKS)
    check.add_argument("dir")
    overlap = verbs.add_parser("overlap")
    overlap.add_argument("dir")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    queries = catalog.queries()
    if args.verb == "queries":
        print("\n".join(queries))
        return 0
    name = {"overlap": "train_dev_disjointness"}.get(args.verb) or args.name
    if name not in queries:
        print(f"no query {name}", file=sys.stderr)
        return 2
    spark = session("caseloom", args.master)
    try:
        out = queries[name](spark, args.dir)
        if args.verb == "run":
            if args.out:
                out.write.mode("errorifexists").format(args.format).save(args.out)
            else:
                out.show(100, truncate=80)
            return 0
        bad = out.where("n > 0") if args.verb == "overlap" else out
        found = bad.limit(20).collect()
    except (ValueError, OSError) as error:
        print(error, file=sys.stderr)
        return 2
    except Exception as error:  # Spark's own: missing tables, existing output
        print(str(error).split("\n")[0], file=sys.stderr)
        return 2
    for row in found:
        print(row.asDict())
    return 3 if found else 0


if __name__ == "__main__":
    sys.exit(main())
