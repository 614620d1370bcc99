"""Command line: list the queries, run one, check bars, publish or verify a table."""

from __future__ import annotations

import argparse

from tickloom.session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tickloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out", help="Parquet folder; else the first rows are shown")
    check = sub.add_parser("check", help="check a Parquet table of bars against the contract")
    check.add_argument("path")
    check.add_argument("--timeframe")
    check.add_argument("--duplicates", choices=["raise", "drop_identical"], default="raise")
    ingest = sub.add_parser("ingest", help="publish the bars of ZIP archives of one year")
    ingest.add_argument("archives")
    ingest.add_argument("to")
    ingest.add_argument("--year", type=int, required=True)
    ingest.add_argument("--as-of", required=True)
    verify = sub.add_parser("verify", help="check a published table against its manifest")
    verify.add_argument("path")
    args = parser.parse_args(argv)

    from tickloom.plans.catalog import QUERIES

    if args.command == "list":
        print("\n".join(QUERIES))
        return 0
    spark = session()
    if args.command == "run":
        if args.name not in QUERIES:
            parser.error(f"no query {args.name!r}; `list` names them")
        df = QUERIES[args.name](spark, args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(20, truncate=False)
    elif args.command == "check":
        from tickloom.operators.validate import BarContractError, validate_bars

        try:
            print(validate_bars(spark.read.parquet(args.path), args.timeframe, args.duplicates).count(), "bars")
        except BarContractError as e:
            print(e)
            return 1
    elif args.command == "ingest":
        from tickloom.sources.archives import ingest as read
        from tickloom.sources.tables import publish

        print(publish(read(spark, args.archives, args.year, args.as_of), args.to, "raw", {"archives": args.archives}, {"year": args.year, "as_of": args.as_of})["version"])
    else:
        from tickloom.sources.tables import read_published

        print(read_published(spark, args.path).count(), "rows as published")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
