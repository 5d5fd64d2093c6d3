"""python -m chronoloom list | run NAME SF_DIR [OUT]: lists the library's queries, or runs one and shows or writes its rows."""

from __future__ import annotations

import argparse


def main() -> None:
    from .plans import catalog

    parser = argparse.ArgumentParser(prog="chronoloom", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(catalog.queries()))
    run.add_argument("sf_dir")
    run.add_argument("out", nargs="?")
    given = parser.parse_args()
    if given.what == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    from pyspark.sql import SparkSession

    found = catalog.queries()[given.name](SparkSession.builder.appName("chronoloom").getOrCreate(), given.sf_dir)
    if given.out:
        found.write.mode("errorifexists").parquet(given.out)
    else:
        found.show(20, False)


if __name__ == "__main__":
    main()
