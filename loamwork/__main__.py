"""O1: python -m loamwork query NAME --data FOLDER runs a registered query; python -m loamwork run --contigs FASTA --coverage TSV --out FOLDER runs the whole flow."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from loamwork.plans import flow, registry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamwork")
    kinds = p.add_subparsers(dest="kind")
    q = kinds.add_parser("query", help="run a registered query; without a name the names are listed")
    q.add_argument("name", nargs="?")
    q.add_argument("--data", help="a folder of Parquet tables")
    q.add_argument("--out", help="where rows are written as Parquet")
    q.add_argument("--explain", action="store_true", help="print the plan too")
    r = kinds.add_parser("run", help="contigs and coverage to bins")
    r.add_argument("--contigs", required=True)
    r.add_argument("--coverage", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--config", help="settings: JSON, or lines 'name: value'")
    r.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting that overrides the file")
    return p


def main(args: list[str] | None = None) -> None:
    a, known = parser().parse_args(args), registry.queries()
    spark = lambda: SparkSession.builder.appName("loamwork").getOrCreate()
    if a.kind == "run":
        given = dict(flow._line(x.replace("=", ":", 1)) for x in a.set)
        print(json.dumps(flow.run(spark(), a.contigs, a.coverage, a.out, flow.load_settings(a.config, **given)), default=str))
        return
    if a.kind != "query" or not a.name:
        print("\n".join(sorted(known)))
        return
    if a.name not in known:
        raise SystemExit(f"no query {a.name}")
    rows = known[a.name](spark(), a.data)
    if a.explain:
        rows.explain("formatted")
    if a.out:
        rows.write.parquet(a.out)
    else:
        rows.show()


if __name__ == "__main__":
    main()
