"""An interactive prompt: statements end with a semicolon, results print as pipe-delimited lines."""

from __future__ import annotations

import argparse
import re
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from millrace.plans.statements import split_statements
from millrace.session import Session
from millrace.sources.pipe import lines

PROMPT = "$> "


def repl(session: Session, source: TextIO, out: TextIO, err: TextIO) -> None:
    """Read statements to the end of source, which ends the last one, too. An error is reported and the next statement read."""
    rest = ""
    print(PROMPT, end="", file=out, flush=True)
    for line in source:
        whole, rest = split_statements(rest + line)
        for statement in whole:
            _run(session, statement, out, err)
    if re.sub(r"--[^\n]*|/\*.*?\*/", "", rest, flags=re.DOTALL).strip():
        _run(session, rest.strip(), out, err)


def _run(session: Session, statement: str, out: TextIO, err: TextIO) -> None:
    try:
        if (result := session.execute(statement)) is not None:
            for text in lines(result):
                print(text, file=out)
            print(file=out)
    except Exception as e:  # noqa: BLE001 - the prompt outlives any statement
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=err)
    print(PROMPT, end="", file=out, flush=True)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("--data", default="data", help="folder of <table>.csv files")
    parser.add_argument("--store", default="store", help="folder of the catalog and the stored tables")
    parser.add_argument("--in-mem", action="store_true", help="accepted; Spark's memory manager decides")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    repl(Session(spark, args.data, args.store), sys.stdin, sys.stdout, sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
