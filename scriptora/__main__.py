"""python -m scriptora TEXT | --file PATH | -: languages and script features, one JSON object a text."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from scriptora.plans import service

    parser = argparse.ArgumentParser(prog="scriptora", description=__doc__)
    parser.add_argument("text", nargs="*", help="texts; - reads one a line from standard input")
    parser.add_argument("--file", help="a file or folder, one text a file")
    parser.add_argument("--raw", action="store_true", help="identify without cleaning")
    parser.add_argument("--no-script", action="store_true", help="leave out the script analysis")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("scriptora").getOrCreate()
    if given.file:
        df = spark.read.text(given.file, wholetext=True).withColumnRenamed("value", "text")
    else:
        texts = [x.strip() for x in sys.stdin] if given.text == ["-"] else given.text
        df = spark.createDataFrame([(x,) for x in texts if x], "text string")
    for row in service.identify(df, clean=not given.raw, with_scripts=not given.no_script).toJSON().toLocalIterator():
        print(row)


if __name__ == "__main__":
    main()
