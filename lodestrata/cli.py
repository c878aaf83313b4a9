"""python -m lodestrata.cli IMAGE COMMAND: list, find, textures, export, manifest, banks, status, revert."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import audio
from lodestrata.operators import bulk, naming
from lodestrata.operators.journal import Patcher
from lodestrata.sources import disc


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("image")
    parser.add_argument("command", choices=["list", "categories", "find", "textures", "export", "manifest", "bank", "status", "revert"])
    parser.add_argument("argument", nargs="?", help="a name to find, an entry, or an output folder")
    args = parser.parse_args(argv)
    if args.command == "status":
        p = Patcher(args.image)
        print(f"{p.pending()} edited places")
        for offset, x in sorted(p.entries.items()):
            print(f"{offset:#x} {x['len']} {x['note']}")
        return
    if args.command == "revert":
        print(f"{Patcher(args.image).revert()} places restored")
        return
    spark = SparkSession.builder.appName("lodestrata").getOrCreate()
    entries = bulk.open_archive(spark, args.image)
    if args.command == "list":
        entries.drop("head").orderBy("idx").show(10_000, False)
    elif args.command == "categories":
        entries.groupBy("category").count().orderBy("category").show(100, False)
    elif args.command == "find":
        entries.drop("head").where(F.lower("name").contains(args.argument.lower()) | (F.col("idx").cast("string") == args.argument)).show(100, False)
    elif args.command == "textures":
        bulk.manifest(spark, args.image, F.col("idx") == int(args.argument)).show(1000, False)
    elif args.command == "export":
        bulk.export_textures(spark, args.image, args.argument).groupBy(F.col("error").isNull().alias("ok")).agg(F.count("*").alias("entries"), F.sum("files").alias("files")).show()
    elif args.command == "manifest":
        bulk.manifest(spark, args.image).write.mode("overwrite").json(args.argument)
    elif args.command == "bank":
        archive = disc.Archive.open(args.image)
        row = naming.first_entry(entries.withColumnRenamed("idx", "index"), spark.createDataFrame([(args.argument,)], "name string")).first()
        with disc.open_path(args.image) as f:
            _, _, size, _, offset = archive.records(f, row["index"], row["index"] + 1)[0]
            for s in audio.parse_bank(archive.read(f, offset, size))[0]:
                print(s)


if __name__ == "__main__":
    main()
