"""Output folders for documents, and positions in an order, without bringing rows together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.session import cut


def _deal(group: pd.DataFrame) -> pd.DataFrame:
    """Names in turn: one that is taken gets the next free number."""
    group = group.sort_values(["input", "path"], kind="stable")
    taken, names = set(), []
    for wanted in group["wanted"]:
        name, n = wanted, 1
        while name.lower() in taken:
            n += 1
            name = f"{wanted}-{n}"
        taken.add(name.lower())
        names.append(name)
    return group.assign(folder=names)[["input", "path", "wanted", "folder"]]


def with_folders(jobs: DataFrame, out_dir: str) -> DataFrame:
    """Adds `folder` and `folder_note` (null, or that another input has the same name).

    jobs: with input, path, rel_dir and name. A folder is out_dir/rel_dir/name; of those that differ in case at most,
    the later ones get -2, -3 and so on. Within one input paths differ, so equal names come from as many inputs: only
    names that occur twice, and those that their numbers could hit, are dealt in turn; a group has at most a few rows
    for each input.
    """
    folder = F.concat_ws("/", F.lit(out_dir.rstrip("/")), F.when(F.col("rel_dir") != "", F.col("rel_dir")), F.col("name"))
    named = jobs.select("input", "path", folder.alias("wanted")).withColumn("stem", F.regexp_replace(F.lower("wanted"), r"(-[0-9]+)+$", ""))
    twice = named.groupBy("stem", F.lower("wanted").alias("low")).count().where("count > 1").select("stem").distinct()
    kind = named.schema["path"].dataType.simpleString()
    dealt = named.join(twice, "stem", "left_semi").groupBy("stem").applyInPandas(_deal, f"input int, path {kind}, wanted string, folder string")
    dealt = dealt.select(F.col("input").alias("__input"), F.col("path").alias("__path"), F.col("folder").alias("__folder"))
    joined = jobs.withColumn("__wanted", folder).join(dealt, (F.col("input") == F.col("__input")) & (F.col("path") == F.col("__path")), "left")
    out = joined.withColumn("folder", F.coalesce("__folder", "__wanted"))
    note = F.concat(F.lit("another input has the same name; written to "), F.substring_index("folder", "/", -1), F.lit(" instead"))
    return out.withColumn("folder_note", F.when(F.col("folder") != F.col("__wanted"), note)).drop("__input", "__path", "__folder", "__wanted")


def numbered(df: DataFrame, *keys: str, into: str = "n", total: str = "of") -> DataFrame:
    """Adds each row's position in the order of the keys, from 1, and the number of rows.

    Rows are dealt out by ranges of the keys and counted within their range; only the ranges' sizes meet. Rows with
    equal keys come in any order, but each gets a position of its own.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    ranged = cut(ranged).withColumn("__part", F.shiftright("__id", 33))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    order = Window.orderBy("__part")  # over as many rows as there are partitions
    starts = sizes.select("__part", (F.sum("__size").over(order) - F.col("__size")).alias("__start"), F.sum("__size").over(Window.partitionBy()).alias(total))
    place = (F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(into)
    return ranged.join(F.broadcast(starts), "__part").select(*(F.col(f"`{c}`") for c in df.columns), place, total)
