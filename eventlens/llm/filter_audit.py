"""What each filter of a chain removes, in every order, from one table of failing ids per filter.

Each filter's failing rows are stored as an id table. For each set of filters that may stand before another (a
prefix; its order does not matter to what is left) the rows that fail anything are split into survivors and gone
ones: the prefix one filter longer loses what a left-semi join with that filter's table meets and keeps what a
left-anti join leaves. A last left-semi join with each table then tells, of what a filter fails, how much was
still there (removed) and how much was gone (redundant). Only ids travel; texts are read once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import WORD, stored
from eventlens.session import new_path

SPACE = WORD.replace("^", "")
FILTERS = ("A", "B", "C", "D", "E")
#: Orders grow with the factorial of the filters, prefixes with two to their number.
MAX_FILTERS = 8


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D on a text without null; `E` needs the whole table."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame) -> DataFrame:
    """uid, doc_id, part, text_hash and the failed filters of A to D of every row, stored; `uid` numbers the rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    failed = [F.when(condition, F.lit(name)) for name, condition in text_failures(text).items()]
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_hash"),
            F.array_compact(F.array(*failed)).alias("failed"),
        ),
        "judged",
    )


def failing(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """uid, part, good, toxic and filter of every failure of `judged` rows, E (an earlier equal text) among them.

    A row is E's unless it is the least doc_id of its text: a left-anti join on text and id, so that no
    number of copies meets in one task. Of several labels of an id one suffices. Null ids never fail E and have no labels.
    """
    first = rows.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
    copies = rows.where("doc_id IS NOT NULL").join(first, ["text_hash", "doc_id"], "left_anti")
    columns = ["uid", "doc_id", "part"]
    each = rows.select(*columns, F.explode("failed").alias("filter")).unionByName(copies.select(*columns, F.lit("E").alias("filter")))
    marks = (
        labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
        .withColumn("spread", F.lit(0).cast("long"))
    )
    # null ids never match; their own number spreads them over the tasks
    spread = F.when(F.col("doc_id").isNull(), F.col("uid")).otherwise(F.lit(0).cast("long"))
    found = each.withColumn("_spread", spread).join(marks, (F.col("doc_id") == F.col("id")) & (F.col("_spread") == F.col("spread")), "left")
    return found.select("uid", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "filter")


def id_tables(found: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
    """One stored table of failing ids per filter; a filter that nothing fails has an empty one."""
    spark, path = found.sparkSession, new_path(found.sparkSession, "failing")
    found.write.partitionBy("filter").parquet(path)
    whole = spark.read.schema(found.schema).parquet(path)
    return {name: whole.where(F.col("filter") == name).drop("filter") for name in names}


def prefixes(tables: dict[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """uid, part, good, toxic, prefix and alive: whether a failing row survives each set of filters but the whole one.

    `prefix` has bit i set for the i-th name. Each round reads what is stored so far and adds the sets that one more filter makes.
    What is stored is read as one frame of several folders: Spark would repeat a join below a union once for each of its sides.
    """
    keys = ["uid", "part", "good", "toxic"]
    spark, paths = tables[names[0]].sparkSession, []

    def so_far() -> DataFrame:
        return spark.read.schema(schema).parquet(*paths)

    def add(frame: DataFrame) -> None:
        paths.append(new_path(spark, "prefixes"))
        frame.write.parquet(paths[-1])

    every = together([tables[name] for name in names]).distinct().select(*keys, F.lit(0).alias("prefix"), F.lit(True).alias("alive"))
    schema = every.schema
    add(every)
    for i, name in enumerate(names):
        shorter = so_far()
        if i == len(names) - 1:
            shorter = shorter.where(F.col("prefix") != (1 << i) - 1)
        ids = tables[name].select("uid")
        longer = F.col("prefix").bitwiseOR(F.lit(1 << i)).alias("prefix")
        gone = shorter.join(ids, "uid", "left_semi").select(*keys, longer, F.lit(False).alias("alive"))
        left = shorter.join(ids, "uid", "left_anti").select(*keys, longer, "alive")
        add(gone.unionByName(left))
    return so_far()


def together(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def orders(names: Sequence[str]) -> list[dict]:
    """A row for each order and step: the filter's number, the set before it and the set with it."""
    found = []
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order, 1):
            found.append({"filter_order": "".join(names[j] for j in order), "step": step, "filter": i, "prefix": before, "after": before | 1 << i})
            before |= 1 << i
    return found


def audited(parts: DataFrame, tables: dict[str, DataFrame], names: Sequence[str] = FILTERS) -> DataFrame:
    """part, filter_order, step, filter and counts for each part, order of `names` and step.

    `parts` has the column part, a row for each row that is filtered; `tables` are `id_tables`. Counts within the part: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley (removed by the filter, summed over all orders). A part without failures has zeros.
    """
    if not 1 <= len(names) <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters, not {len(names)}")
    split = prefixes(tables, names)
    number = [F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "toxic")]
    met = together([split.join(tables[name].select("uid"), "uid", "left_semi").withColumn("filter", F.lit(i)) for i, name in enumerate(names)])
    counted = met.groupBy("part", "filter", "prefix", "alive").agg(F.count("*").alias("n"), *number)
    counts = stored(
        counted.where(F.getbit("prefix", F.col("filter")) == 0)
        .groupBy("part", "filter", "prefix")
        .agg(*[F.coalesce(F.sum(F.when(F.col("alive") == alive, F.col(c))), F.lit(0)).alias(name) for alive, c, name in ((True, "n", "removed"), (False, "n", "redundant"), (True, "good", "good_lost"), (True, "toxic", "toxic_lost"))]),
        "counts",
    )
    survivors = split.groupBy("part", F.col("prefix").alias("after")).agg(F.count(F.when(F.col("alive"), 1)).alias("survivors"))
    n, whole = len(names), (1 << len(names)) - 1
    size = F.bit_count("prefix").cast("int")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size + 1)
    filters = counts.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * weight).alias("shapley"),
        F.sum(F.when(size == n - 1, F.col("removed"))).alias("unique_fails"),
    )
    failed = split.where("prefix = 0").groupBy("part").agg(F.count("*").alias("failed"))
    sizes = parts.groupBy("part").agg(F.count("*").alias("rows")).join(failed, "part", "left")
    grid = sizes.select("part", (F.col("rows") - F.coalesce("failed", F.lit(0))).alias("clean"), F.inline(F.from_json(F.lit(json.dumps(orders(names))), "array<struct<filter_order:string,step:int,filter:int,prefix:int,after:int>>")))
    made = grid.join(counts, ["part", "filter", "prefix"], "left").join(survivors, ["part", "after"], "left").join(filters, ["part", "filter"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return made.select(
        "part",
        "filter_order",
        "step",
        F.element_at(F.array(*map(F.lit, names)), F.col("filter") + 1).alias("filter"),
        (F.col("clean") + F.when(F.col("after") == whole, F.lit(0)).otherwise(zero("survivors"))).alias("kept"),
        *[zero(c).alias(c) for c in ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")],
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`audited` for the five text filters over all rows of `docs`, parted by lang.

    Null texts are empty and fail A only (and E, where a smaller id's text is empty too); a null lang is the part ''. Each row counts,
    repeated rows too: of rows that share id and text none is a copy of the other. Null ids have no label and never fail E. Further columns are ignored;
    an empty table gives no rows, empty labels give no losses.
    """
    rows = judged(docs)
    return audited(rows.select("part"), id_tables(failing(rows, labels), FILTERS), FILTERS)
