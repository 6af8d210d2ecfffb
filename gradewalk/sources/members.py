"""The members of one array of large JSON documents, read in many tasks.

A document is cut at every ``}``, which Spark's text reader does from any byte on.  Whether a piece starts
inside a string, and how deep, follows from all before it: each block of a file is summed up under both
answers, blocks are combined in order, and the pieces between two members are put together again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ["file", "block"]


def _outside(text: Column, inside: Column | bool) -> Column:
    """``text`` without what its strings hold; ``inside``: it starts in a string."""
    bare = F.regexp_replace(text, r"(?s)\\.", "")
    return F.regexp_replace(F.when(F.lit(inside) if isinstance(inside, bool) else inside, F.concat(F.lit('"'), bare)).otherwise(bare), r'(?s)"[^"]*("|$)', "")


def _deeper(outside: Column) -> Column:
    """How much deeper the end of a text is than its start."""
    return F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))


def _quotes(text: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'[^"]', ""))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, value, depth): what lies before each ``}`` that no string holds it or its start in; ``depth`` at its start.

    Pieces that start inside a string have a null depth.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    odd = F.pmod(_quotes(F.col("value")), F.lit(2))
    # the } that ends a piece counts where no string holds it
    ends = {side: _deeper(_outside(F.col("value"), bool(side))) - F.when(odd == side, 1).otherwise(0) for side in (0, 1)}
    raw = raw.withColumns({"odd": odd, "d0": ends[0], "d1": ends[1]})
    before = Window.partitionBy(*BLOCK).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    raw = raw.withColumn("flip", F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)))
    # the depth reached in the block, if its start is outside a string or in one
    raw = raw.withColumns({f"s{side}": F.when(F.col("flip") == side, F.col("d0")).otherwise(F.col("d1")) for side in (0, 1)})
    raw = raw.withColumns({f"b{side}": F.coalesce(F.sum(f"s{side}").over(before), F.lit(0)) for side in (0, 1)})
    blocks = raw.groupBy(*BLOCK).agg(F.pmod(F.sum("odd"), F.lit(2)).alias("odd"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.pmod(F.coalesce(F.sum("odd").over(earlier), F.lit(0)), F.lit(2)))
    blocks = blocks.withColumn("from", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("s0")).otherwise(F.col("s1"))).over(earlier), F.lit(0)))
    known = raw.join(blocks.select(*BLOCK, "inside", "from"), BLOCK)
    depth = F.col("from") + F.when(F.col("inside") == 0, F.col("b0")).otherwise(F.col("b1"))
    return known.select(*BLOCK, "nth", "value", F.when(F.col("flip") == F.col("inside"), depth).alias("depth"))


def members(spark: SparkSession, path: str, array: str) -> DataFrame:
    """(file, nth, json): the objects in the array ``array`` at the top level of each document under ``path``, from 0 in their order.

    Blocks are as large as ``spark.sql.files.maxPartitionBytes``, and no task holds more than one, or one member.  A document without
    that array, or with an empty one, gives no rows; members other than objects aren't supported.  Gzipped files are one block.
    """
    opening = rf'(?s)^(.*?(?<!\\)"{re.escape(array)}"\s*:\s*\[\s*)\{{'
    header = F.regexp_extract("value", opening, 1)
    outside = _outside(header, False)
    # its brackets lead to depth 2, through one brace at most: that of the document
    opens = (F.length(header) > 0) & (F.col("depth") + _deeper(outside) == 2) & (F.length(F.regexp_replace(outside, "[^{]", "")) == F.when(F.col("depth") == 0, 1).otherwise(0))
    closes = (F.col("depth") == 2) & F.col("value").rlike(r"^\s*\]")
    yes = lambda c: F.coalesce(c, F.lit(False))
    cut = pieces(spark, path).withColumn("opens", yes(opens))
    cut = cut.withColumns({"turn": F.when(F.col("opens"), True).when(yes(closes), False), "next": F.col("opens") | yes((F.col("depth") == 2) & F.col("value").rlike(r"^\s*,\s*\{"))})
    upto = Window.partitionBy(*BLOCK).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("on", F.last("turn", ignorenulls=True).over(upto))
    # members that start in the block after its first turn, and before it, which count if the array is open there
    sure, maybe = F.col("next") & yes(F.col("on")), F.col("next") & F.col("on").isNull()
    blocks = cut.groupBy(*BLOCK).agg(F.count_if(sure).alias("sure"), F.count_if(maybe).alias("maybe"), F.max_by("on", "nth").alias("turn"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("open", yes(F.last("turn", ignorenulls=True).over(earlier)))
    blocks = blocks.withColumn("from", F.coalesce(F.sum(F.col("sure") + F.when(F.col("open"), F.col("maybe")).otherwise(0)).over(earlier), F.lit(0)))
    cut = cut.join(blocks.select(*BLOCK, "open", "from"), BLOCK).where(F.coalesce("on", "open"))
    cut = cut.withColumn("member", F.col("from") + F.count_if("next").over(upto) - 1)
    text = F.when(F.col("opens"), F.substring("value", F.length(header) + 1, F.length("value"))).when(F.col("next"), F.regexp_replace("value", r"^\s*,\s*", "")).otherwise(F.col("value"))
    whole = cut.groupBy("file", "member").agg(F.sort_array(F.collect_list(F.struct("block", "nth", F.concat(text, F.lit("}")).alias("text")))).alias("parts"))
    return whole.select("file", F.col("member").alias("nth"), F.array_join("parts.text", "").alias("json"))


def says(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(file, said): whether each document under ``path`` has the string ``value`` under ``key`` at its top level."""
    head = F.regexp_extract("value", rf'(?s)^(.*?(?<!\\))"{re.escape(key)}"\s*:\s*"{re.escape(value)}"', 1)
    found = F.col("value").rlike(rf'(?s)(?<!\\)"{re.escape(key)}"\s*:\s*"{re.escape(value)}"') & (F.col("depth") + _deeper(_outside(head, False)) == 1)
    return pieces(spark, path).groupBy("file").agg(F.coalesce(F.max(found), F.lit(False)).alias("said"))
