"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own, as in tests.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and not (context.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: a short lineage that survives lost executors.

    ``group_bytes`` bounds a file's row groups, where rows are large: a task holds a whole one in memory as it writes and, of 4,096 rows at most, as it reads.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    options = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4} if group_bytes else {}
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most_rows: int = 10_000, most_bytes: int = 16_000_000) -> None:
    """Bounds the session's Arrow batches, so that a task's memory is bounded where rows are large; smaller bounds stay."""
    for name, most in (("maxRecordsPerBatch", most_rows), ("maxBytesPerBatch", most_bytes)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("bB"))
        if now > most or now <= 0:
            spark.conf.set(key, str(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def row_key(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Adds ``key_id`` and ``key_hash``, equal for rows that agree in id and text; nulls are keys too."""
    return df.withColumns({
        "key_id": F.coalesce(F.col(id_column).cast("long"), F.lit(-1).cast("long")),
        "key_hash": F.xxhash64(F.coalesce(F.col(text_column), F.lit("")), F.col(id_column).isNull()),
    })


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table written as literals, one row at least."""
    made = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows))
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links reach, for every node of ``edges`` (a, b).

    Every node takes its neighbours' smallest label, then its label's label, until nothing changes; the
    label table is written to the shared folder each round.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels, both.b == labels.node).select("a", "root", F.lit(None).cast("long").alias("own"))
        seen = seen.union(labels.select(F.col("node").alias("a"), "root", F.col("root").alias("own")))
        lower = seen.groupBy("a").agg(F.min("root").alias("next"), F.max("own").alias("own"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        stepped = cut(lower.join(jump, "next", "left").select(F.col("a").alias("node"), F.coalesce("far", "next").alias("root"), (F.coalesce("far", "next") != F.col("own")).alias("changed")))
        labels = stepped.select("node", "root")
        if stepped.where("changed").limit(1).count() == 0:
            return labels
