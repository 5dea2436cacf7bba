"""What the operators share: words, tables in the shared folder, connected components.

Rows whose ``doc_id`` is null take part like any other: inside the operators they carry
:data:`NULL_ID`, which sorts before all ids, and come back as null.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators.
NULL_ID = -(2**63)
#: A word is a run of anything but these six characters; as Java regex classes.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

_written: dict[str, SparkSession] = {}


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` parts at exactly the six characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one only where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back, so that a lost executor costs a re-read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame], *before: str) -> tuple[DataFrame, str]:
    """The table that ``make`` gives, written and read back, and its path. The tables that were written on the way, and those ``before``, go."""
    older = set(_written)
    out = written(make(), name)
    path = next(reversed(_written))
    for p in [*(x for x in _written if x not in older and x != path), *before]:
        drop(spark, p)
        _written.pop(p, None)
    return out, path


def drop(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        with contextlib.suppress(Exception):
            drop(spark, path)


def with_key(docs: DataFrame, *more: str) -> DataFrame:
    """``id`` (never null) and the columns named, under those names; all other columns of the input, clashing ones too, stay out."""
    return docs.select(F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("id"), *(docs[c].alias(c) for c in more))


def doc_id(column: str = "id"):
    """The doc_id that an ``id`` stands for."""
    return F.nullif(F.col(column), F.lit(NULL_ID)).alias("doc_id")


#: Texts may be long, so Python workers get them in batches of so many rows at most.
ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a worker holds of a batch; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, str(ROWS))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Keys with more than one part in so many of all rows are broadcast; by the pigeonhole principle they are fewer than that.
HOT = 1000


def meet(rows: DataFrame, table: DataFrame, keys: list[str], value: str, *salt: str) -> DataFrame:
    """``rows`` with ``value`` of the row of ``table`` (keys, value, n; a key once, for n or fewer rows) that has their keys; others go.

    The rows of hot keys meet their value where they lie, and take the columns ``salt`` for their key in the join of the others.
    """
    most = (table.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = table.where(F.col("n") > most).select(*keys, F.col(value).alias("__hot"))
    cold = table.where(F.col("n") <= most).select(*keys, F.lit(0).alias("__salt"), F.col(value).alias("__cold"))
    spread = F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*salt), F.lit(1 << 20)).cast("int"))
    found = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", spread).join(cold, [*keys, "__salt"], "left")
    return found.select(*rows.columns, F.coalesce("__hot", "__cold").alias(value)).where(F.col(value).isNotNull())


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): the smallest node that each linked node can reach.

    Alternates large and small stars, so the rounds grow with the logarithm of the longest
    path. A hub is never gathered: its minimum is a combinable aggregate, and the join that
    hands it out can be split by AQE. Every round is a table in the shared folder; only a
    count and a checksum come to the driver.
    """
    spark = links.sparkSession
    edges = written(links.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v")
        large = large.where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").selectExpr("explode(array(struct(v AS x, m AS y), struct(u AS x, m AS y))) AS e")
        edges = written(small.selectExpr("e.x AS u", "e.y AS v").where("u <> v").distinct(), "links")
    return edges.selectExpr("u AS node", "v AS root")
