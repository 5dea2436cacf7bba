"""Token ids in binary shards, with a minimal perfect hash index (operator 3).

A store is a folder of Parquet tables, so that any file system Spark writes to will do:

``shards``  task, shard, n_docs, n_tokens, keys, starts, payload. Documents stand in ascending
            doc_id order over (task, shard). ``payload`` is their ids, each document with its
            end id, as raw little-endian unsigned integers of 2 bytes (4 for vocabularies over
            65,536); ``keys`` is their doc_ids and ``starts`` each one's first id in the
            payload and the payload's length, both 8-byte integers. The shards of a task are one
            file, part-<task>-..., and each is a row group of its own.
``index``   bucket, n_keys, levels, slots. A key belongs to bucket xxhash64(key) modulo the
            number of buckets. ``levels`` is a minimal perfect hash of the bucket's keys: bit
            arrays of falling size, in each of which a key that meets no other sets its bit,
            and its slot is the number of bits set before. A slot holds a 32-bit fingerprint
            (another hash of the key, so that strange keys are refused), task, shard, place
            in the shard and number of rows with this key, which stand side by side. Bucket b is
            in the file part-<b modulo the number of files>-....
``about``   n_buckets, n_files, n_tasks, width: one row.

Access to a key costs one bucket, some bit tests and one shard, however many documents there
are: one row group of one file of the index, one of one file of the shards. Buckets and shards are bounded, so no task holds more than a few of either.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, doc_id, new_path, partitions, small_batches
from .tokens import Encoder, public_vocabulary

END = 2
#: Payload bytes after which a shard ends.
SHARD = 1_000_000
#: Keys of a bucket, on average.
BUCKET = 4_096
_SLOT = np.dtype([("mark", "<u4"), ("task", "<i4"), ("shard", "<i4"), ("place", "<i4"), ("rows", "<i4")])
_SHARDS = {"task": pa.int32(), "shard": pa.int32(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "keys": pa.binary(), "starts": pa.binary(), "payload": pa.binary()}


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path, spaced=False)


def hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of integer keys for each seed."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_levels(keys: np.ndarray) -> bytes:
    """A minimal perfect hash of distinct keys: for each level its number of bits and the bits."""
    out, level = [], 0
    while len(keys):
        size = max(64, -(-2 * len(keys) // 64) * 64)
        at = (hashed(keys, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        out.append(struct.pack("<I", size) + np.packbits(alone, bitorder="little").tobytes())
        keys = keys[~alone[at]]
        level += 1
    return b"".join(out)


def slots_of(levels: bytes, keys: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 where no level has it (keys that were not put in may get any slot)."""
    slot, todo, before, at, level = np.full(len(keys), -1), np.arange(len(keys)), 0, 0, 0
    while at < len(levels) and len(todo):
        (size,) = struct.unpack_from("<I", levels, at)
        bits = np.unpackbits(np.frombuffer(levels, np.uint8, size // 8, at + 4), bitorder="little")
        place = (hashed(keys[todo], level) % np.uint64(size)).astype(np.int64)
        rank = np.cumsum(bits) - bits
        hit = bits[place] == 1
        slot[todo[hit]] = before + rank[place[hit]]
        todo = todo[~hit]
        before += int(bits.sum())
        at += 4 + size // 8
        level += 1
    return slot


def _mark(keys: np.ndarray) -> np.ndarray:
    return (hashed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def _write_shards(path: str, end: int):
    def of(batches):
        encode = _encoder(path)
        stop = np.array([end], encode.dtype).tobytes()
        task, shard = TaskContext.get().partitionId(), 0
        keys, parts, size = [], [], 0

        def flush():
            ends = np.cumsum([len(x) // encode.dtype.itemsize for x in parts])
            row = (task, shard, len(keys), int(ends[-1]), np.array(keys, "<i8").tobytes(), np.r_[0, ends].astype("<i8").tobytes(), b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SHARDS.values())], list(_SHARDS))

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                for i, ids in zip(batch.column("id").to_pylist(), encode(batch.column("text"))):
                    keys.append(i)
                    parts.append(ids + stop)
                    size += len(ids)
                    if size >= SHARD:
                        yield flush()
                        keys, parts, size, shard = [], [], 0, shard + 1
        if keys:
            yield flush()

    return of


def _index_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    keys = rows["id"].to_numpy()
    levels = build_levels(keys)
    table = np.zeros(len(keys), _SLOT)
    at = slots_of(levels, keys)
    table["mark"][at] = _mark(keys)
    for c in ("task", "shard", "place", "rows"):
        table[c][at] = rows[c].to_numpy()
    return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "n_keys": [len(keys)], "levels": [levels], "slots": [table.tobytes()]})


def _bucket(n: int):
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Encode every row of ``docs`` (doc_id, text; others are ignored) into a store at ``path``.

    A null text is its end id alone; a null doc_id is the smallest. Rows that repeat a doc_id
    stand side by side in the order of their texts' hashes. An empty table gives an empty
    store. vocabulary: a file of the tokenizers library whose pre-tokens drop white space.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("mark"))
    dealt = own.repartitionByRange(partitions(spark), "id", "mark").sortWithinPartitions("id", "mark").select("id", "text")
    shards = dealt.mapInArrow(_write_shards(vocabulary or public_vocabulary("word_bpe_49k.json"), end), "task int, shard int, n_docs long, n_tokens long, keys binary, starts binary, payload binary")
    by_row(shards.write).parquet(f"{path}/shards")
    stored = spark.read.parquet(f"{path}/shards")
    places = stored.select("task", "shard", "keys").mapInPandas(_places, "id long, task int, shard int, place int")
    first = F.min(F.struct("task", "shard", "place")).alias("f")
    keys = places.groupBy("id").agg(first, F.count("*").cast("int").alias("rows"))
    sums = stored.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.max("task") + 1, F.lit(0))).first()
    n, files = max(1, -(-sums[0] // BUCKET)), partitions(spark)
    bucketed = keys.select(_bucket(n).alias("bucket"), "id", "f.task", "f.shard", "f.place", "rows")
    index = bucketed.groupBy("bucket").applyInPandas(_index_bucket, "bucket int, n_keys long, levels binary, slots binary")
    by_row(index.repartitionById(files, F.pmod("bucket", F.lit(files)).cast("int")).sortWithinPartitions("bucket").write).parquet(f"{path}/index")
    about = [(n, files, sums[1], _encoder(vocabulary or public_vocabulary("word_bpe_49k.json")).dtype.itemsize)]
    spark.createDataFrame(about, "n_buckets long, n_files int, n_tasks int, width int").coalesce(1).write.parquet(f"{path}/about")


def by_row(writer: DataFrameWriter) -> DataFrameWriter:
    """Every row a row group, so that a row that is asked for by a number is all that is read."""
    return writer.option("parquet.block.row.count.limit", "1").option("parquet.block.size", str(SHARD)).option("parquet.page.size.row.check.min", "1")


def _one_file(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """The file that the task of this number wrote, if it wrote one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-{number:05d}-*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return spark.read.parquet(*(str(x.getPath()) for x in found)) if found else None


def _places(batches):
    for batch in batches:
        for task, shard, raw in zip(batch["task"], batch["shard"], batch["keys"]):
            keys = np.frombuffer(raw, "<i8")
            yield pd.DataFrame({"id": keys, "task": task, "shard": shard, "place": np.arange(len(keys), dtype=np.int32)})


def _look_up(_, keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    names = ["id", "task", "shard", "place", "rows"]
    if not len(keys) or not len(index):
        return pd.DataFrame({c: pd.Series([], dtype="int64" if c == "id" else "int32") for c in names})
    own = keys["id"].unique()
    slot = slots_of(index["levels"].iloc[0], own)
    table = np.frombuffer(index["slots"].iloc[0], _SLOT)
    found = np.flatnonzero(slot >= 0)
    found = found[table["mark"][slot[found]] == _mark(own[found])]
    at = table[slot[found]]
    return pd.DataFrame({"id": own[found], **{c: at[c] for c in names[1:]}})


def locate(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """keys (id): (id, task, shard, place, rows) of those that the store's index holds, by way of the index alone."""
    index = spark.read.parquet(f"{path}/index")
    n = spark.read.parquet(f"{path}/about").first().n_buckets
    asked = keys.select("id").distinct().select("id", _bucket(n).alias("bucket")).groupBy("bucket")
    return asked.cogroup(index.groupBy("bucket")).applyInPandas(_look_up, "id long, task int, shard int, place int, rows int")


def read_shards(spark: SparkSession, path: str, keep_ids: bool = False, width: int = 2) -> DataFrame:
    """(task, shard, place, key, at, n_tokens, ids_crc32), and ids if kept, of every document, read where it lies."""

    def of(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("task", "shard", "keys", "starts", "payload"))):
                task, shard, keys, starts, payload = row
                ids, at, keys = np.frombuffer(payload, f"<u{width}").astype("<u4"), np.frombuffer(starts, "<i8"), np.frombuffer(keys, "<i8")
                texts = [ids[a:b].tobytes() for a, b in zip(at, at[1:])]
                n = len(keys)
                columns = [np.full(n, task, np.int32), np.full(n, shard, np.int32), np.arange(n, dtype=np.int32), keys, at[:-1], np.diff(at), np.array([zlib.crc32(x) for x in texts], np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *[pa.array(texts, pa.binary())] * keep_ids], ["task", "shard", "place", "key", "at", "n_tokens", "ids_crc32", *["ids"] * keep_ids])

    return spark.read.parquet(f"{path}/shards").mapInArrow(of, "task int, shard int, place int, key long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(task, shard, base): ids of the store before each shard. Tasks, not shards or documents, meet in one window."""
    shards = spark.read.parquet(f"{path}/shards").select("task", "shard", "n_tokens")

    def upto(w):
        return F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tasks = shards.groupBy("task").agg(F.sum("n_tokens").alias("n_tokens")).select("task", upto(Window.orderBy("task")).alias("before"))
    return shards.select("task", "shard", upto(Window.partitionBy("task").orderBy("shard")).alias("within")).join(tasks, "task").select("task", "shard", (F.col("before") + F.col("within")).alias("base"))


def bucket_rows(spark: SparkSession, path: str, about, bucket: int) -> DataFrame | None:
    own = _one_file(spark, f"{path}/index", bucket % about.n_files)
    return own.where(F.col("bucket") == bucket).select("levels", "slots") if own is not None else None


def shard_rows(spark: SparkSession, path: str, task: int, shard: int) -> DataFrame | None:
    own = _one_file(spark, f"{path}/shards", task)
    return own.where(F.col("shard") == shard).select("starts", "payload") if own is not None else None


def fetch(spark: SparkSession, path: str, keys: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of each of a few keys that the store holds. For each key one bucket and one shard are read, and a further shard only where rows that repeat the key go on there."""
    about = spark.read.parquet(f"{path}/about").first()
    bucket = {k: b for k, b in spark.createDataFrame([(k,) for k in keys], "id long").select("id", _bucket(about.n_buckets)).collect()} if keys else {}
    out = {}
    for k, b in bucket.items():
        rows, own = bucket_rows(spark, path, about, b), np.array([k], np.int64)
        found = rows.first() if rows is not None else None
        slot = slots_of(found.levels, own)[0] if found else -1
        if slot < 0:
            continue
        at = np.frombuffer(found.slots, _SLOT)[slot]
        if at["mark"] != _mark(own)[0]:
            continue
        task, shard, place, left = (int(at[c]) for c in ("task", "shard", "place", "rows"))
        out[k] = []
        while left and task < about.n_tasks:
            rows = shard_rows(spark, path, task, shard)
            row = rows.first() if rows is not None else None
            if row is None:  # the task has no more
                task, shard = task + 1, 0
                continue
            starts, ids = np.frombuffer(row.starts, "<i8"), np.frombuffer(row.payload, f"<u{about.width}")
            own = range(place, min(place + left, len(starts) - 1))
            out[k] += [ids[starts[p] : starts[p + 1]] for p in own]
            left, place, shard = left - len(own), 0, shard + 1
    return out


def query(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "store")
    write_store(docs, path)
    found = locate(spark, path, docs.select(F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("id"))).select("id", *(F.col(c).alias(f"first_{c}") for c in ("task", "shard", "place")), "rows")
    stored = read_shards(spark, path).join(shard_starts(spark, path), ["task", "shard"])
    here = (F.col("task") == F.col("first_task")) & (F.col("shard") == F.col("first_shard")) & (F.col("place") == F.col("first_place"))
    rows = stored.join(found, F.col("key") == F.col("id")).where(here | (F.col("rows") > 1))
    return rows.select(doc_id(), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
