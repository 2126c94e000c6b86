"""What the corpus operators share: durable tables, size-checked joins, token rules."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import durable, folder, passing

#: Words are runs of anything but space and the ASCII controls 9 to 13; ``bytes.split()`` cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only below this many rows of narrow columns (some 10 MB); beyond it the join shuffles.
BROADCAST_ROWS = 50_000

_BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def prepare(spark: SparkSession) -> None:
    """Arrow batches to Python end at BATCH bytes, so that a worker's memory doesn't follow the length of texts; a session's own setting stays."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, BATCH)


def give_back() -> None:
    """A Python worker hands memory that it has freed back to the system: workers live on between tasks, and allocators keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the C library on Linux only
        ctypes.CDLL(None).malloc_trim(0)


_memory: dict[str, dict] = {}


def memory(owner: str) -> dict:
    """What an operator's Python worker remembers between batches; workers are shared, so another operator's memory goes."""
    if owner not in _memory:
        _memory.clear()
        give_back()
    return _memory.setdefault(owner, {})


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return that table: lineage ends here, and survives lost executors."""
    prepare(df.sparkSession)
    return durable(df, name)


def keep_grouped(df: DataFrame, name: str, column: str) -> DataFrame:
    """``keep``, in buckets of a column: what is grouped or joined by it later is shuffled to this table, which stays where it is."""
    spark = df.sparkSession
    prepare(spark)
    unique = f"{name}_{uuid.uuid4().hex}"
    with passing(spark):
        df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", f"{folder(spark)}/{unique}").option("compression", "zstd").saveAsTable(unique)
    table = spark.table(unique)
    spark.sql(f"DROP TABLE {unique}")  # the name only: the files are not the catalogue's
    return table


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def packed(docs: DataFrame) -> DataFrame:
    """A single column ``packed`` of whole rows, so that no other name can clash; ``select("packed.*")`` gives them back."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("packed"))


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe join on equally named keys with a kept table; it is broadcast only if counted below BROADCAST_ROWS."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    renamed = small.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = None
    for k in keys:
        c = big[k].eqNullSafe(renamed[f"__r_{k}"])
        on = c if on is None else on & c
    return big.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def fold(column: str, modulus: int):
    """crc32 of the decimal id, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """Enough partitions for so many rows each, and no fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
