"""Helpers shared by the operators: text columns, bounded broadcasts, partition counts."""

import ctypes

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from hydroq.sources.staging import stage  # noqa: F401  (re-used by the operators)

SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
NO_ID = -(2 ** 63)
BROADCAST_ROWS = 100_000


def text_rows(docs, id_col="doc_id", text_col="text"):
    """Only the id and the text as bytes: other columns, whatever their names, stay out. Null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(staged, most=BROADCAST_ROWS):
    """Hint a broadcast only for a written table counted at ``most`` rows or fewer; beyond that the planner joins by shuffle."""
    return F.broadcast(staged) if staged.limit(most + 1).count() <= most else staged


def parts_of(batches, rows=2000):
    """Batches of at most ``rows`` rows, so that what is made of one stays small; freed memory goes back to the machine."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        _trim()


def _trim():
    """Workers live on between stages; without this each keeps the most it ever held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(spark):
    """Arrow batches of 2,000 rows for whole texts: the default of 10,000 holds some hundred MB outside of the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def signed(value):
    """An unsigned 64-bit number as Spark's long."""
    return value - (1 << 64) if value >= 1 << 63 else value


def row_hash(text):
    """Tells rows of one id apart by their text."""
    return signed(xxhash.xxh3_64_intdigest(text))


def words_of(text):
    """Lower-cased (A-Z only) words between ASCII white space."""
    return text.translate(LOWER).split()
