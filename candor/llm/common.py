"""Helpers shared by the operators: batches of whole texts, shared scratch tables, hash remainders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from candor.lineage import ensure_checkpoint_dir

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = " \t\n\r\x0b\x0c"
#: Texts handed to Python at once, so that memory follows this bound and the longest single text.
SLICE_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARKS_BATCH = "67108864b"  # Spark's default of that


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def crc_mod(column: str, n: int) -> Column:
    """Remainder of the CRC-32 of a value's text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def bound_batches(spark: SparkSession) -> None:
    """Let Spark send Python SLICE_BYTES or little more at once, where the session has no bound of its own.

    By default a batch is ten thousand rows or 64 MB, held off the heap by the JVM and again by each worker.
    """
    if spark.conf.get(_BATCH_BYTES) == _SPARKS_BATCH:
        spark.conf.set(_BATCH_BYTES, str(SLICE_BYTES))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of ``column`` each; a longer single row is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, column: str = "text") -> DataFrame:
    """Apply ``make()``, a function from columns to columns (lists), to slices of ``df``."""
    bound_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_pydict(fn(part.to_pydict()), schema=arrow)

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it again: lineage ends, all executors
    see the rows, and readers prune columns.  The files go when the driver's JVM ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
