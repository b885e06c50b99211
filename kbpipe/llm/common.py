"""Helpers shared by the training-data operators.

The text operators that run in Python take Arrow batches (``mapInArrow``):
Spark splits and shuffles the rows, a task sees one bounded batch at a time.
Texts travel as UTF-8 bytes; both word rules of this subpackage only look at
ASCII, and every byte of a non-ASCII character is 0x80 or above, so they can
be applied to the bytes.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbpipe.session import checkpoint_root

# bytes outside [0-9A-Za-z] and non-ASCII become a space, A-Z becomes a-z
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))

SPACES = r"[\x20\x09-\x0D]+"


def words(raw: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return raw.translate(WORD_TABLE).split()


def tokens(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z) white-space separated words ``[^\\x20\\x09-\\x0D]+``."""
    return raw.lower().split()      # bytes.split() cuts at exactly 20 and 09-0D


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8 bytes; NULL reads as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(f"`{c}`") for c in cols]) if cols else df


def remainder_of(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


class Scratch:
    """Written tables in the shared folder: they cut lineage, so a lost
    executor re-reads files, and each can be dropped once nothing reads it.

    An operator's result reads its tables, so only who has written the result
    can drop them: ``collected`` gathers what operators make meanwhile."""

    _gathering: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        for made in self._gathering:
            made.append(self)
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self._paths[id(out)] = path
        return out

    @classmethod
    @contextlib.contextmanager
    def collected(cls) -> Iterator[list[Scratch]]:
        """The scratch folders that are made inside."""
        made: list[Scratch] = []
        cls._gathering.append(made)
        try:
            yield made
        finally:
            cls._gathering[:] = [x for x in cls._gathering if x is not made]

    def _delete(self, path: str) -> None:
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hpath, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self._paths.pop(id(t), None)
            if path:
                self._delete(path)

    def drop_all(self) -> None:
        """Deletes every table of this scratch folder."""
        self._paths.clear()
        self._delete(self.root)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(batch) -> dict of columns`` over every Arrow batch of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [x.cast(f.type) if isinstance(x := cols[f.name], (pa.Array, pa.ChunkedArray))
                     else pa.array(x, f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def free_name(name: str, taken) -> str:
    """``name``, with underscores added until no column of ``taken`` has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
