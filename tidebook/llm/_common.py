"""What the corpus operators share: tables in the cluster's shared folder, words, arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import stored

__all__ = ["filed", "held_out", "lowered", "pieces", "place", "read", "stored", "text_bytes", "words"]

#: Words of a lower-cased UTF-8 text: ASCII letters, digits, and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

def lowered(raw: bytes) -> bytes:
    """UTF-8 with A-Z lower-cased, and nothing else."""
    return raw.translate(_LOWER)


def words(text: str | bytes | None) -> list[bytes]:
    """A-Z lower-cased words, as UTF-8. None and empty texts have none."""
    if not text:
        return []
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return WORD.findall(lowered(raw))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """The column's values as UTF-8 without decoding them."""
    for x in batch.column(name).cast(pa.large_binary()):
        yield x.as_py()


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about `most` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            n = n or 0
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def place(docs: DataFrame) -> Column:
    """Where a row of a table that is read from files stands: struct(file, row). It tells rows apart that
    repeat in every column, is the same in every scan, and orders a table as it was written."""
    about = docs.metadataColumn("_metadata")
    return F.struct(about["file_path"].alias("file"), about["row_index"].alias("row"))


def filed(docs: DataFrame) -> DataFrame:
    """docs as a scan of files, so that each row has a place of its own: itself if it is no more than columns
    and filters of one, else a stored copy."""
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    if node.nodeName() == "LogicalRelation":
        try:
            docs.select(place(docs))
            return docs
        except AnalysisException:
            pass  # a relation of another kind than files
    return stored(docs, "filed", narrow=False)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn from: crc32(doc_id as text) mod 5 is 0. A null id is
    not held out, and has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
