"""Bounded labelled samples to learn from, and scores added to documents by a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import held_out, text_bytes


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int, id_col: str, text_col: str) -> list[tuple[bytes, int]]:
    """At most `rows` (text, label) pairs to learn from, in a fixed order.

    Left out are labels that are null or whose id is held out, null, or of no document, and documents
    whose text is over `longest` bytes. Of the ids that are left, `rows` are chosen by their hash, so all
    are used where they are no more than that; only the chosen ones are broadcast. Of an id that
    repeats, the largest label and the first text in order count; null texts count as empty.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(label).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    usable = texts.select("id").join(ids, F.col("id") == F.col("labelled")).select("labelled", "y").distinct()
    chosen = usable.orderBy(F.xxhash64("labelled"), "labelled").limit(rows)
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled"))
    found = found.groupBy("id").agg(F.min("text").cast("binary").alias("text"), F.max("y").alias("y"))
    table = found.toArrow().sort_by("id")
    return list(zip((bytes(x) for x in table["text"].to_pylist()), table["y"].to_pylist(), strict=True))


def with_score(docs: DataFrame, score: Callable[[], Callable[[bytes], float]], text_col: str, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs with a column of the model's scores of whole texts; a column of that name is replaced.
    `score` makes the scorer, once per task; null texts are scored as empty. `keep` names the columns
    that come back from the tasks (all, if None), so that texts need not."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    docs = docs.select(*keep, F.col(text_col).cast("binary").alias("__text"))
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField(name, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = score()
        for batch in batches:
            values = pa.array([one(x or b"") for x in text_bytes(batch, "__text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=schema.names)

    return docs.mapInArrow(scored, schema)
