"""Exact dedup by a tree-merge of sorted digest runs.

Each input partition makes one run: its digests, sorted, each with its smallest identifier and count.
Runs are merged along a binomial tree to the base `fan_in`: in round r a run goes to the partner whose
number has digit r, and all below it, at 0, so that up to fan_in runs meet there. A level is dealt by range over (run,
digest), sorted, and merged: equal digests that are verified by a second full digest become one row
with the smallest identifier. After log(runs) rounds one run is left, spread over all tasks by ranges
of digests, never in one task. A digest reaches a round at most fan_in times, however many copies there
are, and every level is a stored table, from which a lost executor's work is done again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

WHITESPACE = r"[\x20\x09-\x0D]+"
RUN = ["run", "digest", "check"]


def normalised(text: Column) -> Column:
    """The text without ASCII whitespace; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, "")


def merged(runs: DataFrame) -> DataFrame:
    """Rows (run, digest, check, best, n) of sorted runs with equal digests of a run merged. `check`, a
    second digest and the length, verifies that they come from equal texts: only rows that agree in it
    merge."""
    return runs.groupBy(*RUN).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def merge_rounds(level: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """The runs 0 to runs - 1, merged until run 0 has every digest once."""
    reach = 1
    while reach < runs:
        reach *= fan_in
        partner = F.col("run") - F.col("run") % reach
        met = level.withColumn("run", partner).repartitionByRange("run", "digest").sortWithinPartitions(*RUN)
        level = stored(merged(met), "run", narrow=False)
    return level


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical without ASCII whitespace; null counts as empty, so nulls, empty and
    blank texts are one group. Of a group the row with the most code points in its original text
    stays, then the smallest id (null ids last). Of rows that repeat in id and text one is kept, the
    others are dropped like any copy. No rows give no rows. Other columns are not read.
    """
    if fan_in < 2:
        raise ValueError("a round merges two runs at least")
    text, slim = F.coalesce(F.col(text_col), F.lit("")), normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("chars"), slim.alias("slim"))
    rows = rows.select(
        "doc_id",
        "chars",
        F.unhex(F.sha2("slim", 256)).alias("digest"),
        F.struct(F.octet_length("slim").alias("len"), F.unhex(F.md5("slim")).alias("md5")).alias("check"),
        F.monotonically_increasing_id().alias("row"),
    )
    # stored once: the row numbers stay what they are, and whole texts are read once
    rows = stored(rows, "digests", narrow=False).withColumn("run", F.shiftright("row", 33))
    best = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    runs = rows.agg(F.max("run")).first()[0]
    # a partition's copies are merged before anything is shuffled
    first = stored(rows.groupBy(*RUN).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n")), "runs", narrow=False)
    kept = merge_rounds(first, (runs or 0) + 1, fan_in).select("digest", "check", "best", "n")
    # Down again: only copies need their group's row. Both sides are plain scans, so that adaptive
    # execution can split a digest that holds a large part of all rows.
    groups = stored(kept.where("n > 1"), "groups").withColumnRenamed("check", "g_check").withColumnRenamed("digest", "g_digest")
    out = rows.join(groups, (rows["digest"] == groups["g_digest"]) & (rows["check"] == groups["g_check"]), "left")
    return out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
