"""Mixing sources to target weights on a time-varying curriculum.

Each source has a weight schedule over training time 0..1: knots joined by lines. Its integral,
scaled to the source's target, is the source's cumulative token demand. A document copy is due where
the demand equals the source's tokens before its middle; inverting the demand there gives its
training position, and copies due after the end are not taken. Copies are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import filed, place, stored

WORD_RUN = r"[^\x20\x09-\x0D]+"
#: Time knots and, for each kind of source in turn, weights there; each kind's weights are scaled to
#: integrate to 1. Heavy sources come early, light ones late.
KNOTS = (0.0, 0.25, 0.75, 1.0)
SCHEDULES = ((1.5, 1.25, 0.75, 0.5), (1.0, 1.0, 1.0, 1.0), (0.5, 0.75, 1.25, 1.5))
#: Rows of a file, at most, that are one line of a source's order if they are equal.
CHUNK_ROWS = 1 << 16
LINE = ["src", "mix", "file", "chunk"]


def integrals(weights: Sequence[float], knots: Sequence[float] = KNOTS) -> tuple[list[float], list[float]]:
    """The schedule scaled to integrate to 1, and its integral up to each knot."""
    areas = [(a + b) / 2 * (u - t) for a, b, t, u in zip(weights, weights[1:], knots, knots[1:], strict=False)]
    total = sum(areas)
    if total <= 0 or min(weights) < 0:
        raise ValueError("a schedule needs weights of 0 or more, some above 0")
    upto = [0.0]
    for a in areas:
        upto.append(upto[-1] + a / total)
    return [w / total for w in weights], upto


def invert(kind: Column, share: Column, knots: Sequence[float], schedules: Sequence[Sequence[float]]) -> Column:
    """Time by which a source of that kind has asked for `share` (0..1) of its target: on the line
    from weight a to b over d, a*x + (b-a)/d*x*x/2 = rest is solved for x."""
    by_kind = F.lit(None).cast("double")
    for k, weights in reversed(list(enumerate(schedules))):
        w, upto = integrals(weights, knots)
        at = F.lit(knots[-1])
        for i in reversed(range(len(knots) - 1)):
            a, b, d = w[i], w[i + 1], knots[i + 1] - knots[i]
            rest, slope = share - F.lit(upto[i]), (b - a) / d
            root = F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0)))
            x = F.when(root + a > 0, 2 * rest / (root + a)).otherwise(F.lit(0.0))
            at = F.when(share <= upto[i + 1], F.lit(knots[i]) + F.least(F.lit(d), F.greatest(F.lit(0.0), x))).otherwise(at)
        by_kind = F.when(kind == k, at).otherwise(by_kind)
    return by_kind


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size) to (source, source_size, kind, target).

    Sources by code point, null last, weigh as `weights` says, repeating, and share the sum of all
    sizes. A target stops at cap times its source's size and the excess is reshared by weight: the
    fixed point is filled in the order of cap/weight, so running sums over the sorted sources find it.
    The table has a row per source, as a mixing plan does; it goes through one task.
    """
    by_name, everything = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")), Window.partitionBy()
    kind = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    table = sizes.withColumn("kind", kind).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("kind") + 1).cast("int")))
    table = table.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, on = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(on)
    table = table.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    table = table.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return table.select("source", "source_size", F.col("kind").cast("int").alias("kind"), target.alias("target"))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: int = 3,
    knots: Sequence[float] = KNOTS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    blocks: int = 16_384,
) -> DataFrame:
    """One row per row of docs: (doc_id, file, row, mix, size, source, source_size, target, taken, copies,
    positions); file and row are its place, positions the training times of its copies.

    Size counts runs of non-whitespace (null and blank texts: 0; such rows are never due and are taken
    0 times). A source's rows stand in the order of mix, the md5 of id and text (null ones as empty); rows that
    repeat in both follow one another by their place. Passes over the source follow one another until its
    target is met, to within half a document; cap bounds the passes. A null source is a source. Empty
    input gives no rows.
    """
    docs = filed(docs.select(*dict.fromkeys([id_col, text_col, source_col])))
    text, source = F.coalesce(F.col(text_col), F.lit("")), F.col(source_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_count(text, F.lit(WORD_RUN)).cast("long").alias("size"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("src"),  # never null
        F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))).alias("mix"),
        place(docs).alias("place"),
    )
    chunk = F.floor(F.col("row") / CHUNK_ROWS)
    rows = stored(rows.select("doc_id", "size", "source", "src", "mix", "place.*").withColumn("chunk", chunk), "sizes", narrow=False)
    # A source is too large for one task, and so may be the rows of one id and text. Equal rows of one chunk
    # of a file are one line of the order; running sums go within a block of the order, and blocks are
    # offset by the sums of those before.
    block = F.floor(F.conv(F.hex(F.substring("mix", 1, 3)), 16, 10).cast("long") * blocks / (1 << 24)).cast("int")
    lines = rows.groupBy(*LINE).agg(F.first("source").alias("source"), F.sum("size").alias("in_line")).withColumn("block", block)
    lines = stored(lines, "lines")
    sums = stored(lines.groupBy("src", "block").agg(F.first("source").alias("source"), F.sum("in_line").alias("in_block")), "blocks")
    targets = source_targets(sums.groupBy("source").agg(F.sum("in_block").alias("source_size")), weights, cap)
    targets = targets.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    before = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("in_block").over(before), F.lit(0))).join(targets, "src")
    within = Window.partitionBy("src", "block").orderBy("mix", "file", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("ahead", F.coalesce(F.sum("in_line").over(within), F.lit(0)))
    lines = lines.join(sums.drop("source", "in_block"), ["src", "block"]).withColumn("ahead", F.col("base") + F.col("ahead"))
    nth = F.row_number().over(Window.partitionBy(*LINE).orderBy("row")) - 1
    rows = rows.withColumn("nth", nth).join(lines.select(*LINE, "ahead", "source_size", "target", "kind"), LINE)
    middle = lambda k: F.lit(k) * F.col("source_size") + F.col("ahead") + F.col("nth") * F.col("size") + F.col("size") / 2
    due = F.array(*[F.when((F.col("size") > 0) & (middle(k) <= F.col("target")), invert(F.col("kind"), middle(k) / F.col("target"), knots, schedules)) for k in range(cap)])
    rows = rows.withColumn("positions", F.array_compact(due)).withColumn("copies", F.size("positions"))
    return rows.select(
        "doc_id", "file", "row", "mix", "size", "source", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "positions"
    )


#: Copies due at one time stand by the order of their rows in the mix.
ORDER = ["position", "mix", "file", "row", "copy"]


def in_order(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df range-sorted by training position."""
    dealt = df.repartitionByRange(partitions, *ORDER) if partitions else df.repartitionByRange(*ORDER)
    return dealt.sortWithinPartitions(*ORDER)


def mixed_order(plan: DataFrame, partitions: int | None = None) -> DataFrame:
    """The taken copies of plan_mix in training order: (rank, position, doc_id, mix, file, row, copy,
    size, source). Ranks run gapless from 0: sorted ranges are numbered by themselves, and offset by the
    sizes of those before."""
    copies = plan.select("doc_id", "mix", "file", "row", "size", "source", F.posexplode("positions").alias("copy", "position"))
    sorted_ = stored(in_order(copies, partitions).withColumn("n", F.monotonically_increasing_id()), "order", narrow=False)
    part = F.shiftright("n", 33).alias("part")
    ends = sorted_.groupBy(part).agg(F.count(F.lit(1)).alias("many"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ends = ends.select("part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    ranked = sorted_.withColumn("part", F.shiftright("n", 33)).join(ends, "part")
    inside = F.col("n").bitwiseAND((1 << 33) - 1)
    return ranked.select((F.col("base") + inside).alias("rank"), "position", "doc_id", "mix", "file", "row", "copy", "size", "source")


def mixed_documents(docs: DataFrame, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it, in training order. Rows that repeat are
    told apart by their place."""
    docs = filed(docs)
    plan = plan_mix(docs, id_col=id_col, text_col=text_col, **options).where("copies > 0")
    plan = stored(plan.select(F.struct("file", "row").alias("__at"), "mix", "positions"), "plan")
    inner = [F.col(c).alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    copies = docs.select(place(docs).alias("__place"), *inner).join(plan, F.col("__place") == F.col("__at"))
    copies = copies.select(*[f"__c{i}" for i in range(len(inner))], "mix", "__at.file", "__at.row", F.posexplode("positions").alias("copy", "position"))
    return in_order(copies, partitions).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
