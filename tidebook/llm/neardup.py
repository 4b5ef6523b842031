"""N-gram Jaccard join by MinHash banding.

Documents with equal n-gram sets are one class from the start. Classes that agree in all rows of a band
meet in a bucket; band and row counts are chosen for the target recall at the threshold. A bucket's
members are not paired there: they are sent to the bucket's leader, its smallest class, and groups
whose leaders meet elsewhere are joined under one of them, so that a class travels to few groups however
many bands agree. The full n-gram sets of the members are made once, from one text each, and stored. A
group is cut into parts of bounded size; a tile, two parts, verifies its pairs on the full sets with
matrix products, and returns counts and spanning links, never the pairs themselves. Components of the
links are the duplicate classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import filed, place, stored, text_bytes, words

#: Least and most classes and n-grams of a part. In between, a group has up to about PARTS parts, so that a
#: set travels to no more tiles than that until parts are as large as a task should hold.
PART_DOCS, PART_GRAMS = (128, 1024), (250_000, 2_000_000)
PARTS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): most rows, thus fewest false candidates, such that pairs at the threshold share a
    band with probability `recall` at least and no more than `hashes` hash values are needed."""
    best = None
    for rows in range(1, hashes + 1):
        miss = math.log1p(-(threshold**rows)) if threshold < 1 else -math.inf
        if miss and (bands := max(1, math.ceil(math.log(1 - recall) / miss))) * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def grams_of(n: int) -> Callable[[bytes | None], np.ndarray]:
    """A function from a text to its sorted distinct n-grams of words as 64-bit values. A text of fewer
    words, but not none, is one n-gram; without words there is none."""
    known: dict[bytes, int] = {}

    def grams(text: bytes | None) -> np.ndarray:
        found = words(text)
        if not found:
            return np.empty(0, np.uint64)
        if len(known) > 500_000:
            known.clear()
        ids = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in found], np.uint64)
        size = min(n, len(ids))
        out = np.full(len(ids) - size + 1, size, np.uint64)
        for j in range(size):
            out = (out ^ (out >> np.uint64(29))) * _MIX + ids[j : j + len(out)]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return np.unique(out ^ (out >> np.uint64(29)))

    return grams


def band_hashes(grams: np.ndarray, factors: np.ndarray, shifts: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit value per band of the set's MinHash signature."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    signature = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(signature, (low[i : i + 1024, None] * factors + shifts).min(axis=0), out=signature)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in signature.reshape(bands, -1).T.astype(np.uint64):
        out = (out ^ (out >> np.uint64(31))) * _MIX + column
    return ((out ^ (out >> np.uint64(30))) * _MIX).view(np.int64)


def sketches(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 11) -> DataFrame:
    """(doc_id, row, file, file_row) to + (grams, digest, buckets): the number of n-grams, a digest of the
    set, and its bucket in each band. Texts without words get a digest of their own and no bucket."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    kept = ("doc_id", "row", "file", "file_row")
    schema = T.StructType(
        [docs.schema[k] for k in kept]
        + [T.StructField("grams", T.LongType())]
        + [T.StructField("digest", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.LongType()))]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = grams_of(n)
        for batch in batches:
            counts, digests, buckets = [], [], []
            for row, text in zip(batch.column("row").to_pylist(), text_bytes(batch, "text"), strict=True):
                own = grams(text)
                counts.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else b"none%d" % row)
                buckets.append(band_hashes(own, factors, shifts, bands) if len(own) else [])
            new = [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *new], names=schema.names)

    return docs.mapInArrow(sketch, schema)


def gram_sets(members: DataFrame, n: int) -> DataFrame:
    """(row, copies, roots, text) to (row, copies, roots, set): the n-grams of the text as 64-bit values."""
    schema = T.StructType([*[members.schema[k] for k in ("row", "copies", "roots")], T.StructField("set", T.BinaryType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = grams_of(n)
        for batch in batches:
            made = pa.array([grams(text).tobytes() for text in text_bytes(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in schema.names[:-1]], made], names=schema.names)

    return members.mapInArrow(sets, schema)


def linked_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets have a Jaccard similarity of the threshold or more, as a matrix."""
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[gram] > 1  # others meet nobody
    gram, owner = gram[shared], owner[shared]
    number = np.cumsum(times > 1) - 1
    order = np.argsort(gram, kind="stable")
    column, owner = number[gram[order]], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for i in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (i, i + width))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], column[a:b] - i] = 1
        common += x @ x.T
    ok = common >= threshold / (1 + threshold) * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(ok, False)
    return ok


def spanning(ok: np.ndarray) -> np.ndarray:
    """For each member the smallest index of its component."""
    low = np.arange(len(ok))
    seen = np.zeros(len(ok), bool)
    for i in range(len(ok)):
        if not seen[i]:
            part = np.zeros(len(ok), bool)
            part[i] = True
            edge = part
            while edge.any():
                edge = ok[edge].any(axis=0) & ~part
                part |= edge
            seen |= part
            low[part] = i
    return low


def met_before(roots: list[list[int]], root: int) -> np.ndarray:
    """Which members meet under a smaller root than this one, as a matrix."""
    smaller = {r: i for i, r in enumerate(sorted({r for own in roots for r in own if r < root}))}
    x = np.zeros((len(roots), len(smaller)), np.float32)
    for i, own in enumerate(roots):
        x[i, [smaller[r] for r in own if r < root]] = 1
    return x @ x.T > 0


def verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """Rows (root, a, b, part, row, copies, roots, set), dealt and sorted by tile (root, a, b), to
    (row, links, low): the documents its class links to in this tile, and the smallest class of its
    component there. Tiles a < b compare part a with part b only. A pair of classes that meet under
    several roots counts under the smallest."""
    schema = "row long, links long, low long"

    def tile(root: int, a: int, b: int, members: dict[int, tuple]) -> tuple[list, list, list]:
        rows = sorted(members)
        ok = linked_pairs([members[r][3] for r in rows], threshold)
        part = np.array([members[r][0] for r in rows])
        if a != b:
            ok &= part[:, None] != part[None, :]
        ok &= ~met_before([members[r][2] for r in rows], root)
        links = ok @ np.array([members[r][1] for r in rows], np.int64)
        have = np.flatnonzero(ok.any(axis=1))
        low = spanning(ok)
        return [rows[i] for i in have], [int(links[i]) for i in have], [rows[low[i]] for i in have]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, {}
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if len(members) > 1:
                for into, got in zip(out, tile(*key, members), strict=True):
                    into.extend(got)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("root", "a", "b", "part", "row", "copies", "roots", "set")]
            for *at, part, row, copies, roots, grams in zip(*columns, strict=True):
                if at != key:
                    close()
                    key, members = at, {}
                members[row] = (part, copies, roots, np.frombuffer(grams, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["row", "links", "low"])
            out = ([], [], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["row", "links", "low"])

    return tiles.mapInArrow(verify, schema)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, root): the smallest node of each component, by alternating large and small
    stars. Every round is a stored table; minima are aggregated before they are joined, so that a node
    with very many links goes through no single task."""
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")), "large")
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(large.where("u <> v").distinct(), "edges")
        low = stored(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"), "small")
        small = edges.join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "edges")
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, hashes: int = 224
) -> DataFrame:
    """One row per row of docs: (doc_id, file, file_row, class_id, rep_id, n_links, kept); file and file_row
    are its place.

    Two documents are linked if the Jaccard similarity of their sets of n words in a row is at least
    the threshold; words are A-Z lower-cased. rep_id is the smallest id with the same set, class_id the
    smallest of the component of linked documents (null ids are the largest), n_links the number of
    documents linked to this one, exact copies included. A text of 1 to n - 1 words is one n-gram.
    Null, empty and wordless texts are linked to nothing: class and representative are their own id.
    kept is true for one row of each class, that with its smallest id; of rows that repeat in id and
    text, one is kept. No rows give no rows; other columns are not read.
    """
    bands, rows = choose_bands(threshold, recall, hashes)
    docs = filed(docs.select(*dict.fromkeys([id_col, text_col])))
    text = docs.select(F.col(id_col).alias("doc_id"), place(docs).alias("place"), F.col(text_col).alias("text"))
    numbered = text.select("doc_id", F.monotonically_increasing_id().alias("row"), "place.file", F.col("place.row").alias("file_row"), "text")
    sketch = stored(sketches(numbered, n, bands, rows), "sketches", narrow=False)
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "file", "file_row", "grams", "buckets")
    classes = sketch.where("grams > 0").groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select("digest", "copies", "best.*"), "classes")

    # buckets with more than one class, and their leaders
    dealt = classes.select("row", F.explode("buckets").alias("bucket"))
    leaders = dealt.groupBy("bucket").agg(F.min("row").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders = stored(leaders.select("bucket", "leader"), "leaders")
    led = stored(dealt.join(leaders, "bucket").select("row", "leader").distinct(), "led")
    hop = stored(led.groupBy("row").agg(F.min("leader").alias("root")).select(F.col("row").alias("leader"), "root"), "hops")
    rooted = stored(led.join(hop, "leader").groupBy("row").agg(F.collect_set("root").alias("roots")), "roots")

    # groups, their parts and tiles
    members = rooted.join(classes.select("row", "file", "file_row", "copies", "grams"), "row")
    members = stored(members, "members")
    groups = members.select(F.explode("roots").alias("root"), "grams").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("all"))
    size = lambda whole, ends: F.least(F.lit(ends[1]), F.greatest(F.lit(ends[0]), F.col(whole) / PARTS))
    parts = F.greatest(F.ceil(F.col("n") / size("n", PART_DOCS)), F.ceil(F.col("all") / size("all", PART_GRAMS)))
    groups = stored(groups.select("root", parts.cast("int").alias("parts"), "n").where("n > 1"), "groups")
    split = members.select("row", F.explode("roots").alias("root")).join(groups.select("root", "parts"), "root")
    split = split.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    split = split.groupBy("row").agg(F.collect_list(F.struct("root", "part", "parts")).alias("places"))
    wanted = members.select(F.struct("file", F.col("file_row").alias("row")).alias("m_place"), "row", "copies", "roots")
    # members grow with the documents: the same join at every size, not one that is broadcast while they are few
    texts = text.select("place", "text").join(wanted.hint("merge"), F.col("place") == F.col("m_place")).select("row", "copies", "roots", "text")
    sets = stored(gram_sets(texts, n), "sets", narrow=False)
    tiles = sets.join(split, "row").withColumn("place", F.explode("places")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("place.parts") - 1)))
    low, high = F.least("place.part", "other"), F.greatest("place.part", "other")
    tiles = tiles.select("place.root", low.alias("a"), high.alias("b"), "place.part", "row", "copies", "roots", "set")
    tiles = tiles.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    found = stored(verified(tiles, threshold), "links", narrow=False)

    # classes of linked documents
    root = components(found.select(F.col("row").alias("u"), F.col("low").alias("v")))
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    joined = classes.select("digest", "copies", "row", "no_id", "doc_id").join(links, "row", "left")
    joined = joined.join(root, F.col("row") == F.col("node"), "left").withColumn("root", F.coalesce("root", "row"))
    joined = stored(joined.select("digest", "copies", "row", "no_id", "doc_id", "root", F.coalesce("links", F.lit(0)).alias("links")), "rooted")
    smallest = joined.groupBy("root").agg(F.min(F.struct("no_id", "doc_id", "row")).alias("least"))
    smallest = stored(smallest.withColumnRenamed("root", "s_root"), "smallest")
    results = joined.join(smallest, F.col("root") == F.col("s_root"))
    results = results.select(
        F.col("digest").alias("r_digest"),
        F.col("doc_id").alias("rep_id"),
        F.col("least.doc_id").alias("class_id"),
        F.col("least.row").alias("keep_row"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"),
    )
    results = stored(results, "results")
    out = sketch.select("doc_id", "row", "file", "file_row", "digest").join(results, F.col("digest") == F.col("r_digest"), "left")
    alone = F.col("r_digest").isNull()
    return out.select(
        "doc_id",
        "file",
        "file_row",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, with one row of each class of near duplicates. Rows that repeat are told apart by
    their place."""
    docs = filed(docs)
    found = near_duplicates(docs.select(*dict.fromkeys([id_col, text_col])), id_col, text_col, **options).where(~F.col("kept"))
    gone = stored(found.select(F.struct("file", F.col("file_row").alias("row")).alias("__gone")), "dropped")
    return docs.join(gone, place(docs) == F.col("__gone"), "left_anti")
