"""Benchmark decontamination with a distributed positional inverted index.

The index holds the postings of every term of the documents, and does not depend on the test set. It is
cut by documents, as search clusters do: a segment holds some documents' postings, term by term, with
sorted positions, and is stored as one row of a Parquet table. Searching a segment needs no shuffle: the
list of a test window's rarest term in the segment gives the candidates, which are cut down by the lists
of the other terms, rarest first: adjusted by their offsets for exact phrases, within a span for
proximity matches. Test windows are searched in blocks of bounded number over the one index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import filed, pieces, place, stored, text_bytes, words

WINDOW = 10
#: Words of a document among which all terms of a window make a proximity match.
SPAN = 20
SEGMENT_BYTES = 512 << 10
#: Test windows that are searched at once: what a task holds of the test set.
BLOCK_WINDOWS = 1 << 19
#: Candidates whose surroundings are looked at at once.
CHUNK = 1 << 15
POSTINGS = ("n_words", "firsts", "terms", "counts", "postings")


class Terms:
    """Words as 64-bit values."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes | None) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        return np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words(text)], np.uint64).view(np.int64)


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The segments of docs (row, doc_id, text): per segment the documents' rows, ids, word counts and
    first slots, and per term (sorted) the sorted slots where it stands. Each document is followed by a
    free slot, so that no window runs from one into the next. A text is never cut."""
    schema = T.StructType(
        [T.StructField("rows", T.ArrayType(docs.schema["row"].dataType)), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType))]
        + [T.StructField(x, T.ArrayType(T.LongType() if x == "terms" else T.IntegerType())) for x in POSTINGS]
    )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        into, terms_of = to_arrow_schema(schema), Terms()
        for batch in batches:
            for piece in pieces([batch], "text", segment_bytes):
                found = [terms_of.of(raw) for raw in text_bytes(piece, "text")]
                n = np.array([len(x) for x in found], np.int32)
                firsts = np.concatenate([[0], np.cumsum(n + 1)[:-1]]).astype(np.int32)
                slots = np.concatenate([np.arange(k, dtype=np.int32) + f for k, f in zip(n, firsts, strict=True)])
                every = np.concatenate(found)
                order = np.argsort(every, kind="stable")
                terms, counts = np.unique(every, return_counts=True)
                columns = [n, firsts, terms, counts.astype(np.int32), slots[order]]
                lists = [pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(k)).cast(into.field(i).type) for i, k in enumerate(("row", "doc_id"))]
                yield pa.RecordBatch.from_arrays([*lists, *[pa.array([x], type=f.type) for x, f in zip(columns, list(into)[2:], strict=True)]], schema=into)

    return docs.select("row", "doc_id", "text").mapInArrow(segments, schema)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Items (id, text) to rows (item, window): every `window` words in a row as an array of 64-bit terms; all
    of them where an item has fewer. Items without words have no window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of = Terms()
        for batch in batches:
            for item, text in zip(batch.column("id").to_pylist(), text_bytes(batch, "text"), strict=True):
                own = terms_of.of(text)
                for start in range(0, max(1, len(own) - window + 1) if len(own) else 0, 4096):
                    some = [own[i : i + window] for i in range(start, min(start + 4096, max(1, len(own) - window + 1)))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array(some, pa.list_(pa.int64()))], names=["item", "window"])

    return items.select("id", "text").mapInArrow(cut, "item string, window array<bigint>")


class Segment:
    """A segment's lists, and the view of them by slot. Terms are numbered within the segment."""

    def __init__(self, row: dict[str, np.ndarray]):
        self.n_words, self.firsts = np.asarray(row["n_words"], np.int64), np.asarray(row["firsts"], np.int64)
        self.terms, self.counts = np.asarray(row["terms"], np.int64), np.asarray(row["counts"], np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        self.postings = np.asarray(row["postings"], np.int64)
        self.size = int((self.n_words + 1).sum())
        self.at = np.full(self.size, -1, np.int32)
        self.at[self.postings] = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.counts)

    def lists(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of several terms one after the other, and whose each is."""
        n = self.counts[which]
        owner = np.repeat(np.arange(len(which)), n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return self.postings[self.begin[which][owner] + inside], owner

    def document(self, slot: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, slot, side="right") - 1


@dataclass
class Block:
    """Test windows as a matrix of term numbers, -1 after the end of shorter ones; the terms; and the items
    of each window. Windows are looked up by their lead, the term of theirs that fewest windows have."""

    terms: np.ndarray
    windows: np.ndarray
    items: list[list[str]]

    def __post_init__(self) -> None:
        often = np.append(np.bincount(self.windows[self.windows >= 0], minlength=len(self.terms)), np.iinfo(np.int64).max)  # -1 is never the least
        each = np.arange(len(self.windows))
        lead = self.windows[each, often[self.windows].argmin(axis=1)] if len(each) else each
        self.by_lead = np.argsort(lead, kind="stable")
        self.many = np.bincount(lead, minlength=len(self.terms))
        self.begin = np.cumsum(self.many) - self.many
        self.number = np.full(len(self.terms) + 1, -1, np.int32)  # a segment's numbers of its terms, while it is searched
        self.number[-1] = -2  # what is after a window's end stays apart from absent terms

    @classmethod
    def of(cls, rows: DataFrame, window: int) -> Block:
        """Of rows (window, items): a block of them, which the driver holds for a while."""
        table = rows.toArrow()
        lists = table["window"].combine_chunks()
        length = lists.value_lengths().to_numpy()
        terms, number = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        windows = np.full((len(length), window), -1, np.int32)
        windows[np.arange(window)[None, :] < length[:, None]] = number
        return cls(terms, windows, table["items"].to_pylist())

    def inside(self, seg: Segment) -> tuple[np.ndarray, np.ndarray]:
        """The windows all of whose terms are in the segment, and those terms by the segment's numbers; -1 after the last. The
        segment's terms are looked up among the block's, and only windows whose lead is there are looked at, so the
        cost goes with the segment and with what may match in it, not with the number of windows."""
        if not len(self.terms) or not len(seg.terms):
            return np.empty(0, np.int64), np.empty((0, self.windows.shape[1]), np.int32)
        at = np.minimum(np.searchsorted(self.terms, seg.terms), len(self.terms) - 1)
        found = np.flatnonzero(self.terms[at] == seg.terms)
        there = at[found]
        self.number[there] = found
        n = self.many[there]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        have = np.sort(self.by_lead[np.repeat(self.begin[there], n) + inner])
        for j in range(self.windows.shape[1]):
            column = self.windows[have, j]
            have = have[(column < 0) | (self.number[column] >= 0)]
        local = np.where(self.windows[have] < 0, -1, self.number[self.windows[have]]).astype(np.int32)
        self.number[there] = -1
        return have, local

    @staticmethod
    def rarest_first(local: np.ndarray, seg: Segment) -> np.ndarray:
        often = np.where(local < 0, np.iinfo(np.int64).max, seg.counts[local] if len(seg.counts) else 0)
        return np.argsort(often, axis=1, kind="stable")


def phrases(have: np.ndarray, local: np.ndarray, order: np.ndarray, seg: Segment) -> tuple[np.ndarray, np.ndarray]:
    """(window, first slot) of every occurrence of the windows with all their terms in the segment."""
    if not len(have):
        return have, have
    each = np.arange(len(have))
    slots, owner = seg.lists(local[each, order[:, 0]])
    start = slots - order[owner, 0]
    ok = (start >= 0) & (start + (local >= 0).sum(axis=1)[owner] <= seg.size)
    owner, start = owner[ok], start[ok]
    for j in range(1, local.shape[1]):
        offset = order[owner, j]
        term = local[owner, offset]
        ok = (term < 0) | (seg.at[np.minimum(start + offset, seg.size - 1)] == term)
        owner, start = owner[ok], start[ok]
    return owner, start


def near(local: np.ndarray, order: np.ndarray, seg: Segment, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, slot of its rarest term) of every proximity match: `span` words of one document in a row, that
    slot among them, hold all terms of the window, in any order.

    Each slot p of the rarest term has `span` stretches that hold it, from p - span + 1 on. A term's
    occurrences around p mark the stretches that hold it too; what is marked for all terms is a match. Of
    windows with the same two rarest terms, the candidates are looked for once.
    """
    width = 2 * span - 1
    around = np.full(seg.size + 2 * (span - 1), -1, np.int32)
    around[span - 1 : span - 1 + seg.size] = seg.at
    view = np.lib.stride_tricks.sliding_window_view(around, width)
    first = np.take_along_axis(local, order[:, :1], 1)[:, 0].astype(np.int64)
    second = np.take_along_axis(local, order[:, 1:2], 1)[:, 0].astype(np.int64) if local.shape[1] > 1 else np.full(len(local), -1)
    _, lead, member = np.unique(first * (len(seg.terms) + 1) + second + 1, return_index=True, return_inverse=True)
    slots, pair = seg.lists(first[lead])

    step = np.arange(-(span - 1), span, dtype=np.int32)[None, :]

    def stretches(terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the stretches around the slots hold the terms, inside the slot's document; all, for no term."""
        there = view[at] == terms[:, None].astype(np.int32)
        out = np.repeat((terms < 0)[:, None], span, axis=1)
        some = np.flatnonzero(there.any(axis=1) & (terms >= 0))
        doc = seg.document(at[some])
        left, right = seg.firsts[doc] - at[some], seg.firsts[doc] + seg.n_words[doc] - at[some]
        inside = there[some] & (step >= left[:, None].astype(np.int32)) & (step < right[:, None].astype(np.int32))
        sums = np.concatenate([np.zeros((len(some), 1), np.int32), np.cumsum(inside, axis=1, dtype=np.int32)], axis=1)
        out[some] = sums[:, span:] > sums[:, :-span]
        return out

    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(slots), CHUNK):
        at, who = slots[i : i + CHUNK], pair[i : i + CHUNK]
        marks = stretches(second[lead][who], at)
        ok = marks.any(axis=1)
        kept.append((at[ok], who[ok], marks[ok]))
    if not kept:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, who, marks = (np.concatenate(x) for x in zip(*kept, strict=True))
    by_pair = np.argsort(member, kind="stable")
    many = np.bincount(member, minlength=len(lead))
    begin = np.cumsum(many) - many
    window: list[np.ndarray] = []
    found: list[np.ndarray] = []
    for i in range(0, len(at), CHUNK):
        rows = np.arange(i, min(i + CHUNK, len(at)))
        n = many[who[rows]]
        own = np.repeat(rows, n)
        w = by_pair[np.repeat(begin[who[rows]], n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)]
        for k in range(0, len(own), CHUNK):
            o, v = own[k : k + CHUNK], w[k : k + CHUNK]
            m = marks[o]
            for j in range(2, local.shape[1]):
                m = m & stretches(local[v, order[v, j]], at[o])
                ok = m.any(axis=1)
                o, v, m = o[ok], v[ok], m[ok]
            window.append(v)
            found.append(at[o])
    return (np.concatenate(window), np.concatenate(found)) if window else (np.empty(0, np.int64), np.empty(0, np.int64))


def search(index: DataFrame, shared: Broadcast[tuple], span: int = SPAN) -> DataFrame:
    """One row per document of the index: (row, doc_id, n_words, hits, items, near): the positions of its
    words inside any occurrence of a window of the block, the sorted distinct items with occurring windows,
    and those with proximity matches."""
    schema = T.StructType(
        [T.StructField(k, index.schema[c].dataType.elementType) for k, c in (("row", "rows"), ("doc_id", "doc_ids"))]
        + [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType()))]
        + [T.StructField(k, T.ArrayType(T.StringType())) for k in ("items", "near")]
    )

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        block, into = Block(*shared.value), to_arrow_schema(schema)

        def items_of(seg: Segment, windows: np.ndarray, slots: np.ndarray) -> list[list[str]]:
            of: dict[int, set[str]] = {}
            pairs = np.unique(seg.document(slots) * len(block.windows) + windows) if len(slots) else []
            for d, w in ((int(x) // len(block.windows), int(x) % len(block.windows)) for x in pairs):
                of.setdefault(d, set()).update(block.items[w])
            return [sorted(of.get(d, ())) for d in range(len(seg.n_words))]

        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment({k: batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in POSTINGS})
                have, local = block.inside(seg)
                order = block.rarest_first(local, seg)
                owner, start = phrases(have, local, order, seg)
                hits: list = [[]] * len(seg.n_words)
                if len(owner):
                    length = (local >= 0).sum(axis=1)[owner]
                    cover = np.bincount(start, minlength=seg.size + 1) - np.bincount(start + length, minlength=seg.size + 1)
                    slots = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                    doc = seg.document(slots)
                    cuts = np.searchsorted(doc, np.arange(len(hits) + 1))
                    for d in np.unique(doc):
                        hits[d] = slots[cuts[d] : cuts[d + 1]] - seg.firsts[d]
                about, spots = near(local, order, seg, span) if len(have) else (have, have)
                columns = [seg.n_words, hits, items_of(seg, have[owner], start), items_of(seg, have[about], spots)]
                made = [pa.array(x, type=f.type) for x, f in zip(columns, list(into)[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("rows")[i].values, batch.column("doc_ids")[i].values, *made], schema=into)

    return index.mapInArrow(matches, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str | None = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    span: int = SPAN,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per row of docs: (row, doc_id, n_words, hits, items, near); row is its place.

    Exact phrases: hits are the positions of its words inside any occurrence of a window of an item,
    `window` words in a row; items those with such windows. Proximity: near are the items of which all
    terms of one window stand among `span` words in a row, in any order; with a span of the window's
    length or more, items of phrases are among them. Words are told by 64-bit values; id_col None gives null ids.

    Null and empty texts have no words; an item of fewer words than a window, but not none, is one
    window. Items that repeat an id count once; a null id counts as an empty string. The one index is
    searched for `block_windows` distinct windows at a time, so that what the driver and the tasks hold
    of the test set is bounded; test sets are small, and mostly one block. Empty documents or benchmarks
    give no rows or no hits. Other columns are not read.
    """
    docs = filed(docs.select(*dict.fromkeys([c for c in (id_col, text_col) if c is not None])))
    doc_id = F.lit(None).cast("long") if id_col is None else F.col(id_col)
    rows = docs.select(place(docs).alias("row"), doc_id.alias("doc_id"), F.col(text_col).alias("text"))
    index = stored(build_index(rows), "index", narrow=False, wide_rows=True)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(item_text_col).alias("text"))
    windows = item_windows(items, window).groupBy("window").agg(F.collect_set("item").alias("items"))
    windows = stored(windows, "windows")
    share = lambda b: docs.sparkSession.sparkContext.broadcast((b.terms, b.windows, b.items))  # noqa: E731  # plain data: executors need not have the class
    blocks = -(-windows.count() // block_windows) or 1
    if blocks == 1:
        return search(index, share(Block.of(windows, window)), span)
    found: DataFrame | None = None
    for b in range(blocks):  # the results of one block are stored before the next is made
        shared = share(Block.of(windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b), window))
        one = stored(search(index, shared, span), "found", narrow=False)
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x) for x in ("hits", "items", "near")]
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *merged)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, without the rows whose text has a word inside an occurrence of a test window.
    Rows are told by their place; repeated rows have the same text, and go or stay together."""
    docs = filed(docs)
    found = decontaminate(docs.select(text_col), benchmark, id_col=None, text_col=text_col, **options)
    gone = stored(found.where(F.size("hits") > 0).select(F.col("row").alias("__gone")), "contaminated")
    return docs.join(gone, place(docs) == F.col("__gone"), "left_anti")
