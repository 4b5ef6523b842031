"""Spelling variants: words that are one insertion, deletion or replacement apart, grouped under the commonest.

Every word gives a key for each of its letters, the hash of the word without it, and one of the whole word. The
keys come from running polynomial hashes: what stands before the letter plus what stands after it, moved one
place down. Two words are near if they share the key without a letter at the same place (a replacement), or if
the whole of one is the other without a letter. Keys are dealt by their leading bits and sorted; equal keys lie
side by side there, and only words with such a neighbour go on, to be compared as strings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import lowered, pieces, stored, text_bytes

#: Letters of a word whose A-Z are lower-cased.
LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Of the occurrences of a run in a document, those whose checksum this divides lose a letter.
NOISE = 97
SHORTEST, RAREST = 5, 3
#: A form is at least so many times as common as its variant.
RATIO = 2
#: Distinct words that a task counts before it sends them on.
HELD_WORDS = 200_000
#: Letters whose keys are made at once.
KEYED_BYTES = 1 << 20
RADIX_BITS = 16

#: Fixed values of the hash: an odd base and the multipliers of a published 64-bit mixer.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIXERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * MIXERS[0]
    x = (x ^ (x >> np.uint64(27))) * MIXERS[1]
    return x ^ (x >> np.uint64(31))


def noted(runs: Iterable[str], doc_id: str, noise: int = NOISE) -> Counter[str]:
    """How often each word comes of a document's runs. A run whose crc32 of `<doc_id>:<run>` is divided by
    `noise` loses the letter at that crc32 modulo its length; all of a document's equal runs do alike."""
    before, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for word, n in Counter(runs).items():
        h = zlib.crc32(word.encode(), before)
        if h % noise == 0:
            gone = h % len(word)
            word = word[:gone] + word[gone + 1 :]
        out[word] += n
    return out


def count_words(docs: DataFrame, shortest: int, rarest: int) -> DataFrame:
    """Rows (doc_id string, text) to (word, n) of all words of that many letters and occurrences. A task adds up the
    words it meets before they are shuffled, so frequent ones come to each merge once per some thousand texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            made = [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(made, names=["word", "n"])

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), text_bytes(batch, "text"), strict=True):
                if raw:
                    for word, n in noted(LETTERS.findall(lowered(raw).decode("utf-8", "replace")), doc_id).items():
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield sent()
                    held.clear()
        yield sent()

    words = docs.mapInArrow(counted, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, at, owner, first) of every word: the key without the letter at `at`, and, with at -1, of the whole. Of a row
    of equal letters it is the same string whichever goes: `first` marks the first of them (and whole words)."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)
    start = end - size
    at = np.arange(len(codes)) - start[owner]
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size.max(initial=0), BASE)]))
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(codes.astype(np.uint64) + BASE) * power[at])])
    here = np.arange(len(codes))
    without = sums[here] - sums[start[owner]] + (sums[end[owner]] - sums[here + 1]) * inverse
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (at[1:] == 0)
    key = mixed(np.concatenate([without, sums[end] - sums[start]]))
    whole = np.full(len(words), -1)
    return key, np.concatenate([at, whole]), np.concatenate([owner, np.arange(len(words))]), np.concatenate([first, whole < 0])


def sorted_keys(words: DataFrame) -> DataFrame:
    """(key, at, id, first) of the words (id, word), dealt by the key's leading bits and sorted by it."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "word", KEYED_BYTES):
            key, at, owner, first = deletion_keys(piece.column("word").to_pylist())
            ids = piece.column("id").to_numpy()
            for i in range(0, len(key), 1 << 16):
                part = slice(i, i + (1 << 16))
                made = [pa.array(key[part].view(np.int64)), pa.array(at[part], pa.int32()), pa.array(ids[owner[part]]), pa.array(first[part])]
                yield pa.RecordBatch.from_arrays(made, names=["key", "at", "id", "first"])

    keys = words.select("id", "word").mapInArrow(keyed, "key long, at int, id long, first boolean")
    return keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key", "at")


def neighbours(keys: DataFrame) -> DataFrame:
    """(key, at, id, swapped, cut) of sorted keys: only rows that share their key and place with another (swapped), or
    that are a whole word and the others without a letter (cut). Equal keys come one after the other, and
    are no more than the words one letter longer than a string, so a task holds little beyond its batch."""

    def kept(key: np.ndarray, at: np.ndarray, ids: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        new_at = new | np.concatenate([[True], at[1:] != at[:-1]])
        same = np.cumsum(new_at) - 1
        swapped = (np.bincount(same)[same] > 1) & (at >= 0)
        whole = np.bincount(group, at < 0) > 0
        longer = np.bincount(group, (at >= 0) & first) > 0
        cut = (whole & longer)[group] & ((at < 0) | first)
        on = np.flatnonzero(swapped | cut)
        made = [pa.array(x[on]) for x in (key, at, ids, swapped, cut)]
        return pa.RecordBatch.from_arrays(made, names=["key", "at", "id", "swapped", "cut"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))  # where the last key begins; the next batch may go on with it
            if held and (last or columns[0][0] != held[0][0][0]):
                yield kept(*[np.concatenate([*[h[i] for h in held], columns[i][:last]]) for i in range(4)])
                held = []
            elif last:
                yield kept(*[c[:last] for c in columns])
            held.append([c[last:] for c in columns])
        if held:
            yield kept(*[np.concatenate([h[i] for h in held]) for i in range(4)])

    return keys.mapInArrow(scanned, "key long, at int, id long, swapped boolean, cut boolean")


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words (id, word, n) that are near another: how many are, and the commonest of them as
    struct(less, word), less being minus its count; of equally common ones the smallest in code-point order.

    Words with a common key are compared as strings: they are grouped by what is left of them. A group has at
    most as many words as there are letters to insert, so it is counted as a whole; no pairs are made."""
    found = stored(neighbours(sorted_keys(words)).join(words, "id"), "neighbours")
    left = F.when(F.col("at") < 0, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)")))
    found = found.withColumn("left", left).withColumn("one", F.struct((-F.col("n")).alias("less"), "word"))
    swapped = found.where("swapped").groupBy("key", "at", "left").agg(F.array_sort(F.collect_list(F.struct("one", "id"))).alias("all")).where(F.size("all") > 1)
    swapped = swapped.select((F.size("all") - 1).alias("many"), F.get("all", F.lit(0))["one"].alias("top"), F.get("all", F.lit(1))["one"].alias("next"), F.explode("all").alias("x"))
    swapped = swapped.select("x.id", "many", F.when(F.col("x.one") == F.col("top"), F.col("next")).otherwise(F.col("top")).alias("best"))
    whole = lambda c: F.max(F.when(F.col("at") < 0, F.col(c)))
    cut = found.where("cut").groupBy("key", "left").agg(
        whole("id").alias("id"), whole("one").alias("one"), F.array_sort(F.collect_list(F.when(F.col("at") >= 0, F.struct("one", "id")))).alias("longer")
    )
    cut = cut.where(F.col("id").isNotNull() & (F.size("longer") > 0))
    shorter = cut.select("id", F.size("longer").alias("many"), F.get("longer", F.lit(0))["one"].alias("best"))
    longer = cut.select("one", F.explode("longer").alias("x")).select("x.id", F.lit(1).alias("many"), F.col("one").alias("best"))
    return swapped.unionByName(shorter).unionByName(longer).groupBy("id").agg(F.sum("many").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where forms (word, form) lead to in the end. Each round doubles how far a word has been followed;
    counts at least double from a word to its form, so there are few rounds."""
    ahead = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = stored(ahead.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        moved = not further.where("moved").isEmpty()
        ahead = further.select("word", "root")
        if not moved:
            return ahead


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: (word, form, root, n, n_near, form_n).

    Words are runs of the letters A-Z, lower-cased, and of those from U+00C0 to U+00FF, which stay as they are; some
    of the runs lose a letter, as `noted` says. Counted are those of at least `shortest` letters and `rarest`
    occurrences in all texts. Words are near if one inserted, deleted or replaced letter tells them apart: n_near
    of them. The form is the near word of largest count (ties: the smallest in code-point order), if that is at least
    `ratio` times the word's own, else null; the root is where forms lead to, the word itself without one.

    Null and empty texts have no words, a null id is an empty string in `noted`. Repeated rows count as often as they
    come. No rows, or none with such words, give no rows. Other columns are not read. With a ratio below 2 forms
    might go round, so that is an error.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as common as its variant")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).alias("text"))
    words = stored(count_words(rows, shortest, rarest).withColumn("id", F.monotonically_increasing_id()), "words")
    near = stored(near_words(words), "near")
    common = lambda c: F.when(-F.col("best.less") >= F.lit(ratio) * F.col("n"), c)
    judged = words.join(near, "id", "left")
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), common(F.col("best.word")).alias("form"), common(-F.col("best.less")).alias("form_n"))
    judged = stored(judged, "forms")
    found = judged.join(roots(judged.where(_has("form"))), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _has(name: str) -> Column:
    return F.col(name).isNotNull()
