"""The battery of op4, the scores of op10 and the file order of op2 against plain Python."""

from __future__ import annotations

import math
import random
from fractions import Fraction
from statistics import NormalDist

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidebook.llm import quality, secretscan, sharding

TAIL = lambda z: 1 - NormalDist().cdf(z) if z < 6 else math.erfc(z / math.sqrt(2)) / 2


def plain_battery(body: str, alphabet: str) -> tuple[float, float]:
    """(p_random, p_text) of a string over an alphabet."""
    n, size = len(body), len(alphabet)
    counts = [body.count(c) for c in alphabet]
    chi, df = sum((k - n / size) ** 2 / (n / size) for k in counts), size - 1
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    x = [alphabet.index(c) - (size - 1) / 2 for c in body]
    up, runs = sum(v > 0 for v in x), 1 + sum((a > 0) != (b > 0) for a, b in zip(x, x[1:], strict=False))
    mean = 2 * up * (n - up) / n + 1
    spread = math.sqrt(max(0.0, (mean - 1) * (mean - 2) / (n - 1)))
    z_runs = abs(runs - mean) / spread if spread else 40.0
    power = sum(v * v for v in x)
    z_serial = abs(sum(a * b for a, b in zip(x, x[1:], strict=False)) / power) * math.sqrt(n) if power else 40.0
    p_random = min(1.0, 3 * min(TAIL(z_chi), 2 * TAIL(z_runs), 2 * TAIL(z_serial)))
    more = n * (0.065 * size - 1)
    text = TAIL((df + more - chi) / math.sqrt(2 * (df + 2 * more)))
    k = sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:], strict=False))
    switches = float(sum(math.comb(n - 1, j) * 0.1**j * 0.9 ** (n - 1 - j) for j in range(k, n)))
    both = text * switches
    return p_random, min(1.0, switches if size == 16 else both * (1 - math.log(both)) if size <= 36 else text)


def test_battery_against_plain_python(spark):
    r = random.Random(12)
    strings = []
    for name, _, alphabet in secretscan.ENCODINGS:
        for n in (20, 33, 64, 150, 600):
            strings += ["".join(r.choices(alphabet, k=n)), "".join(r.choices(alphabet[: len(alphabet) // 2] + "23", k=n)), (alphabet[10:13] + "7abcDEF2" * 90)[:n]]
    rows = secretscan.battery(spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "row long, inside string")).collect()
    letters = {n: a for n, _, a in secretscan.ENCODINGS}
    assert len(rows) > 100 and {x.encoding for x in rows} == set(letters)
    for x in rows:
        p_random, p_text = plain_battery(strings[x.row], letters[x.encoding])
        assert x.p_random == pytest.approx(p_random, rel=0.03, abs=3e-7)  # the normal tail is a published approximation
        assert math.log(max(x.p_text, 1e-140)) == pytest.approx(math.log(max(p_text, 1e-140)), rel=0.03, abs=0.05)


def test_one_tail_at_all_lengths(spark):
    """On both sides of any length the chance of many switches is the same sum."""
    cases = [(k, m) for m in (19, 30, 511, 512, 513, 900) for k in (0, 1, m // 20, m // 8, m // 5, m // 2, m)]
    got = spark.createDataFrame([(float(k), float(m)) for k, m in cases], "k double, m double").select("k", "m", secretscan.switch_tail(F.col("k"), F.col("m")).alias("p")).collect()
    for x in got:
        k, m = int(x.k), int(x.m)
        assert x.p == pytest.approx(float(sum(math.comb(m, j) * Fraction(9) ** (m - j) for j in range(k, m + 1)) / Fraction(10) ** m), rel=1e-7, abs=1e-300)


def test_rare_secrets_among_many_words(spark):
    """One random string of 40 letters and digits per 1,000 candidates is found, and few others."""
    r = random.Random(5)
    syllables = ["an", "ber", "con", "dor", "el", "fi", "gru", "ho", "ix", "ju", "ka", "lo"]
    word = lambda: "".join(r.choices(syllables, k=18))[:34].capitalize() + str(r.randint(100_000, 999_999))
    secret = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    rows = [(i, f"see {word()} and") for i in range(1000)] + [(5000 + i, f"use {secret[i:] + secret[:i]} now") for i in (0,)]
    found = secretscan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    hit = {x.doc_id for x in found.where(F.exists("spans", lambda s: s["kind"] == "random")).collect()}
    assert 5000 in hit and len(hit) <= 3


def test_quality_scores_against_two_compressors_per_piece():
    r = random.Random(1)
    text = lambda words, n: " ".join(r.choices(words, k=n)).encode()
    good, bad = ["river", "stone", "garden", "window", "the", "and", "of"], ["$$$", "BUY", "NOW!!", "free", "***", "cash", "win"]
    sample = [(text(good, 120), 1) for _ in range(60)] + [(text(bad, 120), 0) for _ in range(60)] + [(b"", 0)]
    r.shuffle(sample)
    model = quality.train(sample, size=4096)
    score = model.scorer()
    for t in [text(good, 30), text(bad, 3000), b"x", "Ünï çødé 漢字".encode(), text(good, 700) + text(bad, 700)]:
        saved = 0
        for i in range(0, len(t), 1024):
            sizes = [len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(t[i : i + 1024])) for d in (model.good, model.bad)]
            saved += sizes[1] - sizes[0]
        margin = float(np.dot(model.weights, [saved / (len(t) + 64), 64 / (len(t) + 64), 1.0]))
        assert score(t) == pytest.approx(1 / (1 + math.exp(-margin)))
    assert score(b"") == 0.0 and score(text(good, 100)) > 0.9 > 0.1 > score(text(bad, 100))


def test_few_texts_are_a_dictionary_whole():
    long = b"a text that is kept from its beginning " + b"x" * 400
    assert quality.dictionary([long], 256) == long


def test_part_files_stand_in_the_order_they_were_written(spark):
    names = ["d/part-100000-a.parquet", "d/part-99999-a.parquet", "d/part-00002-a.parquet", "c/part-100001-a.parquet", "d/other.parquet", "d/part-99999-b.parquet"]
    df = spark.createDataFrame([(n,) for n in names], "file string").orderBy(*sharding.written_order("file"))
    assert [x.file for x in df.collect()] == ["c/part-100001-a.parquet", "d/other.parquet", "d/part-00002-a.parquet", "d/part-99999-a.parquet", "d/part-99999-b.parquet", "d/part-100000-a.parquet"]


def test_slots_follow_the_part_numbers(spark, tmp_path):
    for part, first in (("part-99999-x", 0), ("part-100000-x", 10)):
        spark.createDataFrame([(first + i, "t") for i in range(10)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/w{first}")
        (next((tmp_path / f"w{first}").glob("part-*.parquet"))).rename(tmp_path / f"{part}.parquet")
    docs = spark.read.parquet(*[str(p) for p in sorted(tmp_path.glob("part-*.parquet"))])
    slots = {x.doc_id: x.slot for x in sharding.shard_documents(docs, shards=1).collect()}
    assert slots == {i: i for i in range(20)}
