"""The stages of the pipeline and the whole of it against plain Python, and on edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pytest
from test_corpus import DOCS, EDGES, LABELS, SYLLABLES, contaminated, jump, labelled, prose, shingles

import corpus_pipeline
from tidebook.llm import mixing, toxicity

ITEMS = [(1, prose(5, 20)), (2, prose(6, 4)), (3, None)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Clean and toxic texts of four sources, edge cases, near copies and test passages."""
    d, r = str(tmp_path_factory.mktemp("sf")), random.Random(8)
    rows, labels = labelled(400, 9)
    rows = [(i, t, lang, r.choice(["a", "b", "b", "c", None]), n) for i, t, lang, _, n in rows]
    for i in range(3000, 3060):
        w = prose(i // 6, 90).split()
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(SYLLABLES) * 2
        rows.append((i, " ".join(w), "en", r.choice("ab"), 1))
    rows += EDGES + [(5000 + k, prose(40 + k, 30) + " " + passage + " " + prose(70 + k, 30), "en", "s", 1) for k, passage in enumerate((ITEMS[0][1], ITEMS[1][1].upper(), " ".join(ITEMS[0][1].split()[3:13]), " ".join(ITEMS[0][1].split()[3:12])))]
    r.shuffle(rows)
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    yield d
    shutil.rmtree(d)


def plain_toxicity(rows, model):
    def score(text):
        at = [model.place[x] for x in toxicity.hashed((text or "").encode()) if x in model.place]
        pairs = sum(float(model.vectors[a] @ model.vectors[b]) for a, b in itertools.combinations(at, 2))
        return 1 / (1 + np.exp(-(model.bias + sum(model.weights[a] for a in at) + pairs / max(1, len(at)))))

    return [x for x in rows if score(x[1]) < 0.5]


def plain_near(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    links = {i: [] for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
            links[i].append(j)
            links[j].append(i)
    seen, keep = set(), []
    for i in links:
        group, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - group
            group |= new
            todo += new
        if i not in seen:
            keep.append(min(group, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)))
        seen |= group
    return [rows[k] for k in sorted(keep)]


def plain_clean(rows):
    return [x for x in rows if not contaminated(x[1], ITEMS)[0]]


def plain_mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) for x in rows]
    names = sorted({x[3] for x in rows}, key=lambda s: (s is None, s or ""))
    mass = {s: sum(n for n, x in zip(size, rows, strict=True) if x[3] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, total = {}, float(sum(size))
    while left := [s for s in names if s not in target]:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[t] for t in left) for s in left}
        above = {s: 3.0 * mass[s] for s in left if share[s] > 3 * mass[s]}
        target.update(above or share)
    copies = []
    for k, s in enumerate(names):
        knots, heights = mixing.KNOTS, mixing.SCHEDULES[k % 3]

        def demand(t, knots=knots, heights=heights):
            xs = [x for x in knots if x < t] + [t]
            return float(np.trapezoid(np.interp(xs, knots, heights), xs))

        whole, mine = demand(1.0), []
        for n, x in zip(size, rows, strict=True):
            if x[3] == s:
                key = f"{'' if x[0] is None else x[0]}:{hashlib.md5((x[1] or '').encode()).hexdigest()}"
                mine.append((hashlib.md5(key.encode()).digest(), n, x))
        ahead = 0.0
        for copy in range(3):
            for digest, n, x in sorted(mine, key=lambda m: m[0]):
                if n and ahead + n / 2 <= target[s]:
                    low, high = 0.0, 1.0
                    for _ in range(60):
                        t = (low + high) / 2
                        low, high = (t, high) if demand(t) / whole < (ahead + n / 2) / target[s] else (low, t)
                    copies.append((high, digest, copy, x))
                ahead += n
    return [x for *_, x in sorted(copies, key=lambda c: c[:3])]


def plain_shard(rows, shards=40):
    out, slots = [], Counter()
    for i, text, *_ in rows:
        raw, at = (text or "").encode(), jump((i or 0) % 2**64, shards)
        out.append((i, len(raw) + 16, zlib.crc32(raw), "key", at, slots[at], jump((i or 0) % 2**64, shards + 1)))
        slots[at] += 1
    return out


def plain_stages(model):
    return [lambda rows: plain_toxicity(rows, model), plain_near, plain_clean, plain_mix, plain_shard]


def test_stages(spark, sf):
    """Each stage on what the one before kept, every column of every row; mixed rows in their order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(x) for x in docs.collect()]
    known = {x.doc_id: x.toxic for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    plain = plain_stages(toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    sizes = [len(rows)]
    for i, ((_, stage), same) in enumerate(zip(corpus_pipeline.STAGES, plain, strict=True)):
        out = stage(spark, docs, sf)
        assert i == 4 or out.columns == docs.columns
        got, want = [tuple(x) for x in out.collect()], same(rows)
        assert got == want if i == 3 else Counter(got) == Counter(want)
        if i == 0:
            assert sum(known.get(x[0], 0) for x in got) < 0.1 * sum(known.values())
            assert sum(known.get(x[0]) == 0 for x in got) > 0.9 * sum(v == 0 for v in known.values())
        sizes.append(len(got))
        rows = want
        docs = spark.createDataFrame(want, DOCS).coalesce(1) if i < 4 else docs
    assert sizes[0] > sizes[1] > sizes[2] and sizes[2] - sizes[3] == 3 and sizes[4] == sizes[5]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_empty_documents(spark, sf, stage):
    assert stage(spark, spark.createDataFrame([], DOCS), sf).collect() == []


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(x) for x in docs.collect()]
    for same in plain_stages(toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))):
        rows = same(rows)
    assert rows and Counter(tuple(x) for x in corpus_pipeline.run(spark, sf).collect()) == Counter(rows)
