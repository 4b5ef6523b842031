"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import few_files
from . import quality, toxicity
from ._common import held_out, read, stored
from .codes import vector_codes
from .decontam import decontaminate
from .exactdedup import exact_dedup
from .licenses import LEAST, TEMPLATES, scan_licenses
from .mixing import mixed_order, plan_mix
from .neardup import near_duplicates
from .rules import judge_quality
from .secretscan import digest_text, scan_secrets
from .sharding import shard_documents
from .urlfilter import filter_urls
from .variants import spelling_variants

#: The filter list of op3: verdict and `host/path`.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: 64 in a directory of their source, 64 directories in one above;
    every 64th is the licence file of its directory, every 4096th that of the one above."""
    i = F.col("doc_id")
    upper = F.concat(F.col("source"), F.lit("/p"), F.floor(i / 4096).cast("string"), F.lit("/"))
    lower = F.concat(upper, F.lit("q"), (F.floor(i / 64) % 64).cast("string"), F.lit("/"))
    path = F.when(i % 4096 == 0, F.concat(upper, F.lit("LICENSE"))).when(i % 64 == 0, F.concat(lower, F.lit("LICENSE")))
    docs = read(spark, sf_dir, "documents").select("doc_id", path.otherwise(F.concat(lower, i.cast("string"), F.lit(".txt"))).alias("path"), "text")
    return few_files(scan_licenses(docs))


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(shard_documents(read(spark, sf_dir, "documents"), shards=40))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(digest_text(base), 256).alias("base_sha256"),
        digest_text(F.col("spans")).alias("spans"),
        of("random").alias("n_random"),
    )


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's share in the mix, and when and where its first copy stands in training."""
    plan = stored(plan_mix(read(spark, sf_dir, "documents")), "mix")
    first = mixed_order(plan).where("copy = 0").select("file", "row", F.col("rank").alias("first_rank"))
    position = F.round(F.get("positions", F.lit(0)), 9).alias("first_position")
    return few_files(plan.join(first, ["file", "row"], "left")).select("doc_id", "size", "source_size", "target", "taken", "copies", position, "first_rank")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(near_duplicates(read(spark, sf_dir, "documents"))).select("doc_id", "class_id", "rep_id", "n_links", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(exact_dedup(read(spark, sf_dir, "documents")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def op9_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(spelling_variants(read(spark, sf_dir, "documents")))


def op12_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(read(spark, sf_dir, "documents"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes"]
    return few_files(judged).select(*columns)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(vector_codes(read(spark, sf_dir, "embeddings"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_jump_sharding": op2_jump_sharding,
    "op3_url_filter": op3_url_filter,
    "op4_secret_scan": op4_secret_scan,
    "op5_curriculum_mix": op5_curriculum_mix,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_toxicity_fm": op9_toxicity_fm,
    "op10_compression_quality": op10_compression_quality,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_weak_quality": op12_weak_quality,
    "op13_vector_codes": op13_vector_codes,
}

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(*t) for t in TEMPLATES)


def _checksum_step(x: int) -> int:
    """What crc32 makes of the lowest four bits."""
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


def crc32_sql(blob: str) -> str:
    """The unsigned crc32 of a blob in SQL: over the hexadecimal digits, the lower one of a byte first."""
    digits = f"list_transform(range(2 * octet_length({blob})), lambda i: strpos('0123456789ABCDEF', hex({blob})[xor(i, 1) + 1]) - 1)"
    steps = [_checksum_step(i) for i in range(16)]
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, x: xor(c >> 4, {steps}[(xor(c, x) & 15) + 1])), 4294967295)"


def vector_codes_sql(rounds: int = 4) -> str:
    """The codes in SQL: every part against every entry of its codebook, round by round."""
    steps = """
        WITH e AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        p AS MATERIALIZED (SELECT r, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x FROM e, range(4) t(part)),
        b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 256)"""
    for i in range(rounds + 1):
        steps += f""",
        a{i} AS MATERIALIZED (
          SELECT r, p.part, min((CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), entry)) AS near
          FROM p JOIN b{i} b ON b.part = p.part GROUP BY ALL)"""
        if i < rounds:
            steps += f""",
        m{i} AS (
          SELECT part, entry, list(mean ORDER BY i) AS x
          FROM (SELECT part, near[2] AS entry, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS mean
                FROM a{i} JOIN p USING (r, part), unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL)
          GROUP BY part, entry),
        b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (part, entry))"""
    return f"""{steps},
        c AS (
          SELECT r, string_agg(lpad(lower(to_hex(near[2])), 2, '0'), '' ORDER BY part) AS code, CAST(sum(near[1]) AS BIGINT) AS error
          FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
        FROM e JOIN c USING (r)"""


ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": rf"""
        WITH tpl AS (SELECT license, t AS term, count(*) AS c
                     FROM (VALUES {_TEMPLATE_ROWS}) v(license, body), unnest(string_split_regex(lower(body), '[^a-z0-9]+')) u(t)
                     WHERE t <> '' GROUP BY ALL),
        d AS (
          SELECT doc_id, coalesce(text, '') AS text,
                 source || '/p' || (doc_id // 4096) || '/' AS upper,
                 source || '/p' || (doc_id // 4096) || '/q' || (doc_id // 64 % 64) || '/' AS lower
          FROM documents),
        f AS (
          SELECT doc_id, text, CASE WHEN doc_id % 64 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name,
                 CASE WHEN doc_id % 4096 = 0 THEN upper ELSE lower END AS place FROM d),
        term_df AS (SELECT term, count(DISTINCT doc_id) AS df
                    FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM f)
                    WHERE term IN (SELECT term FROM tpl) GROUP BY term),
        idf AS (SELECT DISTINCT term, ln((1 + (SELECT count(*) FROM f)) / (1 + coalesce(df, 0))) + 1 AS idf
                FROM tpl LEFT JOIN term_df USING (term)),
        units AS (SELECT doc_id, unnest(CASE WHEN name = 'LICENSE' THEN list_append(string_split(text, chr(10)), text)
                                             ELSE string_split(text, chr(10)) END) AS line FROM f),
        numbered AS (SELECT row_number() OVER () AS u, doc_id, line FROM units),
        tf AS (SELECT u, doc_id, term, count(*) AS tf
               FROM (SELECT u, doc_id, unnest(string_split_regex(lower(line), '[^a-z0-9]+')) AS term FROM numbered)
               WHERE term <> '' GROUP BY ALL),
        w AS (SELECT u, doc_id, term, tf * coalesce(idf, ln(1 + (SELECT count(*) FROM f)) + 1) AS w FROM tf LEFT JOIN idf USING (term)),
        tw AS (SELECT license, term, c * idf AS w FROM tpl JOIN idf USING (term)),
        tn AS (SELECT license, sqrt(sum(w * w)) AS norm FROM tw GROUP BY license),
        un AS (SELECT u, sqrt(sum(w * w)) AS norm FROM w GROUP BY u),
        cs AS (SELECT w.doc_id, tw.license, round(sum(w.w * tw.w / tn.norm) / any_value(un.norm), 6) AS cosine
               FROM w JOIN tw USING (term) JOIN tn USING (license) JOIN un ON un.u = w.u GROUP BY w.u, w.doc_id, tw.license),
        own AS (SELECT DISTINCT ON (doc_id) doc_id, license, cosine FROM cs WHERE cosine >= {LEAST} ORDER BY doc_id, cosine DESC, license),
        j AS (SELECT f.doc_id, place || name AS path, rtrim(place, '/') AS dir, name, license, cosine FROM f LEFT JOIN own USING (doc_id)),
        holds AS (SELECT DISTINCT ON (dir) dir, license AS held, cosine AS held_cosine FROM j
                  WHERE name = 'LICENSE' AND license IS NOT NULL ORDER BY dir, cosine DESC, path),
        near AS (SELECT DISTINCT ON (j.doc_id) j.doc_id, h.dir AS above, held, held_cosine
                 FROM j JOIN holds h ON h.dir = j.dir OR starts_with(j.dir, h.dir || '/') ORDER BY j.doc_id, length(h.dir) DESC)
        SELECT doc_id, path, coalesce(license, held) AS license, coalesce(cosine, held_cosine) AS cosine,
               CASE WHEN license IS NOT NULL THEN 'own' WHEN held IS NOT NULL THEN 'inherited' ELSE 'none' END AS via,
               CASE WHEN license IS NULL THEN above END AS from_dir
        FROM j LEFT JOIN near USING (doc_id)""",
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE dw AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
              FROM dw, unnest(range(1, greatest(2, len(w) - 3))) t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n, string_agg(g, '|' ORDER BY g) AS set FROM g GROUP BY doc_id),
        rep AS (SELECT doc_id, set, min(doc_id) OVER (PARTITION BY set) AS rep_id FROM n),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 9 * common >= 4 * (na.n + nb.n)),
        reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
        cls AS (SELECT a, min(least(a, b)) AS class_id FROM reach GROUP BY a),
        deg AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
        SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(rep_id, d.doc_id) AS rep_id,
               coalesce(n_links, 0) AS n_links, coalesce(class_id, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN cls ON cls.a = d.doc_id LEFT JOIN deg ON deg.a = d.doc_id""",
    "op7_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, coalesce(text, '') AS text,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS slim
          FROM documents),
        r AS (
          SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id,
                 count(*) OVER (PARTITION BY slim) AS group_size
          FROM t WINDOW w AS (PARTITION BY slim ORDER BY length(text) DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(slim) AS text_sha256 FROM r""",
    "op5_curriculum_mix": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                 md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS mix
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        k AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM s),
        w AS (SELECT *, CAST([5, 2, 1][kind + 1] AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS most,
                     CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM k),
        f AS (
          SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM w),
        l AS (SELECT arg_min(level, most / weight) FILTER (level * weight < most) AS level FROM f),
        g AS (SELECT f.source, source_size, kind,
                     CASE WHEN l.level IS NULL THEN most ELSE least(most, l.level * weight) END AS target FROM f, l),
        p AS (
          SELECT d.doc_id, d.mix, d.size, g.source_size, g.target, g.kind,
                 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mix, doc_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS mid
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
        c AS (
          SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(mid <= target AS INT) + CAST(source_size + mid <= target AS INT)
                    + CAST(2 * source_size + mid <= target AS INT) END AS copies
          FROM p),
        v AS (  -- the three schedules: weight at the knots 0, 1/4, 3/4, 1 and the integral up to them
          SELECT * FROM (VALUES (0, 0.0, 0.25, 1.5, 1.25, 0.0, 0.34375), (0, 0.25, 0.75, 1.25, 0.75, 0.34375, 0.84375),
                                (0, 0.75, 1.0, 0.75, 0.5, 0.84375, 1.0), (1, 0.0, 1.0, 1.0, 1.0, 0.0, 1.0),
                                (2, 0.0, 0.25, 0.5, 0.75, 0.0, 0.15625), (2, 0.25, 0.75, 0.75, 1.25, 0.15625, 0.65625),
                                (2, 0.75, 1.0, 1.25, 1.5, 0.65625, 1.0)) t(kind, k0, k1, a, b, u0, u1)),
        o AS (  -- every copy at its time, in training order
          SELECT doc_id, copy, row_number() OVER (ORDER BY position, mix, copy) - 1 AS rank, position
          FROM (SELECT c.doc_id, c.mix, copy,
                  (SELECT k0 + 2 * (s - u0) / (a + sqrt(a * a + 2 * (b - a) / (k1 - k0) * (s - u0)))
                   FROM v WHERE v.kind = c.kind AND s > u0 AND s <= u1) AS position
                FROM (SELECT *, (copy * source_size + mid) / target AS s FROM c, unnest(range(copies)) u(copy)) c))
        SELECT c.doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
               CAST(copies AS INT) AS copies, round(o.position, 9) AS first_position, o.rank AS first_rank
        FROM c LEFT JOIN o ON o.doc_id = c.doc_id AND o.copy = 0""",
    "op8_benchmark_decontamination": r"""
        WITH dw AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        bw AS (
          SELECT item_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark),
        win AS (
          SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n
          FROM bw, unnest(range(1, greatest(2, len(w) - 8))) t(i) WHERE len(w) > 0),
        spots AS (
          SELECT r, i, ln AS n, array_to_string(w[i:i + ln - 1], ' ') AS g
          FROM dw, (SELECT DISTINCT n AS ln FROM win) l, unnest(range(1, len(w) - ln + 2)) t(i)),
        occ AS (SELECT s.r, s.i, s.n, win.item FROM spots s JOIN win USING (g, n)),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + n)) u(p) GROUP BY r),
        it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY r),
        -- proximity: all terms of a window among 20 words in a row, in any order
        wt AS (SELECT DISTINCT g, unnest(string_split(g, ' ')) AS t FROM win),
        wn AS (SELECT g, count(*) AS n FROM wt GROUP BY g),
        dt AS (SELECT r, i AS pos, w[i] AS t FROM dw, unnest(range(1, len(w) + 1)) u(i) WHERE w[i] IN (SELECT t FROM wt)),
        held AS (SELECT r, g FROM (SELECT DISTINCT r, t FROM dt) JOIN wt USING (t) JOIN wn USING (g) GROUP BY r, g, wn.n HAVING count(*) = wn.n),
        spread AS (SELECT r, g, count(DISTINCT t) OVER (PARTITION BY r, g ORDER BY pos RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k
                   FROM held JOIN wt USING (g) JOIN dt USING (r, t)),
        nr AS (SELECT r, count(DISTINCT item) AS n_near FROM (SELECT DISTINCT r, g FROM spread JOIN wn USING (g) WHERE k = n) JOIN win USING (g) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
        FROM dw LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN nr USING (r)""",
    "op11_spelling_variants": rf"""
        WITH RECURSIVE run AS (
          SELECT doc_id, w, encode(concat(doc_id, ':', w)) AS b, count(*) AS c
          FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents)
          GROUP BY ALL),
        h AS (SELECT w, c, {crc32_sql("b")} AS h FROM run),
        v AS MATERIALIZED (
          SELECT * FROM (SELECT CASE WHEN h % 97 = 0 THEN concat(w[1:h % length(w)], w[h % length(w) + 2:]) ELSE w END AS word, CAST(sum(c) AS BIGINT) AS n
                         FROM h GROUP BY ALL) WHERE length(word) >= 5 AND n >= 3),
        del AS MATERIALIZED (SELECT word, n, i, concat(word[1:i], word[i + 2:]) AS rest FROM v, unnest(range(length(word))) t(i)),
        near AS (
          SELECT a.word, b.word AS other, b.n FROM del a JOIN del b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT v.word, d.word, d.n FROM v JOIN del d ON d.rest = v.word
          UNION SELECT d.word, v.word, v.n FROM v JOIN del d ON d.rest = v.word),
        best AS (SELECT word, count(*) AS n_near, min((-n, other)) AS b FROM near GROUP BY word),
        f AS MATERIALIZED (
          SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n
          FROM v LEFT JOIN best USING (word)),
        up(word, root) AS (SELECT word, word FROM f UNION SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n
        FROM f JOIN up USING (word) JOIN f last ON last.word = up.root WHERE last.form IS NULL""",
    "op13_vector_codes": vector_codes_sql(),
}
