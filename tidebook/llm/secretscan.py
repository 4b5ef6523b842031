"""Secret scan: patterns for known secrets, and a randomness test battery for unknown ones.

Candidates are long runs of encoding characters. Their encoding is inferred from the characters used;
over its alphabet they are tested for uniformity (chi-squared), for runs above and below the middle,
and for serial correlation. A random string passes all three. Text fails: its chi-squared statistic
grows with its length. The p-value of the statistic under that alternative, which a longer string makes
smaller, in small alphabets with or replaced by that of the switches between letters and digits, goes into a false-discovery control per class of length, over the candidates of all documents.

Everything is built from column functions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tails import beta_inc
from ._common import stored

# Fixed patterns of the base kinds: kind, expression, group that carries the secret, its least length.
# A run that is too short holds no match that is long enough, so the last two ask for the length at once;
# an assignment that is too short still takes its characters from the next one, and is dropped later.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Finds each base kind's texts quickly; a text without it has no match that is long enough.
GATES = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
#: A = inside a run parts a name from its value; at the end it is padding.
CANDIDATE = r"[A-Za-z0-9+/_-]{14,}+(?:=+(?![A-Za-z0-9+/_=-]))?"
#: Every candidate of 20 characters is in such a run.
CANDIDATE_GATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A run with both kinds of signs is in no encoding; its longest parts that are.
MIXED, PARTS = r"[+/].*[_-]|[_-].*[+/]", (r"[A-Za-z0-9+/]{20,}=*", r"[A-Za-z0-9_-]{20,}=*")

# Encodings, the narrowest first: name, expression, alphabet.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36_upper", r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base36", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Chance that two letters of a natural text agree.
COINCIDENCE = 0.065
#: Chance that neighbours in a text are a letter and a digit, in either order; an assumption, as names and
#: words keep their digits together.
SWITCH = 0.1
#: Least p-value at which a test of randomness counts as passed.
PASSED = 0.001
LENGTH_CLASSES = (20, 24, 28, 32, 40, 48, 64, 96, 128)
#: p-values are counted on a grid of -log10(p), in steps of 1/20 up to 20.
GRID, GRID_TOP = 20, 400
#: Matches of a text that are located together.
CHUNK = 512
_SPAN = "array<struct<kind:string,rank:int,start:int,end:int>>"


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution: fixed coefficients of a published rational
    approximation (error below 1e-7), for large z the leading term of the tail."""
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * F.lit(0.3989422804014327) * F.when(x > 6, F.lit(1.0) / x).otherwise(poly)
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose group has `least` characters, as structs (start, end,
    inside): code points, end exclusive, and the group's text. The gaps between matches give the
    positions. The result grows by chunks of matches, as every growth copies it."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    inside = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)) if group else whole
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(whole.alias("w"), inside.alias("i"), F.slice(gaps, F.lit(1), F.size(whole)).alias("g"))
    none = F.array().cast("array<struct<start:int,end:int,inside:string>>").alias("out")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["w"])
        one = F.struct(start.alias("start"), end.alias("end"), x["i"].alias("inside"))
        return F.struct(end.alias("at"), F.when(F.length(x["i"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def located(every: Column) -> Column:
        def chunk(acc: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(every, i * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), none), step)
            return let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], p["out"]).alias("out")))

        chunks = F.sequence(F.lit(0), F.floor(F.size(every) / CHUNK).cast("int"))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none), chunk)["out"]

    return let(zipped, located)


def base_spans(text: Column) -> Column:
    """All matches of the base kinds that are long enough."""

    def of(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        spans = F.transform(matches(text, pattern, group, least), lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end")))
        return F.when(text.rlike(GATES[kind]), spans).otherwise(F.array().cast(_SPAN))

    return F.concat(*[of(rank, *base) for rank, base in enumerate(BASE)])


def candidates(text: Column) -> Column:
    """Runs of encoding characters, or their parts if the whole is in no encoding, as structs (start, end,
    inside, family): parts of one family do not overlap. Numbers, and words of one case without digits, are in
    no encoding that could be told from text, and are left out."""
    odd = lambda m: m["inside"].rlike("[0-9]") & m["inside"].rlike("[A-Za-z]") | m["inside"].rlike("[a-z]") & m["inside"].rlike("[A-Z]")
    moved = lambda m, x, f: F.struct((m["start"] + x["start"]).alias("start"), (m["start"] + x["end"]).alias("end"), x["inside"].alias("inside"), F.lit(f).alias("family"))
    family = lambda m, f: F.transform(matches(m["inside"], PARTS[f], 0, 20), lambda x: moved(m, x, f))
    parts = lambda m: F.concat(*[family(m, f) for f in range(len(PARTS))])
    whole = lambda m: F.array(F.struct(m["start"].alias("start"), m["end"].alias("end"), m["inside"].alias("inside"), F.lit(0).alias("family")))
    runs = F.transform(matches(text, CANDIDATE, 0, 20), lambda m: F.when(m["inside"].rlike(MIXED), parts(m)).otherwise(whole(m)))
    return F.when(text.rlike(CANDIDATE_GATE), F.filter(F.flatten(runs), odd)).otherwise(F.array().cast("array<struct<start:int,end:int,inside:string,family:int>>"))


def switch_tail(k: Column, m: Column) -> Column:
    """P(K >= k) of a binomial K of m pairs with chance SWITCH, by the incomplete beta function: one form at all lengths."""
    return F.when(k <= 0, F.lit(1.0)).otherwise(beta_inc(k, m - k + 1, SWITCH))


def battery(found: DataFrame) -> DataFrame:
    """Rows with `inside`, a candidate, to rows with encoding, length, p_random and p_text.

    p_random is three times the least p-value of the three tests of randomness. p_text is the chance, if the
    string were text, of so small a chi-squared statistic in encodings of over 36 symbols, of so many switches
    between letters and digits in those of 16, and of both, joined by Fisher's rule, in those between. Both tails use normal approximations: the
    cube root of chi-squared over its degrees, and the published mean and deviation of the number of
    runs and of the serial correlation. Candidates in no known encoding are left out.
    """
    inside, encoding, alphabet = F.col("inside"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, letters in reversed(ENCODINGS):
        fits = inside.rlike(pattern)
        encoding, alphabet = F.when(fits, F.lit(name)).otherwise(encoding), F.when(fits, F.lit(letters)).otherwise(alphabet)
    rows = found.withColumn("encoding", encoding).withColumn("alphabet", alphabet).where("encoding is not null")
    padded = F.col("encoding").isin("base32", "base64", "base64url")
    rows = rows.withColumn("body", F.when(padded, F.rtrim("inside", F.lit("="))).otherwise(F.col("inside")))
    rows = rows.withColumn("length", F.length("body")).withColumn("n", F.col("length").cast("double")).withColumn("size", F.length("alphabet").cast("double"))
    counts = F.transform(F.split("alphabet", ""), lambda c: F.when(c == "", 0).otherwise(F.length("body") - F.length(F.replace("body", c, F.lit("")))))
    rows = rows.withColumn("squares", F.aggregate(counts, F.lit(0.0), lambda a, k: a + k.cast("double") * k))
    place = F.transform(F.filter(F.split("body", ""), lambda c: c != ""), lambda c: F.instr("alphabet", c).cast("double") - (F.col("size") + 1) / 2)
    rows = rows.withColumn("x", place)
    rows = rows.withColumn("pairs", F.arrays_zip(F.slice("x", F.lit(1), F.size("x") - 1).alias("a"), F.slice("x", F.lit(2), F.size("x") - 1).alias("b")))
    n, df = F.col("n"), F.col("size") - 1
    rows = rows.withColumns(
        {
            "chi": F.col("squares") * F.col("size") / n - n,
            "more": n * (COINCIDENCE * F.col("size") - 1),
            "up": F.aggregate("x", F.lit(0.0), lambda a, v: a + (v > 0).cast("double")),
            "runs": F.aggregate("pairs", F.lit(1.0), lambda a, p: a + ((p["a"] > 0) != (p["b"] > 0)).cast("double")),
            "cross": F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p["a"] * p["b"]),
            "switches": F.aggregate(F.sequence(F.lit(1), F.length("body") - 1), F.lit(0.0), lambda a, i: a + (F.substring("body", i, F.lit(1)).rlike("[0-9]") != F.substring("body", i + 1, F.lit(1)).rlike("[0-9]")).cast("double")),
            "power": F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v),
        }
    )
    rows = rows.withColumn("mean", 2 * F.col("up") * (n - F.col("up")) / n + 1)
    rows = rows.withColumn("spread", F.sqrt(F.greatest(F.lit(0.0), (F.col("mean") - 1) * (F.col("mean") - 2) / (n - 1))))
    rows = rows.withColumns(
        {
            "z_chi": (F.pow(F.greatest("chi", F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
            "z_text": (df + F.col("more") - F.col("chi")) / F.sqrt(2 * (df + 2 * F.col("more"))),
            "z_runs": F.when(F.col("spread") > 0, F.abs(F.col("runs") - F.col("mean")) / F.col("spread")).otherwise(F.lit(40.0)),
            "z_serial": F.when(F.col("power") > 0, F.abs(F.col("cross") / F.col("power")) * F.sqrt(n)).otherwise(F.lit(40.0)),
        }
    )
    least = F.least(normal_tail(F.col("z_chi")), 2 * normal_tail(F.col("z_runs")), 2 * normal_tail(F.col("z_serial")))
    chi, switches = F.greatest(normal_tail(F.col("z_text")), F.lit(1e-150)), F.greatest(switch_tail(F.col("switches"), n - 1), F.lit(1e-150))
    both = chi * switches
    p_text = F.when(F.col("size") == 16, switches).when(F.col("size") <= 36, both * (1 - F.log(both))).otherwise(normal_tail(F.col("z_text")))
    return rows.withColumn("p_random", F.least(F.lit(1.0), 3 * least)).withColumn("p_text", F.least(F.lit(1.0), p_text)).select(
        *found.columns, "encoding", "length", "p_random", "p_text"
    )


def length_class(length: Column) -> Column:
    out = F.lit(0)
    for i, at in enumerate(LENGTH_CLASSES):
        out = F.when(length >= at, F.lit(i)).otherwise(out)
    return out


def discoveries(tested: DataFrame, rate: float) -> DataFrame:
    """The tested candidates that pass the tests of randomness and whose p_text passes the step-up rule
    in their class of length: the expected share of false discoveries is at most `rate`.

    p-values are counted on a grid, rounded up, so that there are a few thousand counts at most, however
    many documents there are; the limits per class join back to the candidates.
    """
    step = F.least(F.lit(GRID_TOP), F.greatest(F.lit(0), F.floor(-F.log10(F.greatest("p_text", F.lit(1e-300))) * GRID))).cast("int")
    placed = tested.withColumn("class", length_class(F.col("length"))).withColumn("step", step)
    counts = placed.groupBy("class", "step").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("class")
    ranked = counts.withColumn("rank", F.sum("n").over(by.orderBy(F.desc("step")))).withColumn("total", F.sum("n").over(by))
    limits = ranked.where(F.pow(F.lit(10.0), -F.col("step") / GRID) * F.col("total") / F.col("rank") <= rate)
    limits = limits.groupBy("class").agg(F.min("step").alias("limit"))
    return placed.where(F.col("p_random") >= PASSED).join(F.broadcast(limits), "class").where("step >= limit").select(*tested.columns)


def longest(found: DataFrame) -> DataFrame:
    """Spans (row, start, end, family) without those that overlap a larger one, or one as large and further left,
    of the other family of parts. Only the parts of the other family that hold a span's first or last
    character can be larger, so running values find them."""
    at = F.struct("start", "end")
    other = lambda f: F.last(F.when(F.col("family") == 1 - f, at), ignorenulls=True)
    ahead = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("row").orderBy(F.desc("end"), F.desc("start")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for side, w in (("left", ahead), ("right", back)):
        found = found.withColumn(side, F.when(F.col("family") == 0, other(0).over(w)).otherwise(other(1).over(w)))
    size = F.col("end") - F.col("start")

    def beats(o: str) -> Column:
        s, e = F.col(f"{o}.start"), F.col(f"{o}.end")
        larger = (e - s > size) | ((e - s == size) & (s < F.col("start")))
        return F.coalesce((s < F.col("end")) & (F.col("start") < e) & larger, F.lit(False))

    return found.where(~beats("left") & ~beats("right")).drop("left", "right")


def free_of(found: DataFrame, base: DataFrame) -> DataFrame:
    """Spans (row, start, end) that overlap none of base (row, start, end), by running values over both in order."""
    both = found.withColumn("own", F.lit(True)).unionByName(base.withColumn("own", F.lit(False)), allowMissingColumns=True)
    by = Window.partitionBy("row").orderBy("start", "own")
    before = F.max(F.when(~F.col("own"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.min(F.when(~F.col("own"), F.col("start"))).over(back)
    both = both.withColumn("before", before).withColumn("after", after)
    clear = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return both.where(F.col("own") & clear).drop("own", "before", "after")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """One row per row of docs: (doc_id, spans): all spans as structs (kind, rank, start, end) in order.

    Whole texts are searched; null counts as empty and has no spans. Base kinds: assign, access, hex.
    Kind random: candidates that pass the tests of randomness and the false-discovery control, unless
    they overlap a base span; of overlapping parts of one run the longest stays. Repeated rows are judged
    alike, but each counts as a candidate. The work grows with a text's matches, and the spans of a text are
    sorted in one task. No rows give no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), base_spans(text).alias("base"), candidates(text).alias("candidates"))
    found = stored(found, "secrets", narrow=False)
    each = found.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    tested = stored(battery(each), "tested")
    good = stored(discoveries(tested, rate).select("row", "start", "end", "family"), "discovered")
    base = found.join(good.select("row").distinct(), "row", "left_semi").select("row", F.explode("base").alias("b")).select("row", "b.start", "b.end")
    span = F.struct(F.lit("random").alias("kind"), F.lit(len(BASE)).alias("rank"), "start", "end")
    more = longest(free_of(good, base)).groupBy(F.col("row").alias("m_row")).agg(F.collect_list(span).alias("more"))
    out = found.join(more, F.col("row") == F.col("m_row"), "left")
    spans = F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))
    placed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return out.select("doc_id", F.transform(placed, lambda x: F.struct(x["kind"].alias("kind"), x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def digest_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
