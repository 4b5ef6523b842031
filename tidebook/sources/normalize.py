"""Incremental normalization: hours of raw logs to date and hour partitions of typed tables.

Hours with a new or grown raw file are parsed again and replace what the tables had of them; an hour that has become
empty goes. Nothing that a reader may be reading is ever changed: an hour is written to a folder of a new
version, `table/date=D/hour=H/v=VERSION`, and becomes part of the tables when a commit file names it. Commits are
numbered; each holds the whole state (the raw files done, and every hour's version per table) and appears by one
rename, so readers see the tables as they were before it or after it. What a job that died has left is in no commit;
`vacuum` removes it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..store import stored
from . import raw as raw_tables
from .schemas import TABLES

COMMITS = "_commits"
#: Bytes of a row group: rows are sorted by coin and time, so the statistics of small ones tell most apart.
ROW_GROUP = 8 << 20
#: `YYYYMMDD/HH.jsonl`, or what a streaming query writes below `date=YYYYMMDD/hour=HH`.
RAW_FILE = re.compile(r"\d{8}/\d{2}\.jsonl$|date=\d{8}/hour=\d{2}/part-[^/]*$")


@dataclass
class Files:
    """The few file-system calls needed, over any path Spark can reach."""

    spark: SparkSession

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def listing(self, path: str) -> dict[str, tuple[int, int]]:
        """Relative paths of the raw files below path, *.jsonl or the text files of a recorded stream, with size and
        modification time; hidden files and folders are left out."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return {}
        root, found, it = fs.makeQualified(p).toString().rstrip("/"), {}, fs.listFiles(p, True)
        while it.hasNext():
            f = it.next()
            name = f.getPath().toString()
            path_in = name[len(root) + 1 :]
            if RAW_FILE.search(name) and not any(x.startswith(("_", ".")) for x in path_in.split("/")):
                found[path_in] = (f.getLen(), f.getModificationTime())
        return found

    def text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        """What is directly in the folder; nothing where there is none."""
        fs, p = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def put(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """The file with all of its text at once, unless there is one of that name: false."""
        draft = f"{path.rsplit('/', 1)[0]}/_draft-{uuid.uuid4().hex}"
        self.put(draft, text)
        fs, p = self._fs(path)
        done = not fs.exists(p) and fs.rename(self._fs(draft)[1], p)
        if not done:
            self.drop(draft)
        return bool(done)

    def drop(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)


@dataclass
class Outcome:
    files: list[str] = field(default_factory=list)
    rows: dict[str, int] = field(default_factory=dict)


@dataclass
class State:
    """A commit: its number, the raw files done as (size, time), and per table the version of each hour `D/H` that has rows."""

    number: int = 0
    files: dict[str, tuple[int, int]] = field(default_factory=dict)
    hours: dict[str, dict[str, str]] = field(default_factory=lambda: {t: {} for t in TABLES})


def commits(fs: Files, out_dir: str) -> list[int]:
    return sorted(int(x[:-5]) for x in fs.names(f"{out_dir}/{COMMITS}") if re.fullmatch(r"\d+\.json", x))


def state_of(fs: Files, out_dir: str, number: int | None = None) -> State:
    """The state of a commit, by default the latest; an empty one before the first."""
    known = commits(fs, out_dir)
    if number is None:
        number = known[-1] if known else 0
    text = fs.text(f"{out_dir}/{COMMITS}/{number:012d}.json") if number else None
    if text is None:
        if number:
            raise ValueError(f"there is no commit {number}")
        return State()
    held = json.loads(text)
    return State(number, {k: tuple(v) for k, v in held["files"].items()}, held["hours"])


def hour_of(path: str) -> tuple[str, str]:
    """(YYYYMMDD, HH) of a raw file `.../YYYYMMDD/HH.jsonl`, or of Hive-style directories."""
    parts = path.split("/")
    if any(x.startswith("date=") for x in parts):
        named = dict(x.split("=", 1) for x in parts if "=" in x)
        return named["date"], named["hour"]
    return parts[-2], parts[-1].removesuffix(".jsonl")


def steps(spark: SparkSession, raw_dir: str, out_dir: str, out: Outcome) -> Iterator[str]:
    """normalize, step by step; the name of each is given when it is done. Only the last one, the commit, changes what readers
    see, so the job may die between any two, or in one, and be run again."""
    fs = Files(spark)
    have, state = fs.listing(raw_dir), state_of(fs, out_dir)
    changed = {k for k, v in have.items() if state.files.get(k) != v}
    out.files, out.rows = sorted(changed), dict.fromkeys(raw_tables.PARSERS, 0)
    if not changed:
        return
    hours = {"/".join(hour_of(k)) for k in changed}
    redo = [k for k in have if "/".join(hour_of(k)) in hours]  # an hour may have several files
    after = State(state.number + 1, have, {t: {h: v for h, v in state.hours[t].items() if h not in hours} for t in TABLES})
    lines = raw_tables.read_raw(spark, [f"{raw_dir}/{k}" for k in redo])
    place = F.regexp_replace(F.regexp_replace("file", r"^.*/(?:date=)?(\d{8})/", "$1/"), r"/(?:hour=)?(\d{2})[./].*$", "/$1")
    lines = lines.withColumn("date", F.split_part(place, F.lit("/"), F.lit(1))).withColumn("hour", F.split_part(place, F.lit("/"), F.lit(2))).drop("file")
    lines = stored(lines, "raw", narrow=False)  # text and envelopes are read once for all tables
    yield "raw"
    version = uuid.uuid4().hex
    for name, parse in raw_tables.PARSERS.items():
        # ranges, not hours, are dealt to the tasks: an hour of all coins is as many tasks as it needs
        order = ["date", "hour", "coin", "recv_ts_ns"]
        table, written = parse(lines, "date", "hour").repartitionByRange(*order).sortWithinPartitions(*order), Observation(name)
        table = table.observe(written, F.count(F.lit(1)).alias("n"), F.collect_set(F.concat_ws("/", "date", "hour")).alias("hours"))
        table.withColumn("v", F.lit(version)).write.mode("append").option("parquet.block.size", str(ROW_GROUP)).partitionBy("date", "hour", "v").parquet(f"{out_dir}/{name}")
        out.rows[name] = written.get["n"]
        after.hours[name] |= dict.fromkeys(sorted(written.get["hours"]), version)
        yield name
    text = json.dumps({"files": {k: list(v) for k, v in sorted(after.files.items())}, "hours": after.hours})
    if not fs.publish(f"{out_dir}/{COMMITS}/{after.number:012d}.json", text):
        raise RuntimeError(f"another job has made commit {after.number} of {out_dir}; run this one again")
    yield "commit"


def normalize(spark: SparkSession, raw_dir: str, out_dir: str) -> Outcome:
    """Does the hours that changed; returns the raw files that are new or have grown, and the rows written per table."""
    out = Outcome()
    for _ in steps(spark, raw_dir, out_dir, out):
        pass
    return out


def read_table(spark: SparkSession, out_dir: str, name: str, coins: list[str] | None = None, commit: int | None = None) -> DataFrame:
    """A normalized table as of a commit, the latest by default, with date and hour as strings; the coins are pushed down
    to the scan. The frame stays what it is while later commits are made, until `vacuum` removes its commit."""
    fs = Files(spark)
    schema = f"{TABLES[name]}, date string, hour string"
    hours = state_of(fs, out_dir, commit).hours[name]
    if not hours:
        df = spark.createDataFrame([], schema)
    else:
        root = f"{out_dir}/{name}"
        paths = [f"{root}/date={d}/hour={h}/v={v}" for (d, h), v in ((k.split("/"), v) for k, v in sorted(hours.items()))]
        df = spark.read.schema(f"{schema}, v string").option("basePath", root).parquet(*paths).drop("v")
    return df if coins is None else df.where(F.col("coin").isin(coins))


def vacuum(spark: SparkSession, out_dir: str, keep: int = 2) -> int:
    """Removes the hours that none of the last `keep` commits names, what dead jobs left among them, and the earlier commits;
    returns how many folders went. Not while a job is normalizing: its hours are in no commit yet."""
    if keep < 1:
        raise ValueError("the latest commit has to stay")
    fs = Files(spark)
    known, gone = commits(fs, out_dir), 0
    states = [state_of(fs, out_dir, n) for n in known[-keep:]]
    for name in TABLES:
        named = {(h, v) for s in states for h, v in s.hours[name].items()}
        for date in (x for x in fs.names(f"{out_dir}/{name}") if x.startswith("date=")):
            for hour in fs.names(f"{out_dir}/{name}/{date}"):
                for v in fs.names(f"{out_dir}/{name}/{date}/{hour}"):
                    if (f"{date[5:]}/{hour[5:]}", v[2:]) not in named:
                        fs.drop(f"{out_dir}/{name}/{date}/{hour}/{v}")
                        gone += 1
    for n in known[:-keep]:
        fs.drop(f"{out_dir}/{COMMITS}/{n:012d}.json")
    return gone
