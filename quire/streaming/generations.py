"""Versioned rebuilds: generations of tables behind a pointer, driven by a stream of ticks.

A generation is a directory of Parquet tables; readers follow a pointer file that is replaced in one
step, so a reader sees one generation as a whole. A failed build keeps the old one. Where notes are parsed
by ``parse``, a tick reads changed files only, and a note that can't be read is carried over and marked stale.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.pointer import Pointer

TICK = "2 seconds"
FORCED = timedelta(hours=1)
FAILURES = 3
LONGEST = timedelta(minutes=1)


def backoff(failures: int, base: timedelta = timedelta(seconds=2)) -> timedelta:
    """The pause after some failures in a row: doubled each time, one minute at most."""
    return min(base * 2 ** max(failures - 1, 0), LONGEST) if failures else timedelta(0)


def carried(new: DataFrame, old: DataFrame, values: list[str]) -> DataFrame:
    """New rows; where a source gave nothing, the previous generation's, marked stale."""
    before = old.select("path", *(F.col(v).alias(f"old_{v}") for v in values))
    both = new.join(before, "path", "left")
    stale = F.col(values[0]).isNull() & F.col(f"old_{values[0]}").isNotNull()
    return both.select("path", *(F.coalesce(v, f"old_{v}").alias(v) for v in values), stale.alias("stale"))


def episodes(current: DataFrame, reported: DataFrame, complete: bool) -> tuple[DataFrame, DataFrame]:
    """Diagnostics to report now, and what counts as reported afterwards: a complete walk forgets what vanished."""
    keys = current.columns
    new = current.join(reported, keys, "left_anti")
    return new, current if complete else reported.unionByName(current).distinct()


def unchanged(a: DataFrame, b: DataFrame) -> bool:
    """Whether two scans have the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def freshness(page: DataFrame, disk: DataFrame, published: DataFrame, cap: int = 1 << 40) -> DataFrame:
    """How a page stands to its file and the published generation, decided in a fixed order.

    ``page``: path, page (its digest) and, if it carries one, embeds; ``disk``: path, disk and, if known, size and fault (null, lookup or read);
    ``published``: path, published and, if known, embeds (as they would be now), for every path that the generation knows, be it blocked or without a body (then null)."""
    def whole(rows: DataFrame, prefix: str, digest: str, **more: str) -> DataFrame:
        return rows.select("path", digest, *((F.col(c) if c in rows.columns else F.lit(None).cast(t)).alias(f"{prefix}_{c}") for c, t in more.items()), F.lit(True).alias(f"in_{prefix}"))

    both = whole(page, "page", "page", embeds="string").join(whole(disk, "disk", "disk", size="bigint", fault="string"), "path", "full")
    both = both.join(whole(published, "published", "published", embeds="string"), "path", "full")
    state = (
        F.when(F.col("in_disk").isNull() | (F.col("disk_fault").isNull() & F.col("disk").isNull() & F.col("disk_size").isNull()), "gone")
        .when(F.col("disk_fault") == "lookup", F.when(F.col("in_published"), "unreadable").otherwise("gone"))
        .when(F.col("disk_size") > cap, F.when(F.col("published").isNotNull(), "preparing").otherwise("stale"))
        .when(F.col("disk_fault") == "read", "unreadable")
        .when(~F.col("published").eqNullSafe(F.col("disk")), "preparing")
        .when(~F.col("disk").eqNullSafe(F.col("page")), "stale")
        .when(F.col("page_embeds").isNotNull() & ~F.col("page_embeds").eqNullSafe(F.coalesce("published_embeds", F.lit(""))), "stale")
        .otherwise("unchanged")
    )
    return both.select("path", "page", "disk", "published", state.alias("state"))


def to_read(files: DataFrame, before: DataFrame, notes: DataFrame) -> DataFrame:
    """The files that are new or differ from the generation before, and those of notes that were only carried over."""
    settled = before.join(notes.where("stale").select("path"), "path", "left_anti")
    return files.exceptAll(settled.select(files.columns))


def renewed(files: DataFrame, again: DataFrame, fresh: DataFrame, notes: DataFrame) -> DataFrame:
    """The notes of a generation: those of files not read again, what was read (``fresh``, with a column error), and for files that gave nothing the note before, marked stale."""
    good = fresh.where("error is null").withColumn("stale", F.lit(False))
    lost = again.select("path").join(good.select("path"), "path", "left_anti")
    readable = notes.where("error is null")
    kept = notes.join(again.select("path"), "path", "left_anti").join(files.select("path"), "path", "left_semi")
    over = readable.join(lost, "path", "left_semi").withColumn("stale", F.lit(True))
    bad = fresh.where("error is not null").join(readable.select("path"), "path", "left_anti").withColumn("stale", F.lit(False))
    return kept.unionByName(good).unionByName(over).unionByName(bad)


@dataclass
class State:
    """What the loop remembers between ticks, kept in the pointer file."""

    generation: int = 0
    built_at: str = ""
    failures: int = 0
    next_at: str = ""
    degraded: bool = False
    tables: list[str] = field(default_factory=list)


class Generations:
    """Publishes what ``build`` makes of the files, when their listing changes.

    With ``parse`` (files to notes with path and error) the notes are a table of their own, renewed by what changed, and ``build`` is given files and notes."""

    def __init__(self, spark: SparkSession, root: str, scan: Callable[[], DataFrame], build: Callable[..., dict[str, DataFrame]], digest: Callable[[], str] = lambda: "", parse: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.scan, self.build, self.digest, self.parse = spark, root, scan, build, digest, parse
        self.authority = digest()
        self.pointer = Pointer(spark, f"{root}/current.json")

    def state(self) -> State:
        text = self.pointer.read()
        return State(**json.loads(text)) if text else State()

    def _publish(self, state: State) -> None:
        self.pointer.write(json.dumps(asdict(state)))

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        """A table of the current generation, or of a pinned one."""
        g = self.state().generation if generation is None else generation
        return self.spark.read.parquet(f"{self.root}/gen={g:08d}/{table}")

    def _write(self, number: int, name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{self.root}/gen={number:08d}/{name}")
        return self.read(name, number)

    def _notes(self, number: int, files: DataFrame) -> DataFrame:
        if not self.state().generation:
            return self._write(number, "notes", self.parse(files).withColumn("stale", F.lit(False)))
        before = self.read("notes")
        again = self._write(number, "changes", to_read(files, self.read("files"), before))
        fresh = self._write(number, "read", self.parse(again))  # three parts of the union read it
        return self._write(number, "notes", renewed(files, again, fresh, before))

    def tick(self, now: datetime | None = None) -> str:
        """One round: idle, unchanged, waiting, closed (the contract changed), failed or published."""
        now = now or datetime.now(timezone.utc)
        state = self.state()
        if self.digest() != self.authority:
            return "closed"
        if state.next_at and now < datetime.fromisoformat(state.next_at):
            return "waiting"
        try:
            files = self.scan()
            due = not state.built_at or now - datetime.fromisoformat(state.built_at) >= FORCED
            if state.generation and not due and unchanged(files, self.read("files").select(files.columns)):
                return "unchanged"
            number = state.generation + 1
            if self.parse:
                files = self._write(number, "files", files)
                tables = self.build(files, self._notes(number, files))
            else:
                tables = {"files": files, **self.build(files)}
            for name, table in tables.items():
                self._write(number, name, table)
        except Exception as error:
            state.failures += 1
            state.degraded = state.failures >= FAILURES
            state.next_at = (now + backoff(state.failures)).isoformat()
            self._publish(state)
            return f"failed: {type(error).__name__}"
        own = {"files", "notes"} if self.parse else set()
        self._publish(State(number, now.isoformat(), tables=sorted(own | set(tables))))
        return "published"

    def start(self, checkpoint: str) -> StreamingQuery:
        """Ticks from a rate stream, each handled as one micro-batch."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda batch, n: self.tick()).option("checkpointLocation", checkpoint).trigger(processingTime=TICK).start()
