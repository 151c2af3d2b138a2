"""What is known of a job while its files are read: as a stream with state for each job, and as a batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PER_FILE, RECENT = 8, 10
LINK = "struct<url:string,page:int,source:string>"
#: Input: one row for each file that is done, in any order within a batch. nth is its place in the order of completion.
FILE_DONE = f"job string, nth long, done_at timestamp, n_pages int, error string, links array<{LINK}>"
STATE = f"job string, phase string, files_done long, files_failed long, pages_scanned long, recent array<{LINK}>"


def _link(x) -> tuple:
    """A link as it comes from a row or from the state."""
    return tuple(x.values()) if isinstance(x, dict) else tuple(x)


class JobState(StatefulProcessor):
    """Totals and the newest links of a job; a job that has been quiet for so long in event time is closed and forgotten."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "files_done long, files_failed long, pages_scanned long, closes long")
        self.recent = handle.getValueState("recent", f"links array<{LINK}>")

    def _row(self, job: str, phase: str) -> Row:
        done, failed, pages, _ = self.totals.get()
        return Row(job=job, phase=phase, files_done=done, files_failed=failed, pages_scanned=pages, recent=list(map(_link, self.recent.get()[0])))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done, failed, pages, closes = self.totals.get() or (0, 0, 0, None)
        recent = list(map(_link, self.recent.get()[0])) if self.recent.exists() else []
        last = 0
        for r in sorted(rows, key=lambda r: r.nth):
            done, last = done + 1, max(last, int(r.done_at.timestamp() * 1000))
            if r.error is not None:
                failed += 1
                continue
            pages += max(r.n_pages or 0, 1)
            own = r.links if r.links is not None else []
            recent = (list(map(_link, own[-PER_FILE:])) + recent)[:RECENT]
        if closes is not None:
            self.handle.deleteTimer(closes)
        closes = max(closes or 0, last + self.quiet_ms)
        self.handle.registerTimer(closes)
        self.totals.update((done, failed, pages, closes))
        self.recent.update((recent,))
        yield self._row(key[0], "extract")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._row(key[0], "done")
        self.totals.clear()
        self.recent.clear()

    def close(self) -> None:
        pass


def job_updates(done: DataFrame, late: str = "1 minute", quiet_ms: int = 600_000) -> DataFrame:
    """A stream of files that are done as one of jobs (STATE): a row for each job that a batch touches, and one of phase done when it is quiet.

    Needs the state store provider of RocksDB. A file without links counts; a failed one adds to files_done and
    files_failed only. Files that are done in later batches count as later, whatever their nth.
    """
    return done.withWatermark("done_at", late).groupBy("job").transformWithState(statefulProcessor=JobState(quiet_ms), outputStructType=STATE, outputMode="Update", timeMode="EventTime")


def jobs_done(done: DataFrame) -> DataFrame:
    """The same from all files of the jobs at once, without the phase."""
    newest = lambda files: F.aggregate(files, F.array().cast(f"array<{LINK}>"), lambda kept, f: F.slice(F.concat(F.slice(f["links"], _first(f["links"]), F.lit(PER_FILE)), kept), 1, RECENT))
    good = F.col("error").isNull()
    links = F.coalesce("links", F.array().cast(f"array<{LINK}>"))
    read = done.groupBy("job").agg(
        F.count("*").alias("files_done"), F.count("error").alias("files_failed"), F.coalesce(F.sum(F.when(good, F.greatest(F.coalesce("n_pages", F.lit(0)), F.lit(1)))), F.lit(0)).cast("long").alias("pages_scanned"),
        F.array_sort(F.collect_list(F.when(good, F.struct("nth", links.alias("links"))))).alias("files"),
    )
    return read.select("job", "files_done", "files_failed", "pages_scanned", newest(F.col("files")).alias("recent"))


def _first(links: Column) -> Column:
    return F.greatest(F.lit(1), F.size(links) - PER_FILE + 1)
