"""Progress of a job while it runs: observed in a batch by an Observation, in a stream by a listener, batch by batch."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from linkloom.operators import rows

PAGES, LINKS = "linkloom_pages", "linkloom_links"


def observe_pages(pages: DataFrame, name: str | Observation = PAGES) -> DataFrame:
    """pages, counted as they go by: pages_done, last_page."""
    return pages.observe(name, F.count(F.lit(1)).alias("pages_done"), F.max("page_number").alias("last_page"))


def observe_links(found: DataFrame, name: str | Observation = LINKS) -> DataFrame:
    """Rows of links, counted as they go by: urls_found, and those of each kind of source."""
    by = lambda *kinds: F.count_if(F.col("source").isin(*kinds))
    return found.observe(name, F.count(F.lit(1)).alias("urls_found"), by("text").alias("text_urls"), by("hyperlink").alias("hyperlink_urls"), by("qr").alias("qr_urls"), by("image", "logo").alias("image_urls"))


def watched_links(pages: DataFrame) -> DataFrame:
    """Links of pages, a batch or a stream of them, with both observed; each row of pages is read by itself."""
    seen = observe_pages(pages)
    return observe_links(rows.hyperlink_occurrences(seen).unionByName(rows.text_occurrences(seen)))


class Progress(StreamingQueryListener):
    """Keeps one record for each batch of the streams that it hears of: query, batch, n_rows, and the observed counts, with their sums so far."""

    def __init__(self):
        self._lock, self._records, self._sums, self.ended = Lock(), [], {}, {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._sums[str(event.id)] = {}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = {k: v for row in p.observedMetrics.values() for k, v in row.asDict().items() if k != "last_page"}
        if not own and not p.numInputRows:
            return
        with self._lock:
            sums = self._sums.setdefault(str(p.id), {})
            for k, v in own.items():
                sums[k] = sums.get(k, 0) + v
            self._records.append({"query": str(p.id), "batch": p.batchId, "n_rows": p.numInputRows, **own, **{f"{k}_so_far": v for k, v in sums.items()}})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.ended[str(event.id)] = event.exception

    def records(self, query_id: str | None = None) -> list[dict]:
        """The records so far, the oldest first."""
        with self._lock:
            return [dict(r) for r in self._records if query_id in (None, r["query"])]
