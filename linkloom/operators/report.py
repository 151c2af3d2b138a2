"""Summaries, filters and orderings of result rows (file_idx, file_name, page_number, seq, source, location, url, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.exact import exact_round
from linkloom.operators.numbering import number_runs

PREVIEW, RECENT = 120, 10


def is_working() -> Column:
    return F.col("status") == "Working"


def is_failed() -> Column:
    return F.contains(F.lower("status"), F.lit("not working"))


FILTERS = {
    "all": lambda: F.lit(True), "working": is_working, "failed": is_failed, "qr": lambda: F.col("source") == "qr",
    "image": lambda: F.col("source").isin("image", "logo"), "header": lambda: F.col("location") == "header", "footer": lambda: F.col("location") == "footer",
}


def stats() -> list[Column]:
    """The counts of a job, one aggregate each."""
    n = lambda c, name: F.count_if(c).alias(name)
    return [
        F.count("*").alias("urls_found"), n(F.col("location") == "header", "header_urls"), n(F.col("location") == "footer", "footer_urls"),
        n(F.col("source") == "qr", "qr_urls"), n(F.col("source").isin("image", "logo"), "image_urls"), n(is_working(), "working_urls"),
        n(is_failed(), "failed_urls"), n(F.col("status") != "", "urls_checked"), F.count_distinct("file_idx").alias("files"), F.count_distinct("file_idx", "page_number").alias("pages"),
    ]


def job_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(*stats())


def file_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_idx", "file_name").agg(F.count("*").alias("n_urls"), F.count_distinct("page_number").alias("n_pages"), F.count_if(is_working()).alias("n_working"))


def filter_counts(rows: DataFrame) -> DataFrame:
    """How many rows each named filter shows."""
    one = rows.agg(*(F.count_if(f()).alias(k) for k, f in FILTERS.items()))
    return one.unpivot([], list(FILTERS), "filter", "n_rows")


def rollup_report(rows: DataFrame) -> DataFrame:
    """Counts by file, source and location with all subtotals."""
    return rows.rollup("file_idx", "source", "location").agg(F.count("*").alias("n_urls"), F.count_if(is_working()).alias("n_working"), F.grouping_id().alias("level"))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("file_idx", "page_number", "seq")


def preview(rows: DataFrame, n: int = PREVIEW) -> DataFrame:
    return in_order(rows).limit(n)


def recent(rows: DataFrame, n: int = RECENT) -> DataFrame:
    """The last rows, the newest first."""
    return rows.orderBy(F.desc("file_idx"), F.desc("page_number"), F.desc("seq")).limit(n)


def merge_file_cells(rows: DataFrame, name_col: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """island (runs of equal names in the order), and shown: the name in the first row of each run, null in the others.

    Without within, runs are counted over all rows by ranges of the order, so no task sees them all.
    """
    if not within:
        marked = number_runs(rows, name_col, order)
        return marked.withColumn("shown", F.when(F.col("__first"), F.col(name_col))).drop("__first")
    w = Window.partitionBy(*within).orderBy(*order)
    changed = F.when(F.lag(name_col).over(w).eqNullSafe(F.col(name_col)), 0).otherwise(1)
    marked = rows.withColumn("__new", changed)
    return marked.withColumn("island", F.sum("__new").over(w)).withColumn("shown", F.when(F.col("__new") == 1, F.col(name_col))).drop("__new")


def progress_curve(rows: DataFrame) -> DataFrame:
    """Links found up to each page of a file."""
    pages = rows.groupBy("file_idx", "page_number").agg(F.count("*").alias("n_urls"))
    w = Window.partitionBy("file_idx").orderBy("page_number")
    return pages.withColumn("urls_so_far", F.sum("n_urls").over(w)).withColumn("pages_done", F.row_number().over(w))


def snapshot_json(rows: DataFrame) -> DataFrame:
    """The job's counts as one JSON text."""
    return job_stats(rows).select(F.to_json(F.struct("*")).alias("snapshot"))


def result_columns(rows: DataFrame) -> DataFrame:
    """The report's columns under their names, nulls as empty texts."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = {"Filename": "file_name", "Filename Date": "file_date", "Last 4 Digits": "last4", "Client ID": "client_id", "Form Type": "form_type"}
    return rows.select("file_idx", "seq", *(empty(c).alias(k) for k, c in names.items()), F.col("page_number").alias("Page Number"), empty("source").alias("Source"), F.lit("").alias("QR Code Attachment"), empty("url").alias("URL"), empty("status").alias("Status"))


def recent_running(rows: DataFrame, per_file: int = 8, n: int = RECENT) -> DataFrame:
    """The list shown while files are read: the last rows of the newest file in their order, then those of the files before."""
    last = F.row_number().over(Window.partitionBy("file_idx").orderBy(F.desc("page_number"), F.desc("seq")))
    # at most n files matter: each of them shows a row at least
    newest = rows.select("file_idx").distinct().orderBy(F.desc("file_idx")).limit(n)
    return rows.join(F.broadcast(newest), "file_idx").withColumn("__last", last).where(F.col("__last") <= per_file).drop("__last").orderBy(F.desc("file_idx"), "page_number", "seq").limit(n)


def more_note(rows: DataFrame, n: int = PREVIEW) -> DataFrame:
    """How many rows a preview shows, and the note on those that it does not."""
    total = rows.agg(F.count("*").alias("n_rows"))
    hidden = F.col("n_rows") - n
    return total.select("n_rows", F.least("n_rows", F.lit(n)).cast("long").alias("n_shown"), F.when(hidden > 0, F.concat(hidden.cast("string"), F.lit(" more"))).otherwise("").alias("note"))


def progress(phase: Column, done: Column, total: Column) -> Column:
    """Percent of a job: reading files goes from 8 to 68, checking links from 72 to 94, then 96 and 100."""
    share = done / F.greatest(total, F.lit(1))
    return (
        F.when(phase == "extract", F.least(8 + F.floor(share * 62), F.lit(68))).when(phase == "verify", F.least(72 + F.floor(share * 22), F.lit(94)))
        .when(phase == "report", 96).when(phase == "done", 100).otherwise(0).cast("int")
    )


def pages_scanned(files: DataFrame) -> DataFrame:
    """Pages of the files (n_pages, error) that were read, one at least for each."""
    return files.agg(_scanned().alias("pages_scanned"))


def _scanned() -> Column:
    return F.coalesce(F.sum(F.when(F.col("error").isNull(), F.greatest(F.coalesce("n_pages", F.lit(0)), F.lit(1)))), F.lit(0)).cast("long")


def full_stats(rows: DataFrame, files: DataFrame, n_files: int | None, phase: str) -> DataFrame:
    """The counts of a job in the phase: those of its rows, files_total (n_files, or all that are given), files_done and pages_scanned of the files (n_pages, error) so far, and the phase."""
    one = lambda df: df.withColumn("__k", F.lit(1))
    total = F.count("*") if n_files is None else F.lit(n_files).cast("long")
    read = files.agg(F.count("*").alias("files_done"), _scanned().alias("pages_scanned"), total.alias("files_total"))
    return one(job_stats(rows).drop("files", "pages")).join(one(read), "__k").drop("__k").withColumn("phase", F.lit(phase))


def snapshot(rows: DataFrame, files: DataFrame, job_id: str, n_files: int, phase: str, message: str = "", error: str | None = None) -> DataFrame:
    """What a client is told of a job: job_id, status, progress, message, stats, recent (the last rows, the newest first), and error where it failed."""
    stats = full_stats(rows, files, n_files, phase)
    newest = recent(rows).select(F.struct("file_idx", "page_number", "seq", "url", "source", "location", "status").alias("r"))
    order = lambda a, b: sum((F.signum(b[c] - a[c]) * k for c, k in (("file_idx", 4), ("page_number", 2), ("seq", 1))), F.lit(0.0)).cast("int")
    listed = newest.agg(F.array_sort(F.collect_list("r"), order).alias("recent"))
    done = F.col("stats.urls_checked") if phase == "verify" else F.col("stats.files_done")
    total = F.col("stats.urls_found") if phase == "verify" else F.col("stats.files_total")
    status = F.lit("failed" if error else "completed" if phase == "done" else "running")
    both = stats.select(F.struct("*").alias("stats")).withColumn("__k", F.lit(1)).join(listed.withColumn("__k", F.lit(1)), "__k")
    return both.select(F.lit(job_id).alias("job_id"), status.alias("status"), progress(F.lit(phase), done, total).alias("progress"), F.lit(message).alias("message"), "stats", "recent", F.lit(error).cast("string").alias("error"))


def result_totals(rows: DataFrame, files: DataFrame, seconds: Column | float | None = None, most_warnings: int = 1000) -> DataFrame:
    """One row of totals of a finished job: counts of rows, files and pages, the time it took in tenths of a second, and the warnings of files that failed, in order.

    warnings holds the first most_warnings texts; n_warnings counts all.
    """
    one = lambda df: df.withColumn("k", F.lit(1))
    listed = files.where("error is not null").select("error").orderBy("error").limit(most_warnings).agg(F.array_join(F.array_sort(F.collect_list("error")), "\n").alias("warnings"))
    counted = files.agg(F.count("*").alias("files_processed"), F.count("error").alias("n_warnings"), _scanned().alias("pages_scanned"))
    took = exact_round(F.lit(seconds) if not isinstance(seconds, Column) else seconds, 1)
    totals = one(job_stats(rows).drop("files", "pages", "urls_checked").withColumnRenamed("urls_found", "total_urls")).join(one(counted), "k").join(one(listed), "k").drop("k")
    return totals.withColumn("processing_time_seconds", took)


def report_name(files: DataFrame) -> DataFrame:
    """The report's file name: that of the only input, or a common one."""
    stem = F.regexp_replace(F.min("file_name"), r"(?<=.)\.[^.]*$", "")
    return files.agg(F.when(F.count("*") == 1, F.concat(stem, F.lit("_urls.xlsx"))).otherwise("extracted_urls.xlsx").alias("report_name"))


def escape_html(value: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(mark), F.lit(name))
    return value


def user_message(error: Column, fallback: Column | str, away: str = "Cannot reach the server.") -> Column:
    """What a client shows for an error's text: away where no server answers, the fallback where there is none or an empty one."""
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    raw = F.coalesce(F.nullif(error, F.lit("")), other)
    return F.when(raw.rlike("(?i)failed to fetch|networkerror"), away).otherwise(raw)


def format_bytes(n: Column) -> Column:
    """A size in B, KB, MB or GB, with one decimal below 10."""
    power = F.least(F.lit(3), F.when(n >= 1 << 30, 3).when(n >= 1 << 20, 2).when(n >= 1 << 10, 1).otherwise(0))
    value = n / F.pow(F.lit(1024.0), power)
    number = F.when((value >= 10) | (power == 0), F.round(value).cast("long").cast("string")).otherwise(F.format_string("%.1f", value))
    return F.when(n <= 0, "0 B").otherwise(F.concat(number, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), (power + 1).cast("int"))))


def status_style(status: Column) -> Column:
    """How the sheet shows a status: good, bad, or plain where there is none."""
    return F.when(F.trim(status) == "Working", "good").when(F.trim(status) != "", "bad").otherwise("plain")
