"""Whether links work, from a table of probe results.

Probing is a side effect that this library leaves to its caller; a probe log has url_key, pos (place among the
candidates), candidate, dns_ok, http_code and error_text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls

WORKING, FAILED = "Working", "Not Working- error "
#: Probe results are shipped to every task up to so many rows; beyond, Spark joins by a shuffle.
BROADCAST_ROWS = 200_000


def response_works(code: Column, dns_ok: Column) -> Column:
    return (code < 400) | code.isin(401, 403) | (dns_ok & (code < 500))


def short_reason(error: Column) -> Column:
    """The first of the known reasons that an error text names, else its first 160 characters."""
    e = F.lower(error)
    # Results depend on these texts being exactly so.
    return (
        F.when(e.rlike("nameresolutionerror|failed to resolve|nodename nor servname"), "DNS lookup failed").when(e.contains("timed out"), "Timeout")
        .when(e.rlike("sslerror|ssl error|certificate"), "SSL Error").when(e.contains("connection refused"), "Connection refused")
        .when(e.rlike("connection reset|connection aborted"), "Connection reset").when(e.contains("max retries"), "Connection failed").otherwise(F.substr(error, F.lit(1), F.lit(160)))
    )


def port_of(url: Column) -> Column:
    """The port that is probed: the one written, else that of the scheme; null if it is no port."""
    written = F.try_to_number(F.regexp_extract(url, r"^[a-z]+://[^/?#]*:(\d{1,9})(?:[/?#]|$)", 1), F.lit("999999999")).cast("int")
    return F.when(written.isNotNull(), F.when(written <= 65535, written)).when(url.startswith("https://"), 443).when(url.startswith("http://"), 80)


def error_text(reason: Column, url: Column, code: Column) -> Column:
    port = port_of(url)
    return F.concat(F.lit(FAILED), F.when(code.isNotNull(), code.cast("string")).when(port.isNotNull(), F.concat(reason, F.lit(" port "), port.cast("string"))).otherwise(reason))


def probe_works(code: Column, error: Column, dns_ok: Column) -> Column:
    """Whether one probe shows a working link; resets count as such, and certificates where the name resolves."""
    e, resolved = F.lower(error), F.coalesce(dns_ok, F.lit(False))
    reset = e.rlike("connection reset|connection aborted") & (resolved | (short_reason(error) != "DNS lookup failed"))
    return F.coalesce(F.when(code.isNotNull(), response_works(code, resolved)).otherwise(reset | (e.rlike("sslerror|ssl error|certificate") & resolved)), F.lit(False))


def fold_probes(probes: DataFrame, within: list[str] | None = None) -> DataFrame:
    """One row per url_key: status. The first working candidate decides; else the last code, else the last reason.

    Probes of several runs are folded run by run with the columns that tell the runs apart as within, which come along.
    Where a run has two results for one candidate, the larger code or reason counts.
    """
    works = probe_works(F.col("http_code"), F.col("error_text"), F.col("dns_ok"))
    last = lambda c, given: F.max(F.when(given.isNotNull() & F.col("pos").isNotNull(), F.struct("pos", c.alias("value"))))["value"]
    folded = probes.groupBy(*(within or []), "url_key").agg(
        F.max(works).alias("works"), last(F.col("http_code"), F.col("http_code")).alias("code"), last(short_reason(F.col("error_text")), F.col("error_text")).alias("reason"),
        F.min(F.when(F.col("pos").isNotNull(), F.struct("pos", "candidate")))["candidate"].alias("first"),
    )
    return folded.select(*(within or []), "url_key", F.when(F.col("works"), WORKING).otherwise(error_text(F.coalesce("reason", F.lit("Unknown Error")), F.col("first"), F.col("code"))).alias("status"))


def attach_status(rows: DataFrame, probes: DataFrame, within: list[str] | None = None) -> DataFrame:
    """rows with status: upi links work, ftp links are not checked, an empty link has none, others by their probes, those of their own run with within."""
    found = fold_probes(probes, within)
    found = F.broadcast(found) if probes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else found
    key, url = urls.link_key(F.col("url")), F.lower(F.trim("url"))
    status = (
        F.when(url == "", "").when(url.startswith("upi://"), WORKING).when(url.startswith("ftp://"), FAILED + "FTP URLs are not HTTP-checked")
        .otherwise(F.coalesce("status", F.lit(FAILED + "Empty URL")))
    )
    return rows.drop("status").withColumn("url_key", key).join(found, [*(within or []), "url_key"], "left").withColumn("status", status).drop("url_key")


def candidate_table(rows: DataFrame) -> DataFrame:
    """What a prober has to try: url_key, pos, candidate, one row for each distinct link and candidate."""
    links = rows.where(F.trim("url") != "").groupBy(urls.link_key(F.col("url")).alias("url_key")).agg(F.min_by("url", "seq").alias("url"))
    return links.select("url_key", F.posexplode(urls.candidates(urls.normalize(F.col("url")))).alias("pos", "candidate"))
