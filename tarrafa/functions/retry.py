"""Fetch outcomes as column expressions: status labels, retry delays, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States after which a page is not fetched again.
TERMINAL = ["ok", "not_found", "gone", "login_required", "forbidden", "blocked"]
# What name resolution errors say.
DNS_MARKERS = ["temporary failure in name resolution", "name or service not known", "nodename nor servname provided", "failed to resolve", "getaddrinfo failed", "name resolution", "max retries exceeded"]


def backoff_seconds(attempt: Column, base: float = 2.0, most: float = 90.0) -> Column:
    """Exponential delay before the jitter: base, twice base, ... up to ``most``."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1))


# Seconds to the next attempt by state, as (states, per attempt, at most); DEFAULT_DELAY for others.
DELAYS = [
    (("rate_limited",), 1800, 1800),
    (("server_error", "download_failed"), 300, 21_600),
    (("extract_failed", "no_title", "no_content", "error"), 3600, 86_400),
]
DEFAULT_DELAY = 7200


def retry_seconds(status: Column, attempts: Column) -> Column:
    """Seconds to the next attempt; null for a terminal status. A null status counts as unknown."""
    rules = F.create_map(*[x for states, each, most in DELAYS for s in states for x in (F.lit(s), F.struct(F.lit(each).alias("each"), F.lit(most).alias("most")))])
    rule = F.try_element_at(rules, F.coalesce(status, F.lit("")))
    scheduled = F.least(rule["most"], rule["each"] * F.greatest(F.lit(1), F.coalesce(attempts, F.lit(1))))
    return F.when(~F.coalesce(status, F.lit("")).isin(TERMINAL), F.coalesce(scheduled, F.lit(DEFAULT_DELAY)))


def next_retry_at(status: Column, attempts: Column, now: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(now) + retry_seconds(status, attempts))


def status_label(code: Column) -> Column:
    """The label of a plain response; null for 200."""
    named = F.when(code == 404, "not_found").when(code == 410, "gone").when(code == 403, "forbidden").when(code == 429, "rate_limited")
    return named.when(code >= 500, "server_error").when(code != 200, "download_failed")


def raised_label(code: Column) -> Column:
    """The label of a status that arrived as an exception, once all candidate addresses are tried."""
    return F.when(code >= 500, "download_failed").otherwise(F.coalesce(status_label(code), F.lit("download_failed")))


def crawl_label(code: Column) -> Column:
    """The crawler's label: only 403 and 404 end its retries with a label of their own."""
    return F.when(code.isin(403, 404), F.when(code == 403, "forbidden").otherwise("not_found")).otherwise("download_failed")


def is_dns_error(message: Column) -> Column:
    found = F.lit(False)
    for marker in DNS_MARKERS:
        found = found | F.contains(F.lower(F.coalesce(message, F.lit(""))), F.lit(marker))
    return found


def extraction_status(title: Column, content: Column, failed: Column) -> Column:
    """ok, no_title, no_content or extract_failed of what a page gave."""
    has = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0
    return F.when(F.coalesce(failed, F.lit(False)), "extract_failed").when(~has(title), "no_title").when(~has(content), "no_content").otherwise("ok")
