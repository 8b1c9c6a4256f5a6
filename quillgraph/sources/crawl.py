"""Crawling: seeds to cleaned documents.  Fetching is a provider; without a network, pages come from a table."""

from __future__ import annotations

import sys
import logging
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text, web
from quillgraph.sources.files import read_lines

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS, DELAY, TIMEOUT = 500, 2.0, 20.0
USER_AGENT = "quillgraph/1.0 (graph builder)"

LOG = logging.getLogger(__name__)

#: Takes a URL and gives (final URL, status, body), or None where there is no answer.
Fetch = Callable[[str], tuple[str, int, str] | None]


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """url: one per line; blank lines and comments are skipped, none left is an error."""
    return read_lines(spark, path, required=True).select(F.col("value").alias("url"))


def http_fetch(url: str) -> tuple[str, int, str] | None:
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": USER_AGENT}), timeout=TIMEOUT) as r:
            return r.url, r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except (OSError, ValueError) as e:  # no answer, a status of an error, an address that is none
        LOG.warning("no page from %s: %s", url, e)
        return None


class Robots:
    """robots.txt by scheme and host, asked for once each; an unreadable one allows all if ``fail_open``."""

    def __init__(self, fetch: Fetch, agent: str = USER_AGENT, fail_open: bool = True):
        self.fetch, self.agent, self.fail_open = fetch, agent, fail_open
        self.known: dict[str, RobotFileParser | None] = {}

    def allowed(self, url: str) -> bool:
        parts = urlsplit(url)
        key = f"{parts.scheme}://{parts.netloc}"
        if key not in self.known:
            got = self.fetch(key + "/robots.txt")
            parser = None
            if got is not None and got[1] < 300:
                parser = RobotFileParser()
                parser.parse(got[2].splitlines())
            self.known[key] = parser
        parser = self.known[key]
        return self.fail_open if parser is None else parser.can_fetch(self.agent, url)


FETCHED = "url string, final_url string, status_code int, allowed_by_robots boolean, html string"


def fetch_pages(urls: DataFrame, fetch: Fetch = http_fetch, delay: float = DELAY, agent: str = USER_AGENT, fail_open: bool = True) -> DataFrame:
    """url, final_url, status_code, allowed_by_robots, html.

    A host's URLs are fetched by one task, one after another with a pause between, which is what a polite
    crawl of a host allows; hosts are fetched side by side.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        robots = Robots(fetch, agent, fail_open)
        for batch in batches:
            rows = []
            for url in batch["url"]:
                if not robots.allowed(url):
                    rows.append((url, None, None, False, None))
                    continue
                got = fetch(url)
                rows.append((url, *(got if got is not None and got[1] < 300 else (None, got[1] if got else None, None))))
                rows[-1] = (*rows[-1][:3], True, rows[-1][3])
                if delay:
                    time.sleep(delay)
            yield pd.DataFrame(rows, columns=["url", "final_url", "status_code", "allowed_by_robots", "html"]).astype({"status_code": "Int32"})

    by_host = urls.select("url").distinct().repartition(F.try_parse_url("url", F.lit("AUTHORITY")))
    return by_host.mapInPandas(run, FETCHED)


def documents(pages: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Cleaned documents with at least ``min_words`` words of pages that may be read and have text."""
    body, method = web.extracted("html")
    rows = pages.where(F.coalesce("allowed_by_robots", F.lit(True)) & F.col("html").isNotNull())
    host = web.hostname(F.coalesce("final_url", "url"))
    docs = rows.select(
        "url",
        F.coalesce("final_url", "url").alias("final_url"),
        "status_code",
        "allowed_by_robots",
        F.current_timestamp().alias("fetched_at"),
        web.title("html").alias("title"),
        web.meta("html", "author").alias("author"),
        web.meta("html", "date").alias("date"),
        host.alias("hostname"),
        web.language("html").alias("language"),
        body.alias("text"),
        method.alias("extraction_method"),
    )
    return docs.where("text is not null").withColumn("word_count", text.word_count("text")).where(F.col("word_count") >= min_words)


def crawl_counts(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: saved, skipped."""
    return docs.agg(F.count("*").alias("saved")).join(pages.agg(F.count("*").alias("asked"))).select("saved", (F.col("asked") - F.col("saved")).alias("skipped"))
