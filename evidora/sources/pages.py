"""Stored search pages as a data source, with the retry rules of a live one (SRC-01, SRC-03..05, SRC-08, SRC-09, SET-06, UDF-02)."""

from __future__ import annotations

import functools
import json
import random
import re
import time
from collections.abc import Callable, Iterator, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.html import challenged, search_rows

NO_MATCH = "no matching results"


def retry_delay(status: int, attempt: int, retry_after: str | None = None, *, network_error: bool = False) -> int | None:
    """Milliseconds to wait before the next try; None if there is none to make (SRC-03, SRC-05)."""
    if network_error:
        return 220 * attempt
    if status in (429, 503):
        seconds = int(retry_after) if retry_after and retry_after.isdigit() else 0
        return seconds * 1000 + 120 * attempt
    return None


#: Search parameters by option (the session lower-cases options), and the document types of a court (fixed values).
TEXT_PARAMETERS = {"doctypes": "doctypes", "title": "title", "cite": "cite", "author": "author", "bench": "bench"}
DATE_PARAMETERS = {"fromdate": "fromdate", "todate": "todate"}
COURT_DOCTYPES = {"SC": "supremecourt", "HC": "highcourts"}
MOST_CITES, MOST_PAGES = 50, 1000


def api_date(text: str | None) -> str | None:
    """A date as D-M-YYYY, from that form (also with slashes) or from YYYY-MM-DD; None of anything else."""
    text = (text or "").strip()
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", text):
        year, month, day = m.groups()
    elif m := re.fullmatch(r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})", text):
        day, month, year = m.groups()
    else:
        return None
    try:
        found = date(int(year), int(month), int(day))
    except ValueError:
        return None
    return f"{found.day}-{found.month}-{found.year}"


def search_parameters(options: Mapping[str, str]) -> dict[str, str]:
    """The parameters of a search that options ask for (SRC-01): document types, or those of a court; dates; title, citation, author and bench; how many cites; how many pages at once.

    Empty values, dates that are none and numbers that are none are left out; numbers are held to their most.
    """
    out = {name: options[k].strip() for k, name in TEXT_PARAMETERS.items() if (options.get(k) or "").strip()}
    court = COURT_DOCTYPES.get((options.get("court") or "").strip().upper())
    if court and "doctypes" not in out:
        out["doctypes"] = court
    out |= {name: found for k, name in DATE_PARAMETERS.items() if (found := api_date(options.get(k)))}
    for k, most in (("maxcites", MOST_CITES), ("pagesatonce", MOST_PAGES)):
        number = (options.get(k) or "").strip()
        if number.isdigit() and int(number) > 0:
            out["maxpages" if k == "pagesatonce" else k] = str(min(int(number), most))
    return out


class Slots:
    """Time slots of a request rate that several tasks share without talking to one another.

    Time is cut into slots of 1/rate seconds, numbered from the epoch; of `lanes` lanes, lane k has the slots whose number is k modulo
    lanes, and makes one request at the start of each slot of its own at most.  So all lanes together keep the rate, whenever they start and however many of
    them run at once, as far as the machines' clocks agree.
    """

    def __init__(self, rate: float, lane: int, lanes: int) -> None:
        self.rate, self.lane, self.lanes, self.last = rate, lane, lanes, -1

    def next_start(self, now: float) -> tuple[int, float]:
        """(number, start) of the next slot of this lane that hasn't begun and wasn't used."""
        number = max(int(now * self.rate) + 1, self.last + 1)
        number += (self.lane - number) % self.lanes
        return number, number / self.rate

    def wait(self, ends: float) -> bool:
        """Wait for the next own slot; False if it comes after the time (of the monotonic clock) at which all ends."""
        if not self.rate:
            return True
        now = time.time()
        number, start = self.next_start(now)
        if time.monotonic() + start - now > ends:
            return False
        time.sleep(max(0.0, start - now))
        self.last = number
        return True


class Lane(InputPartition):
    def __init__(self, number: int, phrases: list[str]) -> None:
        self.number, self.phrases = number, phrases


class PageReader(DataSourceReader):
    """Asks a fetcher for page after page of each phrase; one partition a phrase, or with a rate `lanes` partitions of phrases that share it.

    A refused or failed request is tried again after its delay, `retries` times at most; an error that stays is a row with status 0 and
    the error's name.  Reading stops when a phrase has used up its time.  A filter on the phrase is answered by asking only for those.
    """

    def __init__(self, phrases: list[str], max_pages: int, fetch: Callable[..., tuple], retries: int, budget_ms: int, rate: float, lanes: int = 4, parameters: dict[str, str] | None = None):
        if parameters:  # only a fetcher that takes them is asked with them
            fetch = functools.partial(fetch, parameters=parameters)
        self.phrases, self.max_pages, self.fetch, self.retries, self.budget_ms, self.rate = phrases, max(1, min(10, max_pages)), fetch, retries, budget_ms, rate
        self.lanes = max(1, min(lanes, len(phrases))) if rate else max(1, len(phrases))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("phrase",):
                self.phrases = [p for p in self.phrases if p == f.value]
            elif isinstance(f, In) and f.attribute == ("phrase",):
                self.phrases = [p for p in self.phrases if p in f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Lane(k, self.phrases[k :: self.lanes]) for k in range(self.lanes)]

    def _asked(self, phrase: str, page: int, ends: float, slots: Slots) -> tuple[int, str] | None:
        status, html = 0, ""
        for attempt in range(1, self.retries + 2):
            if not slots.wait(ends):
                return (status, html) if attempt > 1 else None
            try:
                status, html, *after = self.fetch(phrase, page)
                delay = retry_delay(status, attempt, after[0] if after else None)
            except (OSError, ValueError) as e:  # what a request can fail with
                status, html = 0, type(e).__name__
                delay = retry_delay(0, attempt, network_error=True)
            if delay is None or attempt > self.retries:
                break
            wait = (delay + random.uniform(0, 40)) / 1000
            if time.monotonic() + wait > ends:
                break
            time.sleep(wait)
        return status, html

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        slots = Slots(self.rate, partition.number, self.lanes)
        for phrase in partition.phrases:
            ends = time.monotonic() + self.budget_ms / 1000
            for page in range(self.max_pages):
                if page and time.monotonic() > ends:
                    break
                asked = self._asked(phrase, page, ends, slots)
                if asked is None:
                    break
                yield phrase, page, *asked
                if asked[0] != 200 or NO_MATCH in asked[1].lower():
                    break


def page_source(fetch: Callable[[str, int], tuple], name: str = "search_pages") -> type[DataSource]:
    """A data source class over a fetcher (phrase, page) -> (status, html[, retry-after]); register it with the session.

    Options: the search parameters (search_parameters), which the fetcher gets as its argument `parameters` if there are any; phrases (a JSON list, or phrases parted by vertical bars), maxPages, retries, budgetMs (a phrase), requestsPerSecond of all tasks of a read
    together, and readers, the number of tasks that share it (4).
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "phrase string, page int, status int, html string"

        def reader(self, schema) -> DataSourceReader:
            own = self.options
            phrases = own.get("phrases", "")
            listed = json.loads(phrases) if phrases.startswith("[") else phrases.split("|")
            return PageReader([p for p in listed if p], int(own.get("maxPages", "3")), fetch, int(own.get("retries", "2")), int(own.get("budgetMs", "20000")), float(own.get("requestsPerSecond", "0")), int(own.get("readers", "4")), search_parameters({k.lower(): v for k, v in own.items()}))

    return Pages


def crawl(pages: DataFrame, base: str, *, most: int = 20) -> DataFrame:
    """(phrase, url, title, place) of stored pages in order, an address once a phrase (SRC-04, FLT-03)."""
    good = pages.where((F.col("status") == 200) & ~challenged(F.col("html")))
    # the page before the phrase, so that the phrase may have any character
    rows = search_rows(good.withColumn("page_key", F.concat(F.lpad(F.col("page").cast("string"), 4, "0"), F.col("phrase"))), base, page_id="page_key")
    rows = rows.withColumn("phrase", F.substring("page_key", 5, 1 << 30)).withColumn("page_key", F.left("page_key", F.lit(4)))
    first = rows.groupBy("phrase", "url").agg(F.min(F.struct("page_key", "ordinal", "title")).alias("f"))
    from ..operators.ranking import top_within

    return top_within(first, ["phrase"], [F.asc("f.page_key"), F.asc("f.ordinal"), F.asc("url")], most, "place").select("phrase", "url", F.col("f.title").alias("title"), "place")


def browse_links(pages: DataFrame, base: str, *, block: str = "info") -> DataFrame:
    """(page_id, url): the browse and search links of a page's information block, or of the page without one, each once (SRC-08).

    The block is the first division whose class has `block` in its name.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    found_block = F.regexp_extract(html, rf"(?is)(<div[^>]*class=[\"'][^\"']*{block}[^\"']*[\"'][^>]*>.*?</div>)", 1)
    found = F.regexp_extract_all(F.when(found_block != "", found_block).otherwise(html), F.lit(r"(?i)<a[^>]+href=[\"']([^\"']+)[\"']"), 1)
    whole = F.transform(found, lambda h: F.when(h.startswith("http"), h).when(h.startswith("/"), F.concat(F.lit(base), h)))
    kept = F.array_distinct(F.filter(whole, lambda h: h.isNotNull() & (F.contains(h, F.lit("/browse/")) | F.contains(h, F.lit("/search/")))))
    return pages.select("page_id", F.explode(kept).alias("url"))


def expanded(rows: DataFrame, more: DataFrame, *, group: str = "phrase", keys: tuple[str, ...] = ("docId", "documentId", "id", "tid", "url")) -> DataFrame:
    """A search's rows and those of its expansion by category, the first of each key; rows without any key go (SET-01, SET-06).

    Both have `ordinal`; the search's rows come first.
    """
    both = rows.withColumn("_part", F.lit(0)).unionByName(more.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    named = [F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys if k in both.columns]
    keyed = both.withColumn("_key", F.coalesce(*named)).where("_key is not null")
    from ..operators.ingest import first_wins

    return first_wins(keyed, [group, "_key"], [F.asc("_part"), F.asc("ordinal")]).drop("_part", "_key")


def relaxed(strict: DataFrame, broad: DataFrame, group: str = "phrase") -> DataFrame:
    """Strict rows, and broad ones for the groups that have no strict row (SRC-09)."""
    return strict.unionByName(broad.join(strict.select(group).distinct(), group, "left_anti"))


def register(spark: SparkSession, fetch: Callable[[str, int], tuple[int, str]], name: str = "search_pages") -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader answers filters on the phrase
    spark.dataSource.register(page_source(fetch, name))
