"""Records of a search service, page by page, as a Spark data source: ``spark.read.format("paged_records")``.

The service speaks the public search protocol with points in time: a snapshot is opened once, each task pages through a slice of it
behind the last record it has seen. A request can so be sent again without losing or doubling a record, and a task
that is run again reads the same slice of the same snapshot.
"""

from __future__ import annotations

import http.client
import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from termspire.sources.corpus import LANGUAGES, record_documents

NAME = "paged_records"
SCHEMA = "lang string, PN string, CLM array<string>, DETD array<string>, DETDL string, IPC array<string>"
#: Answers of the service that another try may turn into good ones.
PASSING = (408, 425, 429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Patience:
    """How often a request is sent again, for how many seconds it may run, and the unit of pauses between requests.

    A pause is one to ten units, before a repeated request as often as it was tried.
    """

    retries: int = 100
    timeout: float = 30.0
    unit: float = 0.1

    def rest(self, times: int = 1) -> None:
        time.sleep(random.randint(1, 10) * self.unit * times)


class Gone(Exception):
    """The service doesn't answer."""


def ask(url: str, body: dict, patience: Patience) -> dict:
    """The service's answer; time-outs, broken connections, overload and incomplete answers are asked again, other errors raise."""
    data = json.dumps(body).encode()
    for tried in range(1, patience.retries + 2):
        wait = 0.0
        try:
            request = urllib.request.Request(url, data, {"Content-Type": "application/json"}, method="POST")
            with urllib.request.urlopen(request, timeout=patience.timeout) as answer:
                found = json.loads(answer.read())
            if not found.get("timed_out") and not found.get("_shards", {}).get("failed"):
                return found
            last: Exception = Gone("an answer without all shards")
        except urllib.error.HTTPError as e:
            if e.code not in PASSING:
                raise
            last, after = e, e.headers.get("Retry-After", "")
            wait = float(after) if after.isdigit() else 0.0
        except (urllib.error.URLError, TimeoutError, ConnectionError, http.client.HTTPException, json.JSONDecodeError) as e:
            last = e
        if tried <= patience.retries:
            time.sleep(wait)
            patience.rest(tried)
    raise Gone(f"{url} failed {patience.retries + 1} times") from last


def language_query(lang: str) -> dict:
    """Records with claims in ``lang``, or with a description that is in it."""
    described = {"bool": {"filter": [{"term": {"DETDL": lang}}, {"exists": {"field": "DETD"}}]}}
    return {"bool": {"should": [{"exists": {"field": f"CLM{lang.upper()}"}}, described], "minimum_should_match": 1}}


class Slice(InputPartition):
    """A share of a language's records in a snapshot."""

    def __init__(self, lang: str, part: int, parts: int, snapshot: str):
        super().__init__((lang, part))
        self.lang, self.part, self.parts, self.snapshot = lang, part, parts, snapshot


def pages(url: str, part: Slice, size: int, patience: Patience) -> Iterator[list[dict]]:
    """The records of a slice, a list a page. A page with fewer than ``size`` records is the last; one that comes again is asked anew."""
    body = {
        "size": size, "query": language_query(part.lang), "pit": {"id": part.snapshot, "keep_alive": "5m"}, "sort": [{"_shard_doc": "asc"}], "track_total_hits": False,
        "_source": [f"CLM{part.lang.upper()}", "DETD", "DETDL", "PN", "IPC"],
    }
    if part.parts > 1:
        body["slice"] = {"id": part.part, "max": part.parts}
    after, stale = None, 0
    while True:
        found = ask(f"{url}/_search", body | ({"search_after": after} if after else {}), patience)
        body["pit"]["id"] = found.get("pit_id", body["pit"]["id"])
        hits = found["hits"]["hits"]
        fresh = [h for h in hits if after is None or h["sort"] > after]
        if hits and not fresh:
            stale += 1
            if stale > patience.retries:
                raise Gone(f"{url} repeats a page")
            patience.rest(stale)
            continue
        if fresh:
            after, stale = fresh[-1]["sort"], 0
            yield [h["_source"] for h in fresh]
        if len(hits) < size:
            return
        patience.rest()


def _list(value) -> list[str] | None:
    if value is None:
        return None
    return [str(v) for v in value if v is not None] if isinstance(value, list) else [str(value)]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("url") or not options.get("index"):
            raise ValueError("a paged source needs the options url and index")
        self.url, self.index = options["url"].rstrip("/"), options["index"]
        self.size, self.parts = int(options.get("pageSize", 500)), int(options.get("slices", 8))
        self.languages = [x.strip().lower() for x in options.get("languages", ",".join(LANGUAGES)).split(",")]
        self.patience = Patience(int(options.get("retries", 100)), float(options.get("timeout", 30)), float(options.get("pause", 0.1)))
        if self.size < 1 or self.parts < 1:
            raise ValueError("pageSize and slices are 1 at least")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Languages that are asked for become requests of these alone; all other filters stay with Spark."""
        for f in filters:
            own = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if own is None or f.attribute != ("lang",):
                yield f
            else:
                self.languages = [x for x in self.languages if x in own]

    def partitions(self) -> list[Slice]:
        """A task for each language and slice, all of one snapshot."""
        if not self.languages:
            return []
        snapshot = ask(f"{self.url}/{self.index}/_pit?keep_alive=5m", {}, self.patience)["id"]
        return [Slice(lang, i, self.parts, snapshot) for lang in self.languages for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Slice):
            return  # no language is left; Spark runs an empty task
        claims = f"CLM{partition.lang.upper()}"
        for page in pages(self.url, partition, self.size, self.patience):
            for r in page:
                one = lambda c: None if (x := _list(r.get(c))) is None else " ".join(x)  # noqa: B023, E731
                yield partition.lang, one("PN"), _list(r.get(claims)), _list(r.get("DETD")), one("DETDL"), _list(r.get("IPC"))


class PagedRecords(DataSource):
    """Options: url, index, languages (comma-separated), pageSize (500), slices (tasks a language, 8), retries (100), timeout (30) and pause (0.1), in seconds."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedRecords)


def read_paged_documents(spark: SparkSession, url: str, index: str, lang: str, **options: object) -> DataFrame:
    """The documents of a service in ``lang``, as ``read_json_documents`` has them from files."""
    register(spark)
    rows = spark.read.format(NAME).options(url=url, index=index, languages=lang, **options).load()
    return record_documents(rows)
