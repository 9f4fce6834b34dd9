"""News APIs as a Spark data source, for batches and streams; the call itself is the user's function.

``spark.read.format("news")`` gives raw payloads (source, topic_name, payload, fetched_at), one for each request, and each request is a partition
of its own. ``fetch(request, run)`` gets a request and the number of the run and returns the response's text, or null where there was none; it runs inside tasks. A
stream counts runs: its offset is the last run that was taken, and ``latest()`` says which there are, so a batch that is repeated asks for the
same runs again. A provider without a key is an empty source.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, topic_name string, payload string, fetched_at timestamp_ntz"

# Parameters of the providers' requests.
EVERYTHING = {"language": "en", "sortBy": "publishedAt", "pageSize": 100}
HEADLINES = {"pageSize": 100}
GNEWS = {"lang": "en", "max": 10}
GNEWS_COUNTRY = "us"


@dataclass(frozen=True)
class Topic:
    """What is asked for under one label; ``mode`` is query or top."""

    label: str
    mode: str = "top"
    query: str | None = None
    country: str | None = "us"
    category: str | None = None
    gnews_query: str | None = None
    gnews_category: str | None = None


@dataclass(frozen=True)
class Request(InputPartition):
    """One call: a provider's endpoint and its parameters."""

    provider: str
    topic: str
    endpoint: str
    params: tuple[tuple[str, str], ...]
    run: int = 0


def requests_of(topics: Sequence[Topic], keys: dict[str, str]) -> list[Request]:
    """The calls for ``topics`` to the providers that have a key."""
    made = []
    for t in topics:
        if keys.get("newsapi"):
            if t.mode == "query" and t.query:
                made.append(("newsapi", t.label, "everything", {"q": t.query, **EVERYTHING}))
            else:
                made.append(("newsapi", t.label, "top-headlines", {**HEADLINES, "country": t.country, "category": t.category}))
        if keys.get("gnews"):
            if t.gnews_query:
                made.append(("gnews", t.label, "search", {"q": t.gnews_query, **GNEWS}))
            else:
                made.append(("gnews", t.label, "top-headlines", {"category": t.gnews_category, "country": GNEWS_COUNTRY, **GNEWS}))
    return [Request(provider, label, endpoint, tuple((k, str(v)) for k, v in params.items() if v)) for provider, label, endpoint, params in made]


Fetch = Callable[[Request, int], str | None]


def register(spark: SparkSession, fetch: Fetch, latest: Callable[[], int] = lambda: 0, name: str = "news") -> None:
    """Make ``fetch`` the source ``name``. Its options are ``topics`` (see ``options``) and a key for each provider (``newsapi``, ``gnews``)."""

    def rows(request: Request) -> Iterator[tuple]:
        payload = fetch(request, request.run)
        if payload is not None:
            yield request.provider, request.topic, payload, datetime.datetime.now(datetime.UTC).replace(tzinfo=None)

    def asked(options: dict[str, str], run: int) -> list[Request]:
        topics = [Topic(**t) for t in json.loads(options.get("topics", "[]"))]
        return [Request(r.provider, r.topic, r.endpoint, r.params, run) for r in requests_of(topics, {k: options.get(k, "") for k in ("newsapi", "gnews")})]

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.options = options

        def partitions(self) -> list[Request]:
            return asked(self.options, int(self.options.get("run", "0")))

        def read(self, partition: Request | None) -> Iterator[tuple]:
            return rows(partition) if partition is not None else iter(())

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.options = options

        def initialOffset(self) -> dict:
            return {"run": int(self.options.get("run", "0"))}

        def latestOffset(self) -> dict:
            return {"run": latest()}

        def partitions(self, start: dict, end: dict) -> list[Request]:
            return [r for run in range(start["run"] + 1, end["run"] + 1) for r in asked(self.options, run)]

        def read(self, partition: Request) -> Iterator[tuple]:
            return rows(partition)

    class News(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:  # noqa: ANN001
            return Reader(self.options)

        def streamReader(self, schema) -> Stream:  # noqa: ANN001
            return Stream(self.options)

    spark.dataSource.register(News)


def options(topics: Sequence[Topic], newsapi: str = "", gnews: str = "", run: int = 0) -> dict[str, str]:
    """Options of the source."""
    return {"topics": json.dumps([asdict(t) for t in topics]), "newsapi": newsapi, "gnews": gnews, "run": str(run)}
