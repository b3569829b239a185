"""A SPARQL endpoint as a Spark data source: one partition for each batch of items, fetched in tasks, with back-off, further
endpoints to fall back to, and answers kept in a shared folder.

    spark.dataSource.register(statements_source(fetch, ["https://one/sparql", "https://two/sparql"]))
    spark.read.format("statements").option("ids", "Q1 Q2").option("cache", "s3://bucket/answers").load()

``fetch`` is the caller's function from an endpoint and a query to the JSON answer; no connection is opened here. Rows have the
number of their batch, their place in its answer, and the values of the answer's variables.

Cases: without ids there are no partitions and no rows. A batch whose endpoints all fail fails its task, which Spark runs
again; batches that have been answered are then read from the folder. Answers that aren't JSON results count as failures and
aren't kept. Repeated ids are asked for once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .sparql import triples_query
from .store import cache_key, fetch_with_retry


@dataclass
class Batch(InputPartition):
    number: int
    ids: list[str]


class Answers:
    """Answers by endpoint and query in a folder that all tasks reach; without a folder nothing is kept."""

    def __init__(self, folder: str | None):
        self.store, self.top = pafs.FileSystem.from_uri(folder) if folder else (None, "")

    def get(self, key: str) -> str | None:
        if self.store is None or self.store.get_file_info(f"{self.top}/{key}.json").type == pafs.FileType.NotFound:
            return None
        with self.store.open_input_stream(f"{self.top}/{key}.json") as f:
            return f.read().decode()

    def put(self, key: str, answer: str) -> None:
        """Written under another name first, so that no reader sees a part of it."""
        if self.store is None:
            return
        self.store.create_dir(self.top)
        part = f"{self.top}/.{key}-{uuid.uuid4().hex[:8]}"
        with self.store.open_output_stream(part) as f:
            f.write(answer.encode())
        self.store.move(part, f"{self.top}/{key}.json")


def answer_of(fetch: Callable[[str, str], str], endpoints: list[str], query: str, answers: Answers, tries: int = 3, wait: float = 1.0, sleep: Callable = time.sleep) -> dict:
    """The answer to a query from the first endpoint that gives one, each asked ``tries`` times; the last error if none
    does."""
    for endpoint in endpoints:
        if (held := answers.get(cache_key(endpoint, query))) is not None:
            return json.loads(held)
    error: Exception | None = None
    for endpoint in endpoints:
        try:
            text = fetch_with_retry(lambda q, e=endpoint: fetch(e, q), query, tries, wait, sleep)
            found = json.loads(text)
            found["results"]["bindings"]
        except (OSError, ValueError, KeyError, TypeError) as e:
            error = e
            continue
        answers.put(cache_key(endpoint, query), text)
        return found
    raise error or ValueError("no endpoint")


def statements_source(fetch: Callable[[str, str], str], endpoints: list[str], name: str = "statements", query: Callable[[list[str]], str] = triples_query, tries: int = 3, wait: float = 1.0) -> type[DataSource]:
    """The data source class to register. Options: ids (separated by spaces), batch (ids of a partition, 50), cache."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.ids = sorted(set(options.get("ids", "").split()))
            self.batch, self.cache = int(options.get("batch", "50")), options.get("cache")

        def partitions(self) -> list[Batch]:
            return [Batch(k, self.ids[a : a + self.batch]) for k, a in enumerate(range(0, len(self.ids), self.batch))]

        def read(self, partition: Batch | None) -> Iterator[tuple]:
            if not isinstance(partition, Batch):  # what Spark asks for where there are no partitions
                return
            found = answer_of(fetch, endpoints, query(partition.ids), Answers(self.cache), tries, wait)
            for pos, row in enumerate(found["results"]["bindings"]):
                yield partition.number, pos, {k: v["value"] for k, v in row.items()}

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "batch int, pos long, row map<string,string>"

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    return Source
