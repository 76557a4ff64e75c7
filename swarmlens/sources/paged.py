"""Paged search answers as a data source: ``spark.read.format("paged_search")`` and ``readStream``.

A folder holds one JSON document a page, named by its token; ``meta`` names the next one
(``next_token``) and how many posts a page has (``result_count``).  Planning follows the tokens,
for which it reads the beginning of each page alone; the pages are read by tasks, one each.
A filter on ``lang`` or ``author_id`` (``=`` or ``IN``) is pushed into the tasks, and
``max_results`` ends the walk over the pages.  A stream's offset is the token of the page
that it waits for: a run that is started again goes on there.  A page without data and
without errors is a heartbeat and gives no rows; one with errors and no data fails the
scan.  The walk ends at a page without a next token, or with one whose page is not there yet.

Pages are read through the file system that the path's scheme names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "id string, text string, author_id string, lang string, created_at string"
COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))
FIRST = "page-0"
PUSHED = ("lang", "author_id")
_HEAD = 4096


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")


def meta(path: str, token: str) -> dict | None:
    """A page's ``meta``, out of its first bytes where it stands there; None if there is no such page."""
    system, folder = _place(path)
    try:
        with system.open_input_stream(f"{folder}/{token}.json") as f:
            head = f.read(_HEAD)
            found = re.match(rb'\s*\{\s*"meta"\s*:\s*(\{[^{}]*\})', head)
            return json.loads(found[1]) if found else json.loads(head + f.read()).get("meta") or {}
    except FileNotFoundError:
        return None


def posts(path: str, token: str, kept: dict[str, set] | None = None) -> Iterator[tuple]:
    """The posts of a page, of the pushed values only."""
    system, folder = _place(path)
    with system.open_input_stream(f"{folder}/{token}.json") as f:
        found = json.loads(f.read())
    if found.get("errors") and not found.get("data"):
        raise RuntimeError(f"the search answered with an error on {token}: {found['errors']}")
    for post in found.get("data") or []:
        if all(post.get(c) in values for c, values in (kept or {}).items()):
            yield tuple(post.get(c) for c in COLUMNS)


def walk(path: str, token: str, until: str | None = None) -> Iterator[tuple[str, dict]]:
    """(token, meta) of the pages from ``token`` on, before ``until``."""
    while token and token != until and (found := meta(path, token)) is not None:
        yield token, found
        token = found.get("next_token")


class Page(InputPartition):
    def __init__(self, token: str, most: int | None = None):
        self.token, self.most = token, most


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], options.get("max_results")
        self.kept: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.kept[f.attribute[0]] = self.kept.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self) -> list[Page]:
        """``max_results`` counts posts of the answer, before filters, as the search itself does."""
        out, left = [], None if self.most is None else int(self.most)
        for token, found in walk(self.path, FIRST):
            if left is not None and left <= 0:
                break
            out.append(Page(token, left))
            if left is not None:
                left -= int(found.get("result_count") or 0)
        if not out:
            raise FileNotFoundError(f"no page {FIRST} in {self.path}")
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        every = posts(self.path, partition.token)
        kept = [(COLUMNS.index(c), values) for c, values in self.kept.items()]
        for n, post in enumerate(every):
            if partition.most is not None and n >= partition.most:
                return
            if all(post[i] in values for i, values in kept):
                yield post


class PagedStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.waits = options["path"], FIRST

    def initialOffset(self) -> dict:
        return {"waits_for": FIRST}

    def latestOffset(self) -> dict:
        """The first page that is not there; a reader that is new walks there from the first one, over the pages' beginnings."""
        for _, found in walk(self.path, self.waits):
            self.waits = found.get("next_token") or "end"
        return {"waits_for": self.waits}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(token) for token, _ in walk(self.path, start["waits_for"], end["waits_for"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from posts(self.path, partition.token)


class PagedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)


def register(spark) -> None:
    """Make the source known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSearch)


def write_pages(answers: DataFrame, path: str, first: int, last: int) -> None:
    """Posts (page, and the columns of ``SCHEMA``) as the pages ``first`` to ``last``, each pointing to the next number; a number without posts is a heartbeat.  Each page is written by one task, as a whole."""
    numbered = answers.sparkSession.range(first, last + 1).withColumnRenamed("id", "number")
    data = answers.groupBy("page").agg(F.collect_list(F.struct(*COLUMNS)).alias("data"))  # a page is small, as the search makes it
    whole = numbered.join(data, numbered["number"] == F.col("page"), "left")
    head = F.struct(F.greatest(F.size("data"), F.lit(0)).alias("result_count"), F.concat(F.lit("page-"), (F.col("number") + 1).cast("string")).alias("next_token"))
    pages = whole.select("number", F.to_json(F.struct(head.alias("meta"), "data")).alias("body"))

    def put(rows) -> None:
        system, folder = _place(path)
        system.create_dir(folder)
        for r in rows:
            with system.open_output_stream(f"{folder}/.page-{r['number']}.part") as f:
                f.write(r["body"].encode())
            system.move(f"{folder}/.page-{r['number']}.part", f"{folder}/page-{r['number']}.json")

    pages.foreachPartition(put)
