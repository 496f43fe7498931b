"""A data source over an interface that serves rows by offset: every partition asks for its own pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.quality import DataQualityError

#: Rows of a request, and requests of a partition, unless options say otherwise.
PAGE, PAGES = 100, 10


@dataclass
class Span(InputPartition):
    """Rows [start, end) of ``total``."""

    start: int
    end: int
    total: int


def checked(payload: object, total: int | None = None) -> tuple[list[dict], int]:
    """(rows, total) of a page ``{"rows": [{"row": {...}}], "num_rows_total": n, "partial": false}``, or an error."""
    if not isinstance(payload, dict):
        raise DataQualityError("a page must be an object")
    if payload.get("partial") is True:
        raise DataQualityError("a page is partial")
    rows, said = payload.get("rows"), payload.get("num_rows_total")
    if not isinstance(rows, list):
        raise DataQualityError("a page has no list of rows")
    for i, r in enumerate(rows):
        if not isinstance(r, dict) or not isinstance(r.get("row"), dict):
            raise DataQualityError(f"row {i} of a page is malformed")
    if type(said) is not int or said < 0:
        raise DataQualityError("a page's total is no number of rows")
    if total is not None and said != total:
        raise DataQualityError(f"the total changed between pages, from {total} to {said}")
    return [r["row"] for r in rows], said


def paged(name: str, fetch: Callable[[int, int], dict]) -> type[DataSource]:
    """A source to register: ``spark.dataSource.register(paged(name, fetch))``, then ``spark.read.format(name).schema(...)``.

    ``fetch(offset, length)`` gives a page; it is sent to the workers. One request tells the total, and
    partitions of ``pagesPerPartition`` requests of ``pageSize`` rows then read their own rows: none passes through the
    driver. A page may be short, then the next one starts where it ended. Every page must tell the same total and be whole, an empty page
    before a partition's end is an early end, and a page with more rows than were asked for is refused; so all rows
    come once or the read fails. A partition that is lost asks again. Columns are those of the schema; ``_pos`` is the row's offset.
    """

    class Reader(DataSourceReader):
        def __init__(self, schema: StructType, size: int, pages: int):
            self.names, self.size, self.pages = schema.fieldNames(), size, pages

        def partitions(self) -> list[InputPartition]:
            _, total = checked(fetch(0, self.size))
            step = self.size * self.pages
            return [Span(at, min(at + step, total), total) for at in range(0, total, step)] or [Span(0, 0, 0)]

        def read(self, partition: Span) -> Iterator[tuple]:
            at = partition.start
            while at < partition.end:
                asked = min(self.size, partition.end - at)
                rows, _ = checked(fetch(at, asked), partition.total)
                if not rows:
                    raise DataQualityError(f"pages ended at row {at} of {partition.total}")
                if len(rows) > asked:
                    raise DataQualityError(f"{len(rows)} rows came where {asked} were asked for")
                for i, row in enumerate(rows):
                    yield tuple(at + i if c == "_pos" else row.get(c) for c in self.names)
                at += len(rows)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def reader(self, schema: StructType) -> DataSourceReader:
            size, pages = (int(self.options.get(k, d)) for k, d in (("pageSize", PAGE), ("pagesPerPartition", PAGES)))
            if size < 1 or pages < 1:
                raise DataQualityError("pages and partitions hold 1 row at least")
            return Reader(schema, size, pages)

    return Paged
