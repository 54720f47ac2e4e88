"""Chunking for SQL: table functions that a query joins laterally, or hands a whole table partitioned by page.

    register(spark)
    SELECT p.page_id, c.* FROM pages p, LATERAL chunk_page(p.title, p.content) c
    SELECT * FROM chunk_table(TABLE(SELECT page_id, title, content FROM pages) PARTITION BY page_id)

Rows go to the workers in Arrow batches; a page's chunks are made one by one, so a long page isn't held twice. The text rules are those of
``functions.text``, in Python: its white space is that of ``str.split``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..plans.config import ChunkConfig
from .chunking import paragraph_words, stream_chunks

_CHUNK = "chunk_id bigint, title string, chunk_text string, paragraph_index bigint, subchunk_index bigint"


def squeeze(text: str | None) -> str:
    return " ".join((text or "").split())


def _chunks(title: str | None, content: str | None) -> Iterator[tuple]:
    title = squeeze(title)
    for i, (text, paragraph, part) in enumerate(stream_chunks(paragraph_words(content or ""), ChunkConfig())):
        yield i, title, text, paragraph, part


class ChunkPage:
    """A page's chunks from its title and content."""

    def eval(self, title: str, content: str) -> Iterator[tuple]:
        yield from _chunks(title, content)


class ChunkTable:
    """The chunks of a table of pages (page_id, title, content), each with its page's id."""

    def eval(self, row: Row) -> Iterator[tuple]:
        for chunk in _chunks(row["title"], row["content"]):
            yield row["page_id"], *chunk


def register(spark: SparkSession) -> None:
    """Makes ``chunk_page`` and ``chunk_table`` known to the session's SQL."""
    spark.udtf.register("chunk_page", udtf(ChunkPage, returnType=_CHUNK, useArrow=True))
    spark.udtf.register("chunk_table", udtf(ChunkTable, returnType=f"page_id bigint, {_CHUNK}", useArrow=True))
