"""Downloads with retries, as rows. The getter is a parameter, so an engine without a network can be given saved files.

A run that is repeated with ``relational.pending(wanted, done, ["url"])`` fetches
only what has not come yet.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An answer must be longer; one that does not tell its length counts as just long enough.
LEAST_BYTES = 20
SCHEMA = "title string, url string, down_status boolean, tries int, content binary"


class Answer(NamedTuple):
    status: int
    length: int | None
    chunks: Iterator[bytes]


def http_get(url: str, chunk: int = 1 << 16) -> Answer:
    """Over HTTP, in chunks."""
    from urllib.request import urlopen

    response = urlopen(url, timeout=60)  # noqa: S310
    length = response.headers.get("Content-Length")
    return Answer(response.status, None if length is None else int(length), iter(lambda: response.read(chunk), b""))


def attempts(get: Callable[[str], Answer], url: str, tries: int = 5, rounds: int = 10, pause: float = 5.0) -> Iterator[tuple[int, bytes | None, bool | None]]:
    """(try, chunk, None) for every chunk that comes, then (try, None, whether that try was whole); nothing is held."""
    n = 0
    for k in range(rounds):
        for _ in range(tries):
            n += 1
            try:
                answer = get(url)
                if answer.status == 200 and (LEAST_BYTES + 1 if answer.length is None else answer.length) > LEAST_BYTES:
                    for chunk in answer.chunks:
                        yield n, chunk, None
                    yield n, None, True
                    return
            except OSError:
                pass
            if pause and n < tries * rounds:
                time.sleep(pause * (1 + (k > 0)))
    yield n, None, False


def try_get(get: Callable[[str], Answer], url: str, tries: int = 5, rounds: int = 10, pause: float = 5.0) -> tuple[bytes | None, int]:
    """The content and how often it was asked for; None if no try succeeded. For contents that fit in memory."""
    held: dict[int, list[bytes]] = {}
    for n, chunk, whole in attempts(get, url, tries, rounds, pause):
        if whole is None:
            held = {n: [*held.pop(n, []), chunk]}
    return (b"".join(held.get(n, [])), n) if whole else (None, n)


PARTS = "title string, url string, try int, part int, content binary, down_status boolean"


def fetch_parts(wanted: DataFrame, get: Callable[[str], Answer] = http_get, tries: int = 5, rounds: int = 10, pause: float = 5.0, part_bytes: int = 8 << 20) -> DataFrame:
    """title, url -> rows of about ``part_bytes`` as they come, and a last row for each with down_status.

    To be written as it is; ``whole_parts`` then keeps the parts of the try that was whole.
    """
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["title", "url", "try", "part", "content", "down_status"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for title, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, at, part = bytearray(), 0, 0
                for n, chunk, whole in attempts(get, url, tries, rounds, pause):
                    if n != at:
                        held.clear()
                        at, part = n, 0
                    if chunk:
                        held += chunk
                    if held and (len(held) >= part_bytes or whole):
                        yield row(title, url, n, part, bytes(held), None)
                        held.clear()
                        part += 1
                    if whole is not None:
                        yield row(title, url, n, None, None, whole)

    return wanted.select("title", "url").mapInArrow(run, PARTS)


def whole_parts(parts: DataFrame) -> DataFrame:
    """title, url, part and content of the downloads that are whole."""
    done = parts.where("down_status").select("url", "try")
    return parts.where("part IS NOT NULL").join(done, ["url", "try"], "left_semi").select("title", "url", "part", "content")


def fetch(wanted: DataFrame, get: Callable[[str], Answer] = http_get, tries: int = 5, rounds: int = 10, pause: float = 5.0) -> DataFrame:
    """title, url -> a row for each, with its content or down_status false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for title, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content, n = try_get(get, url, tries, rounds, pause)
                columns = ((title, pa.string()), (url, pa.string()), (content is not None, pa.bool_()), (n, pa.int32()), (content, pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], names=["title", "url", "down_status", "tries", "content"])

    return wanted.select("title", "url").mapInArrow(run, SCHEMA)


def status_map(fetched: DataFrame) -> DataFrame:
    """title and down_status: a map of url to whether it has come."""
    return fetched.groupBy("title").agg(F.map_from_entries(F.collect_list(F.struct("url", "down_status"))).alias("down_status"))
