"""Elements of JSON lists in large files, read piece by piece.

Spark reads a file as records that end at closing braces, in as many splits as
it likes; the records of a file then pass through one task in their order, which
holds the element that it is reading and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = re.compile(r'["{}\[\],]')
_TEXT_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)


class Splitter:
    """The elements of one document: of a list at its top, or of the first list under one of ``names`` in an object at its top.

    With ``single`` an object at the top is the only element.
    """

    def __init__(self, names: tuple[str, ...], single: bool = False):
        self.names, self.single = names, single
        self.open: list[str] = []
        self.quoted = self.escaped = self.started = self.ended = False
        self.level = 0  # of the list, once it has begun
        self.head = ""  # what stands before a bracket of the object at the top
        self.parts: list[str] = []
        self.error: str | None = None

    def feed(self, text: str) -> Iterator[str]:
        """Elements that end in the next piece of the document."""
        begin, at = 0, int(self.escaped and bool(text))
        self.escaped = self.escaped and not text
        while at < len(text) and not self.error:
            if self.quoted:
                end = _TEXT_END.match(text, at)
                if not end:  # the text goes on in the next piece, perhaps in the middle of an escape
                    rest = text[at:]
                    self.escaped = (len(rest) - len(rest.rstrip("\\"))) % 2 == 1
                    break
                at, self.quoted = end.end(), False
                continue
            mark = _MARK.search(text, at)
            if not mark:
                if not self.started and text[at:].strip("\ufeff \t\r\n"):
                    self.error = "no list"
                break
            at, sign = mark.end(), mark[0]
            if not self.open and (self.started or text[begin : mark.start()].strip("\ufeff \t\r\n") or sign not in "[{"):
                self.error = "broken JSON"
            elif sign == '"':
                self.quoted = True
            elif sign in "[{":
                listed = sign == "[" and not self.level and (not self.open or (len(self.open) == 1 and self._named(text[begin : mark.start()])))
                self.open.append(sign)
                if listed or (self.single and not self.started and sign == "{"):
                    self.level = len(self.open) if listed else -1
                    begin = at if listed else mark.start()
                    self.head, self.parts = "", []
                self.started = True
            elif sign in "]}":
                if not self.open or self.open.pop() != "[{"["]}".index(sign)]:
                    self.error = "broken JSON"
                elif (self.level > 0 and len(self.open) == self.level - 1) or (self.level < 0 and not self.open):
                    self.parts.append(text[begin : mark.start() if self.level > 0 else at])
                    yield from self._element()
                    self.level, self.ended, begin = 10**9, True, at  # nothing is this deep
                elif not self.level:
                    self.head, begin = "", at
            elif sign == "," and self.level > 0 and len(self.open) == self.level:
                self.parts.append(text[begin : mark.start()])
                yield from self._element()
                begin = at
            elif sign == "," and not self.level and len(self.open) == 1:
                self.head, begin = "", at
        if not self.ended:
            if self.level:
                self.parts.append(text[begin:])
            elif len(self.open) == 1:
                self.head += text[begin:]

    def _named(self, before: str) -> bool:
        key = _KEY.search(self.head + before)
        return bool(key) and key[1] in self.names

    def _element(self) -> Iterator[str]:
        found, self.parts = "".join(self.parts).strip(), []
        if found:
            yield found

    def finish(self) -> str | None:
        """What is wrong with the document, if anything."""
        if not self.error and (self.open or self.quoted):
            self.error = "ends early"
        elif not self.error and self.started and not self.ended:
            self.error = "no list"
        return self.error


def _split(names: tuple[str, ...], single: bool):
    def run(batches):
        path, splitter, number, held, size, read = None, None, 0, None, 0, 0

        def rows(texts, last=False):
            nonlocal number
            out = []
            for text in texts:
                for item in splitter.feed(text):
                    out.append((path, number, item, None))
                    number += 1
            if last and splitter.finish():
                out.append((path, None, None, splitter.error))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "item_no", "item", "error"])

        def last_piece():
            # the separator after the last record is there if the file is so long
            return held + ("}" if read < size else "")

        for batch in batches:
            for at, length, text in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), batch.column("value").to_pylist()):
                if at != path:
                    if splitter:
                        yield from rows([last_piece()], last=True)
                    path, splitter, number, held, size, read = at, Splitter(names, single), 0, None, length, 0
                if held is not None:
                    read += 1  # a separator stands between two records
                    yield from rows([held + "}"])
                held = text
                read += len(text.encode())
        if splitter:
            yield from rows([last_piece()], last=True)

    return run


def read_elements(spark: SparkSession, path: str, names: tuple[str, ...] = (), single: bool = False) -> DataFrame:
    """(path, item_no, item, error): a row for each element of the list in each file, and one with ``error`` for a file that is broken, ends early or has no list.

    Elements before the place of an error are there.  An empty file has no row.  Of several lists under ``names`` the one that comes first in the file counts.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"), "value"
    )
    pieces = pieces.repartition("path").sortWithinPartitions("path", "start", "nth")
    return pieces.select("path", "size", "value").mapInArrow(_split(names, single), "path string, item_no long, item string, error string")
