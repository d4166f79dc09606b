"""JSON files that hold one wrapped list or one record, read step by step.

Spark lists the files and deals them to tasks by size; a task opens each file
as a stream and gives out one row per element of its list, so neither a file nor
a list is ever one row, and memory is that of the longest element.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read at a time; content that is no JSON comes in pieces of this size.
STEP = 1 << 20
#: Bytes of values in one batch of rows.
_BATCH = 1 << 22
_SPACE = re.compile(r"[ \t\r\n﻿]*")
_SCHEMA = "path string, kind string, value string"


def open_stream(path: str):
    """A stream of the file at a Spark path."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem().open_input_stream(re.sub(r"^file:/+", "/", path))
    authority, _, inner = rest.lstrip("/").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system.open_input_stream(f"{base.rstrip('/')}/{inner}")


def can_open(path: str) -> bool:
    """Whether tasks can stream from the store of ``path`` (local and shared
    folders, and the stores that Arrow knows)."""
    scheme, colon, _ = path.partition(":")
    return not colon or "/" in scheme or scheme in ("file", "hdfs", "s3", "s3a", "gs", "abfs")


class _Text:
    """A stream's characters from ``at`` (or, while it is set, ``mark``) on,
    read as they are needed."""

    def __init__(self, stream, step: int):
        self.stream, self.step, self.text, self.at, self.ended = stream, step, "", 0, False
        self.mark: int | None = None
        self.decode = codecs.getincrementaldecoder("utf-8")(errors="replace").decode

    def more(self) -> bool:
        if self.ended:
            return False
        # as much again as is held, so a long element is tried few times
        data = self.stream.read(max(self.step, len(self.text) - self.at))
        self.ended = not data
        drop = self.at if self.mark is None else self.mark
        self.text, self.at = self.text[drop:] + self.decode(data, final=self.ended), self.at - drop
        self.mark = None if self.mark is None else 0
        return True

    def back(self) -> None:
        """Go back to the mark and remove it."""
        if self.mark is not None:
            self.at, self.mark = self.mark, None

    def peek(self) -> str:
        """The next character that is no white space, '' at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or not self.more():
                return self.text[self.at:self.at + 1]

    def value(self):
        """The next JSON value and its text; ValueError if there is none."""
        decoder = json.JSONDecoder(strict=False)
        self.peek()
        while True:
            try:
                value, end = decoder.raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:
                    text, self.at = self.text[self.at:end], end
                    return value, text
            except json.JSONDecodeError as e:
                cut_off = e.pos >= len(self.text) - 16 or e.msg.startswith("Unterminated")
                if not cut_off or self.ended:
                    raise
            self.more()

    def rest(self) -> Iterator[str]:
        while True:
            yield self.text[self.at:]
            self.text, self.at = "", 0
            if not self.more() or not self.text:
                return


def elements(stream, step: int = STEP) -> Iterator[tuple[str, str]]:
    """('record', text) of every record of a file, ('broken', text) of what is
    none, in pieces.

    An object whose first value is a list that begins with an object (or an
    empty list) is a wrapped list; its elements that are no objects and what
    stands behind the list are broken.  Any other object with more than one key
    is one record."""
    text = _Text(stream, step)
    if text.peek() != "{":
        yield from (("broken", x) for x in text.rest())
        return
    try:
        text.mark = text.at
        text.at += 1
        if text.peek() == '"':
            text.value()
            if text.peek() == ":":
                text.at += 1
                if text.peek() == "[":
                    text.at += 1
                    if text.peek() in ("{", "]"):
                        text.mark = None
                        yield from _listed(text)
                        return
        text.back()  # no list of records: the whole object is one value
        value, own = text.value()
        yield ("record" if len(value) > 1 else "broken"), own
        if text.peek():
            yield from (("broken", x) for x in text.rest())
    except ValueError:
        text.back()
        yield from (("broken", x) for x in text.rest())


def _listed(text: _Text) -> Iterator[tuple[str, str]]:
    while text.peek() != "]":
        value, own = text.value()
        yield ("record" if isinstance(value, dict) else "broken"), own
        if text.peek() == ",":
            text.at += 1
            if text.peek() == "]":
                raise ValueError("a comma before the end of a list")
        elif text.peek() != "]":
            raise ValueError("no list")
    text.at += 1
    if text.peek() == "}":
        text.at += 1
        if not text.peek():
            return
    yield from (("broken", x) for x in text.rest())


def read_wrapped(spark: SparkSession, root: str, glob: str, step: int = STEP) -> DataFrame:
    """(path, kind, value) of all files below ``root`` that match ``glob``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(root).select("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "kind", "value"])
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with open_stream(path) as stream:
                    for kind, value in elements(stream, step):
                        rows.append((path, kind, value))
                        size += len(value)
                        if size >= _BATCH:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)
    return files.mapInArrow(run, _SCHEMA)


def read_whole(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``read_wrapped`` for stores that only Spark opens: every file is one text
    row, its list one value; a file must fit into a task."""
    keys = F.json_object_keys("value")
    files = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
             .text(root).select(F.col("_metadata.file_path").alias("path"), "value").withColumn("n", F.size(keys)))
    listed = F.get(F.map_values(F.from_json("value", "map<string,array<string>>")), F.lit(0))
    files = files.withColumn("l", F.when(F.col("n") == 1, listed))
    one = files.select("path", F.when(F.col("n") > 1, "record").otherwise("broken").alias("kind"), "value", "l")
    return (one.where("l is null").select("path", "kind", "value")
            .unionByName(one.where("l is not null").select("path", F.explode("l").alias("value"))
                         .select("path", F.when(F.json_object_keys("value").isNotNull(), "record").otherwise("broken").alias("kind"),
                                 "value")))
