"""Elements of large XML files, read by as many tasks as the file has splits.

Spark's text reader cuts a file into records at the end tag of the element, and a split begins at the first end tag in its
bytes. What surrounds an element (a definition of a paradigm, a section, a comment) may begin splits before it: each split
reports which context it leaves behind, with and without an open comment before it, one task carries the context through
the reports (one a split), and a second reading gives every element its context. No task holds more than a record.

Elements of the tag don't nest. Records are as long as an element and what stands before it. An empty file has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from ..operators.store import stored

ATTRIBUTE = r"""\b{}\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def in_order(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """Rows as a file reader gives them, with their number in order of path and place in the file, however the files are split."""
    m = F.col("_metadata")
    placed = rows.select("*", m["file_path"].alias("_file"), m["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_seq"))
    return numbered(placed, name, F.col("_file"), F.col("_block"), F.col("_seq")).drop("_file", "_block", "_seq")


class Scanner:
    """Elements and contexts of records: contexts are tags with an attribute that names them, as 'tag:name'."""

    def __init__(self, tag: str, contexts: dict[str, str]):
        around = "|".join(rf"<{c}\b[^>]*>|</{c}\s*>" for c in contexts)
        self.token = re.compile(rf"<!--|<{tag}(?=[\s>/])[^>]*>|{around}")
        self.tag, self.end = tag, f"</{tag}>"
        self.names = {c: re.compile(ATTRIBUTE.format(a)) for c, a in contexts.items()}

    def scan(self, record: str, context: str | None, comment: bool) -> tuple[str | None, bool, list[tuple[str | None, str]]]:
        """Context and open comment after a record, and its elements with their contexts."""
        found, at = [], 0
        while True:
            if comment:
                at = record.find("-->", at)
                if at < 0:
                    return context, True, found
                at, comment = at + 3, False
            m = self.token.search(record, at)
            if not m:
                return context, False, found
            text, at = m.group(), m.end()
            if text == "<!--":
                comment = True
            elif text.startswith(f"<{self.tag}") and text[len(self.tag) + 1 : len(self.tag) + 2] in " \t\r\n>/":
                if text.endswith("/>"):
                    found.append((context, text))
                else:
                    found.append((context, record[m.start() :] + self.end))
                    return context, False, found
            elif text.startswith("</"):
                context = ""
            else:
                name = re.match(r"<([\w.-]+)", text).group(1)
                hit = self.names[name].search(text)
                context = f"{name}:{(hit.group(1) or hit.group(2) or '') if hit else ''}"


def elements(spark: SparkSession, path: str, tag: str, contexts: dict[str, str]) -> DataFrame:
    """context, xml, ordinal (from 0 a file, in order, with gaps) and file of every element `tag` outside comments.

    contexts: tags that surround elements, and the attribute that names them; context is the last one open, as 'tag:name', or empty.
    """
    scanner = Scanner(tag, contexts)
    m = F.col("_metadata")
    records = spark.read.option("lineSep", scanner.end).text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple, list] = {}
        for b in batches:
            for text, file, block in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                two = ends.setdefault((file, block), [(None, False), (None, True)])
                for k in (0, 1):
                    two[k] = scanner.scan(text, *two[k])[:2]
        rows = [{"file": f, "block": b, "context": a[0], "comment": a[1], "context_in": c[0], "comment_in": c[1]} for (f, b), (a, c) in ends.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("block", pa.int64()), ("context", pa.string()), ("comment", pa.bool_()), ("context_in", pa.string()), ("comment_in", pa.bool_())]))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, context, comment = None, "", False
        for b in batches:
            out = []
            for x in b.to_pylist():
                if x["file"] != last:
                    last, context, comment = x["file"], "", False
                out.append({"_file": last, "_block": x["block"], "context": context, "comment": comment})
                new = x["context_in"] if comment else x["context"]
                context, comment = context if new is None else new, x["comment_in"] if comment else x["comment"]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("context", pa.string()), ("comment", pa.bool_())]))

    told = records.mapInArrow(report, "file string, block long, context string, comment boolean, context_in string, comment_in boolean")
    entries = stored(told.repartition(1).sortWithinPartitions("file", "block").mapInArrow(carry, "_file string, _block long, context string, comment boolean"))
    met = records.join(F.broadcast(entries), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).select("value", "file", "block", "context", "comment")  # a row a split

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, state = None, 0, ("", False)
        for b in batches:
            out = []
            for text, file, block, context, comment in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (file, block) != at:
                    at, n, state = (file, block), 0, (context, comment)
                *state, found = scanner.scan(text, *state)
                for c, xml in found:
                    out.append((c, xml, block + n, file))  # an element has more bytes than one: numbers of splits don't meet
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["context", "xml", "ordinal", "file"])

    return met.mapInArrow(read, "context string, xml string, ordinal long, file string")
