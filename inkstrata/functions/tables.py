"""Table functions in Python that SQL can call once they are registered.

    SELECT d.id, b.* FROM docs d, LATERAL archive_blocks(d.text) b
    SELECT * FROM tight_spans(TABLE(SELECT unit, pos, sentence, named, labels FROM s) PARTITION BY unit ORDER BY pos)

Spark deals the rows by the partition's columns, sorts them, and hands one partition after the other to an instance of the class; what is kept
between rows is what the class says.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .unicode import archive_blocks

LEAST, MOST = 20, 150


class ArchiveBlocks:
    """(head_no, head, chapter, text) of an archive's text; a head's own row has neither chapter nor text. A null text has no rows."""

    def eval(self, text: str) -> Iterator[tuple]:
        for b in archive_blocks(text) if text is not None else ():
            yield b["head_no"], b["head"], b["chapter"], b["text"]


class TightSpans:
    """(unit, k, text): the tightest runs of a unit's sentences that name every label, from left to right without overlap.

    Rows are (unit, pos, sentence, named, labels) in order of pos: the labels that a sentence names, and all of the unit's. It is complete at the
    sentence that names the last missing label, and begins as late as it can, or further back while it has under LEAST words; runs
    of over MOST words are left out. Kept are the sentences since the last run. Null sentences and empty ones are passed over; a unit without labels has no runs.
    """

    def __init__(self) -> None:
        self.sentences: list[tuple[str, int]] = []
        self.last: dict[str, int] = {}
        self.k = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        labels = set(row["labels"] or ())
        if not labels or not (row["sentence"] or "").strip():
            return
        self.sentences.append((row["sentence"], len(row["sentence"].split())))
        self.last |= dict.fromkeys(labels & set(row["named"] or ()), len(self.sentences) - 1)
        if self.last.keys() < labels:
            return
        first, words = len(self.sentences), 0
        while first > 0 and (first > min(self.last.values()) or words < LEAST):
            first -= 1
            words += self.sentences[first][1]
        if LEAST <= words <= MOST:
            yield row["unit"], self.k, " ".join(s for s, _ in self.sentences[first:])
            self.k += 1
        self.sentences, self.last = [], {}


def register(spark: SparkSession) -> None:
    """Make archive_blocks and tight_spans known to the session's SQL."""
    spark.udtf.register("archive_blocks", udtf(ArchiveBlocks, returnType="head_no int, head string, chapter int, text string"))
    spark.udtf.register("tight_spans", udtf(TightSpans, returnType="unit string, k int, text string"))
