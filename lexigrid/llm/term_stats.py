"""Frequency of every term and in how many records it stands, with last-seen counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Counters:
    """For each term its occurrences, its records and the record that it was last seen in. Tokens come in the order of records, so a term's count of records moves just where the record differs
    from the one it was last seen in; no set of records or terms is kept. States live from block to block."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.occurrences, self.records, self.last = (np.zeros(1024, dtype=np.int64) for _ in range(3))

    def __len__(self) -> int:
        return len(self.place)

    def add(self, texts: pa.Array, weights: np.ndarray, records: np.ndarray) -> None:
        """Numbers of records rise from 1 and never come back once another one has begun."""
        lists = pc.split_pattern(texts, " ")
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        if not len(row):
            return
        place = self.place
        at = np.array([place.setdefault(t, len(place)) for t in coded.dictionary.to_pylist()])
        if len(place) > len(self.last):
            more = np.zeros(max(len(place), 2 * len(self.last)) - len(self.last), dtype=np.int64)
            self.occurrences, self.records, self.last = (np.concatenate([x, more]) for x in (self.occurrences, self.records, self.last))
        term = at[coded.indices.to_numpy(zero_copy_only=False)]
        by = np.argsort(term, kind="stable")
        term, row = term[by], row[by]
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        record = records[row]
        before = np.empty(len(record), dtype=np.int64)
        before[1:] = record[:-1]
        before[start] = self.last[term[start]]
        self.occurrences[term[start]] += np.add.reduceat(weights[row], start)
        self.records[term[start]] += np.add.reduceat((record != before).astype(np.int64), start)
        self.last[term[start]] = record[np.append(start[1:], len(record)) - 1]

    def states(self) -> pa.RecordBatch:
        n = len(self)
        return pa.RecordBatch.from_arrays([pa.array(list(self.place), pa.string()), pa.array(self.occurrences[:n]), pa.array(self.records[:n])], names=["term", "occurrences", "records"])

    def forget(self, open_record: int) -> None:
        """Starts anew, but remembers which terms the record that is still open has been counted for."""
        kept = [(t, k) for t, k in self.place.items() if self.last[k] == open_record]
        self.__init__()
        for t, _ in kept:
            self.place[t] = len(self.place)
        if len(kept) > len(self.last):
            self.occurrences, self.records, self.last = (np.zeros(len(kept), dtype=np.int64) for _ in range(3))
        self.last[: len(kept)] = open_record


def _count(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, met, last = Counters(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(2)
            new = np.ones(b.num_rows, dtype=bool)  # without a record's name, each row is one
            if key.null_count < len(key):
                same = pc.fill_null(pc.equal(key.slice(1), key.slice(0, len(key) - 1)), False).to_numpy(zero_copy_only=False)
                new[1:] = ~same
                new[0] = last is None or key[0].as_py() != last
                last = key[len(key) - 1].as_py()
            numbers = met + np.cumsum(new)
            met = int(numbers[-1])
            counters.add(b.column(0).cast(pa.string()), b.column(1).to_numpy(zero_copy_only=False), numbers)
            if len(counters) >= most:
                yield counters.states()
                counters.forget(met)
        if len(counters):
            yield counters.states()

    return run


def term_counts(df: DataFrame, text: str, weight: str | None = None, record: str | None = None, most: int = 500_000) -> DataFrame:
    """(term, occurrences, records): the row's weight (1 if none is named) once for each time the term stands in it, and records in which it stands.

    Terms are the pieces between single blanks; an empty text has the empty term. Rows with a null text or weight don't count, repeated rows do. Each row is a record of its own; where a record may span
    rows, ``record`` names its id (null ids are a record each row), and rows are brought together by it and counted in its order. Counters run over a task's whole input, at most about ``most`` terms at once; as no record lies
    in two tasks, their states add up, and the exchange by term carries one state a term and task, so a term of every record weighs no more than others.
    """
    w = F.col(weight) if weight else F.lit(1)
    src = df.select(F.col(text).alias("text"), w.cast("bigint").alias("weight"), (F.col(record).cast("string") if record else F.lit(None).cast("string")).alias("record")).where("text is not null and weight is not null")
    if record:
        src = src.repartition(F.coalesce(F.col("record"), F.xxhash64("text").cast("string"))).sortWithinPartitions("record")
    parts = src.mapInArrow(_count(most), "term string, occurrences bigint, records bigint")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(df: DataFrame, text: str, weight: str, rare: int = 5, common: tuple[int, int] = (1, 50)) -> DataFrame:
    """term_counts by rows with ``mark``: "rare" (at most ``rare`` occurrences), "common" (in at least common[0]/common[1] of the counted rows), "both" or null."""
    rows = df.where(F.col(text).isNotNull() & F.col(weight).isNotNull()).agg(F.count(F.lit(1))).scalar()
    few, many = F.col("occurrences") <= rare, F.col("records") * common[1] >= rows * common[0]
    return term_counts(df, text, weight).withColumn("mark", F.when(few & many, "both").when(few, "rare").when(many, "common"))
