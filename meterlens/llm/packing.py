"""Packing documents into windows of a fixed number of tokens by minimum bin slack.

A document's ids are cut at every full window; only what is left over at its end has
to be packed. There are fewer different lengths than tokens in a window, so how many
pieces have which length is a small table whatever the corpus holds. The plan is made
from that table alone: a window starts with the longest piece left, subset sums of
the remaining lengths (bits of one integer, each length as often as pieces of it are
left) show how close to the capacity the window can be filled, and walking back over
the sums gives the lengths used. The window is repeated while its lengths last.
Pieces find their place by their rank among the pieces of their length: ranks within
a partition plus the sums of the partitions before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored, values
from .tokens import encoder

WINDOW = 1024
END_ID = 0


@dataclass
class Pattern:
    """Windows filled alike: (length, how often) from the longest down, and the number of such windows."""

    lengths: list[tuple[int, int]]
    copies: int


def best_fill(left: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset of lengths, each at most left[length] times, with the largest sum up to capacity."""
    full, reach, steps = 1 << capacity, 1, []
    limit = (full << 1) - 1
    for length in sorted((x for x in left if x <= capacity), reverse=True):
        count, power = min(left[length], capacity // length), 1
        while count and not reach & full:
            take = min(power, count)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            count, power = count - take, power * 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = WINDOW) -> list[Pattern]:
    """Windows for pieces of the given lengths, each piece in one of them."""
    left, made = {k: n for k, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = dict(best_fill({k: n for k, n in left.items() if n}, capacity - longest))
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        copies = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * copies
            if not left[k]:
                del left[k]
        made.append(Pattern(sorted(used.items(), reverse=True), copies))
    return made


def _pieces(name: str, window: int, end_id: int):
    tail = np.array([end_id], np.uint32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks, own = TaskContext.get().partitionId(), [0] * (window + 1), encoder(name)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(values(batch.column(0)), own.encode(values(batch.column(1)))):
                ids = np.concatenate([ids, tail])
                raw = ids.astype("<u4").tobytes()
                for start in range(0, len(ids), window):
                    length = min(window, len(ids) - start)
                    rows.append((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(ids), part, ranks[length]))
                    ranks[length] += 1
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type)] + [pa.array(x, pa.int64()) for x in columns[1:]], names=["doc", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    return cut


def _placed(patterns: list[Pattern], window: int, full: int):
    """Where rank r of a length goes. Tables over the lengths: as many rows as patterns have lengths, not as there are pieces."""
    table: dict[int, list[list[int]]] = {window: [[0], [1], [0], [0]]} if full else {}
    base = full
    taken: dict[int, int] = {}
    for p in patterns:
        offset = 0
        for length, n in p.lengths:
            rows = table.setdefault(length, [[], [], [], []])
            for column, x in zip(rows, (taken.get(length, 0), n, base, offset)):
                column.append(x)
            taken[length] = taken.get(length, 0) + n * p.copies
            offset += n * length
        base += p.copies
    arrays = {k: tuple(np.array(x, np.int64) for x in v) for k, v in table.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "at"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, each, windows, shift = arrays[int(length[own[0]])]
                k = np.searchsorted(first, rank[own], "right") - 1
                copy, slot = np.divmod(rank[own] - first[k], each[k])
                sequence[own], offset[own] = windows[k] + copy, shift[k] + slot * length[own]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return place


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. A null id stays null; repeated rows are
    packed as often as they occur. An empty table has no pieces; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer, window, end_id), fields + ", part long, rank long")
    pieces = stored(pieces, "pieces")  # ranks within partitions hold only as long as the partitions do
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.withColumn("before", F.coalesce(before, F.lit(0))), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    full = histogram.pop(window, 0)
    ranked = pieces.join(counts.drop("n"), ["length", "part"]).select("doc", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("at"))
    out = ranked.mapInArrow(_placed(plan(histogram, window), window, full), fields + ", sequence_id long, offset long")
    return out.withColumnRenamed("doc", id_col)
