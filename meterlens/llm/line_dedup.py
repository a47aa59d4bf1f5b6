"""Repeated multi-line passages across documents, by content-defined chunks of lines.

A hash rolls over the hashes of a document's lines, two at a time, and a chunk ends where
it is divisible by DIVISOR: boundaries follow from the lines around them alone, so that
lines put in elsewhere, or other documents, move none of them. Chunks that occur again
are grouped by their bytes; all but the first occurrence (smallest id, then position) are
copies. A passage that stands in other surroundings begins and ends inside chunks: its
edges are found by the rolled windows themselves, as chunks of two lines, which are left
out only inside a chunk that is known from an earlier place. Very long lines are chunks too.

Copies that follow each other line by line are one run, and the lines of a run go where it
has enough words; a very long line goes by itself. A line that goes always stays in an
earlier place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, held, kept, released, stored, unused, values, word_count

MIN_WORDS = 10
LONG_LINE = 50
#: One boundary in so many lines, in the mean.
DIVISOR = 4


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _pieces(docs: DataFrame) -> DataFrame:
    """doc, mark, pos (first line), many (lines), piece (hash): windows of two lines, chunks of three and more, long lines."""
    whole = docs.filter("text is not null").select("doc", "mark", _lines(F.col("text")).alias("lines"))
    whole = whole.select("doc", "mark", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"))
    n, none = F.size("h"), F.array().cast("array<struct<pos:int,many:int,piece:bigint>>")
    row = lambda pos, many, piece: F.struct(pos.alias("pos"), many.cast("int").alias("many"), piece.alias("piece"))
    is_long = lambda i: (F.length(F.get("lines", i)) >= 2 * LONG_LINE - 1) & (word_count(F.get("lines", i)) >= LONG_LINE)
    long = F.transform(F.filter(F.sequence(F.lit(0), n - 1), is_long), lambda i: row(i, F.lit(1), F.xxhash64(F.get("h", i), F.lit("line"))))
    rolled = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: row(i, F.lit(2), F.xxhash64(F.get("h", i), F.get("h", i + 1)))))
    whole = whole.select("doc", "mark", "h", long.alias("long"), F.coalesce(rolled, none).alias("rolled"))
    ends = F.transform(F.filter("rolled", lambda x: F.pmod(x["piece"], F.lit(DIVISOR)) == 0), lambda x: x["pos"] + 1)
    whole = whole.select("doc", "mark", "h", "long", "rolled", F.concat(F.array(F.lit(0)), ends, F.array(n)).alias("cuts"))
    between = F.transform("cuts", lambda a, k: F.struct(a.alias("pos"), (F.get("cuts", k + 1) - a).alias("many")))
    chunks = F.transform(F.filter(between, lambda x: x["many"] > 2), lambda x: row(x["pos"], x["many"], F.xxhash64(F.slice("h", x["pos"] + 1, x["many"]))))
    return whole.select("doc", "mark", F.explode(F.concat("rolled", chunks, "long")).alias("x")).select("doc", "mark", "x.pos", "x.many", "x.piece")


def _runs(met: Iterable[tuple[int, int]], words: Callable[[int], int], min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the lines in runs of copies (pos, many) that overlap, with min_words words at least, and of the long lines, apart and in order."""
    met = set(met)
    runs: list[list[int]] = []
    for p, many in sorted(x for x in met if x[1] > 1):
        if runs and p < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], p + many)
        else:
            runs.append([p, p + many])
    spans = [(a, b) for a, b in runs if sum(map(words, range(a, b))) >= min_words] + [(p, p + 1) for p, many in met if many == 1]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _words(line: str) -> int:
    return len(line.encode("utf-8", "surrogatepass").split())


def shown(met: Iterable[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """(pos, many) of the repeated pieces whose bytes have to be compared: all but the windows inside a chunk that has an earlier place."""
    met = sorted(met)
    known, end = [], 0
    later = [(p, p + many) for p, many, first in met if many > 2 and not first]  # chunks do not overlap
    at = 0
    for p, many, _ in met:
        while at < len(later) and later[at][1] <= p:
            at += 1
        if many != 2 or at == len(later) or not (later[at][0] <= p and p + 2 <= later[at][1]):
            known.append((p, many))
    return known


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces that are met again, with their bytes and the words of each line; those of short runs too, which may be the first of others."""
    kept()
    for batch in batches:
        at, places, many_of, words, sums, texts = [], [], [], [], [], []
        for k, (text, met) in enumerate(zip(values(batch.column(2)), values(batch.column(3)))):
            lines = text.split("\n")
            n: dict[int, int] = {}
            for pos, many in shown((x["pos"], x["many"], x["first"]) for x in met):
                own = lines[pos : pos + many]
                for i in range(pos, pos + many):
                    if i not in n:
                        n[i] = _words(lines[i])
                at.append(k)
                places.append(pos)
                many_of.append(many)
                words.append([n[i] for i in range(pos, pos + many)])
                texts.append(piece := "\n".join(own))
                sums.append(xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass")) - (1 << 63))
        rows = pa.array(at, pa.int64())
        columns = [pa.array(places, pa.int32()), pa.array(many_of, pa.int32()), pa.array(words, pa.list_(pa.int32())), pa.array(sums, pa.int64()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *columns], names=["doc", "mark", "pos", "many", "words", "sum", "chunk"])


def _joined(min_words: int):
    """The lines that go, from the copies in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for copies in values(batch.column(2)):
                words = {x["pos"] + j: n for x in copies for j, n in enumerate(x["words"])}
                found.append([{"start": a, "end": b} for a, b in _runs(((x["pos"], len(x["words"])) for x in copies), words.__getitem__, min_words)])
            out = pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=["doc", "mark", "spans"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document that loses lines: doc, mark (xxhash64 of its text), spans (start, end: lines that go; apart, in order)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    place = F.struct(F.isnull("doc").alias("none"), "doc", "mark", F.col("pos").alias("start"))
    pieces = held(_pieces(own))
    often = held(pieces.filter("many <= 2").groupBy("piece").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    chunked = pieces.filter("many > 2")
    chunk_often = chunked.groupBy("piece").agg(F.count("*").alias("n"), F.min(place).alias("at")).filter("n > 1").select(F.col("piece").alias("of"), "at")
    chunk_often = held(chunk_often)
    is_first = F.col("doc").eqNullSafe(F.col("at.doc")) & (F.col("mark") == F.col("at.mark")) & (F.col("pos") == F.col("at.start"))
    chunk_met = chunked.join(chunk_often, F.col("piece") == F.col("of")).select("doc", "mark", "pos", "many", is_first.alias("first"))
    met = pieces.filter("many <= 2").join(often, "piece").select("doc", "mark", "pos", "many", F.lit(True).alias("first")).unionByName(chunk_met)
    met = held(met.groupBy("doc", "mark").agg(F.collect_set(F.struct("pos", "many", "first")).alias("met")))
    for done in (pieces, often, chunk_often):
        dropped(done)
    released(docs.sparkSession)
    with_text = own.filter("text is not null").join(met.select(F.col("doc").alias("of"), F.col("mark").alias("marked"), "met").hint("merge"), F.col("doc").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("marked")))
    chunks = with_text.select("doc", "mark", "text", "met").mapInArrow(_cut, f"doc {kind}, mark long, pos int, many int, words array<int>, sum long, chunk string")
    chunks = stored(chunks, "chunks")
    dropped(met)
    released(docs.sparkSession)
    groups = chunks.groupBy("sum", "chunk").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    groups = stored(groups.filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last"), "chunk-groups")  # rows that repeat id and text are one document
    again = chunks.join(groups, ["sum", "chunk"])
    stays = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("mark") == F.col("first.mark")) & (F.col("pos") == F.col("first.start"))
    copies = again.filter(~stays).groupBy("doc", "mark").agg(F.collect_set(F.struct("pos", "words")).alias("copies"))
    spans = copies.mapInArrow(_joined(min_words), f"doc {kind}, mark long, spans array<struct<start:int,end:int>>")
    spans = stored(spans.filter("size(spans) > 0"), "spans")
    dropped(chunks)
    dropped(groups)
    released(docs.sparkSession)
    return spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, Column, Column]:
    """docs with two more columns, and those: the number of lines that go, and the text without them.

    Null texts stay null; empty ones have nothing to lose. Rows that repeat id and
    text are one document, so they lose nothing to each other. Null ids take part and
    come last where the first occurrence is chosen. An empty table stays empty. The
    new columns get names that docs does not have.
    """
    of, mark, spans, removed, clean = (unused(docs, x) for x in ("__of", "__mark", "__spans", "__removed", "__clean"))
    found = repeated_spans(docs, id_col, text_col, min_words).toDF(of, mark, spans)
    same = docs[id_col].eqNullSafe(found[of]) & (F.xxhash64(docs[text_col]) == found[mark])
    rows = docs.join(found.hint("merge"), same, "left")  # spans grow with docs: no broadcast at any size
    lines = _lines(docs[text_col])
    start = lambda k: F.coalesce(F.get(spans, k - 1)["end"], F.lit(0))  # noqa: E731  of the k-th stretch that stays
    end = lambda k: F.coalesce(F.get(spans, k)["start"], F.size(lines))
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: F.slice(lines, start(k) + 1, end(k) - start(k))))
    lost = F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"])
    text = F.when(F.col(spans).isNull(), docs[text_col]).otherwise(F.array_join(left, "\n"))
    rows = rows.select(*[docs[c] for c in docs.columns], F.coalesce(lost, F.lit(0)).cast("long").alias(removed), text.alias(clean))
    return rows, F.col(removed), F.col(clean)


def line_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: id, n_lines, n_removed, n_words_left, text_sha256 (of what is left; null: empty). Nulls, empties and repeats as in without_repeats()."""
    rows, removed, clean = without_repeats(docs.select(id_col, text_col), id_col, text_col, min_words)
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_lines(F.col(text_col)))).cast("long")
    return rows.select(id_col, n.alias("n_lines"), removed.alias("n_removed"), word_count(clean).alias("n_words_left"), F.sha2(F.coalesce(clean, F.lit("")), 256).alias("text_sha256"))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs without repeated passages; those that lose lines and have no word left go.

    length_col, where docs has it, is set to the new length in characters. Null and
    empty texts stay as they are; nulls, repeats and empty tables as in without_repeats().
    """
    rows, removed, clean = without_repeats(docs, id_col, text_col)
    rows = rows.filter((removed == 0) | (word_count(clean) > 0))
    columns = {text_col: clean}
    if length_col in docs.columns:
        columns[length_col] = F.when(removed > 0, F.length(clean).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return rows.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])
