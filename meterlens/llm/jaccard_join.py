"""Jaccard self-join of documents on word 5-grams: size-aware, heavy and light sets apart.

All sets are ordered alike: shingles met often across the corpus last, the others by
hash. Two sets that link share an element among the first n - ceil(0.75 n) + 1 of
each, and two elements among one more. A *light* set (small) enumerates the pairs of
elements of the latter, a *heavy* one scans the inverted lists of the former; light
sets large enough to link with heavy ones stand in both. The boundary is the size up
to which enumerating pairs costs less than scanning lists of the corpus's mean length.

Within a list not all pairs are made. In a few rounds each list compares its members
with one pivot only, and what links becomes one component; only members of different
components are then compared pair by pair. Every comparison is on the whole texts'
shingle sets, and no pair of a list is left out unless its members are linked already.

Sets of the same shingles form a class from the start, with one document for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, counted, dropped, held, kept, released, stored, unused, values
from .components import components

SHINGLE = 5
PERCENT = 75
#: Shingles that are ordered last: as many at most; which ones decides on speed alone.
COMMON = 1_500_000
#: Shingles counted at a time, and how often one must occur among them to be reported.
COUNT_CHUNK, COUNT_LEAST = 4_000_000, 2
#: Rounds with pivots, at most; another one follows only while one comparison in WORTH of the last one linked.
STAR_ROUNDS, WORTH = 6, 20
#: Pivots of a list in a round.
PIVOTS = 8
#: Of the elements a class is listed under, so many are known where its pairs are looked for.
KNOWN = 64
#: As many where pairs that have been found are looked at again, before their texts are.
KNOWN_OF_PAIR = 256
#: What comparing two sets costs, in entries emitted.
COMPARE = 2


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: A word's hash: the sum over its bytes of random numbers, drawn for byte and place in the word. Longer words are hashed whole.
_PLACES = 64
_RANDOM = np.frombuffer(np.random.Generator(np.random.PCG64(5)).bytes(_PLACES * 256 * 8), np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit hashes of each text's words, A-Z as a-z; for many texts at once."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[data]
    where = np.flatnonzero(~space)
    if not len(where):
        return [np.zeros(0, np.uint64)] * len(texts)
    first = np.flatnonzero(np.diff(where, prepend=-2) != 1)  # of each word, among its bytes in `where`
    size = np.diff(first, append=len(where))
    place = np.arange(len(where)) - np.repeat(first, size)
    low = _LOWER[data[where]]
    hashes = _mix(np.add.reduceat(_RANDOM[((place & (_PLACES - 1)) << 8) + low], first) + size.astype(np.uint64))
    for i in np.flatnonzero(size > _PLACES):
        hashes[i] = xxhash.xxh3_64_intdigest(low[first[i] : first[i] + size[i]].tobytes())
    return np.split(hashes, np.searchsorted(where[first], ends)[:-1])


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted 64-bit hashes of its distinct shingles; with fewer words than a shingle has, of all its words."""
    out = []
    for h in word_hashes(texts):
        if len(h) < size:
            out.append(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(h))] if len(h) else [], np.uint64))
            continue
        total = h[: len(h) - size + 1] * _ODD[0]
        for i in range(1, size):
            total = total + h[i : len(h) - size + 1 + i] * (_ODD[i % len(_ODD)] * np.uint64(2 * (i // len(_ODD)) + 1))
        total = _mix(total)
        total.sort()
        keep = np.empty(len(total), bool)
        keep[0] = True
        np.not_equal(total[1:], total[:-1], out=keep[1:])
        out.append(total[keep])
    return out


def _groups(column, chars: int = 1_000_000) -> Iterator[list]:
    """A column's texts, some at a time."""
    held, n = [], 0
    for text in values(column):
        held.append(text)
        n += len(text or "")
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


class Common:
    """Shingles ordered last and their order; a table of their first bits spares most searches."""

    BITS = 24

    def __init__(self, hashes: np.ndarray, rank: np.ndarray) -> None:
        """hashes: sorted."""
        self.hashes, self.rank = hashes, rank
        self.near = np.zeros(1 << self.BITS, bool)
        self.near[hashes >> np.uint64(64 - self.BITS)] = True

    def ranks(self, found: np.ndarray) -> np.ndarray:
        """The order of each shingle among those; -1: not one of them."""
        out = np.full(len(found), -1, np.int32)
        maybe = np.flatnonzero(self.near[found >> np.uint64(64 - self.BITS)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, found[maybe]), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == found[maybe], self.rank[at], -1)
        return out


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix(ordered_n: int, percent: int, shared: int = 1) -> int:
    """Of a set of n, so many first elements hold `shared` elements of any set it links with."""
    return min(ordered_n, ordered_n - _least_overlap(ordered_n, percent) + shared)


def boundary(mean_list: float, percent: int, most: int = 4096) -> int:
    """The largest size at which pairs of first elements are fewer than the entries that scanning lists would read."""
    best = 0
    for n in range(1, most + 1):
        p = prefix(n, percent, 2)
        if p * (p - 1) / 2 <= COMPARE * prefix(n, percent) * mean_list:
            best = n
        elif best and n > best + 8:
            break
    return best


def signatures(found: np.ndarray, common: Common, light: int, percent: int) -> np.ndarray:
    """What a set is listed under."""
    n = len(found)
    if n < 3:  # links with its like only
        return np.zeros(0, np.uint64)
    rank = common.ranks(found)
    need = prefix(n, percent, 2)
    first = found[rank < 0][:need]
    if len(first) < need:
        late = rank >= 0
        first = np.concatenate([first, found[late][np.argsort(rank[late])][: need - len(first)]])
    out = []
    if n <= light:
        i, j = np.triu_indices(len(first), 1)
        out.append(_mix(first[i] * _ODD[1] + first[j] * _ODD[2] + np.uint64(1)))
    if 100 * n > percent * light:
        out.append(first[: prefix(n, percent)])
    return np.concatenate(out)


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        held, many, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            often = counts >= COUNT_LEAST
            sig, n = np.append(hashes[often].view(np.int64), 0), np.append(counts[often], many)
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(n.astype(np.int64)), pa.array(np.append(np.zeros(len(sig) - 1, bool), True))], names=["sig", "n", "all"])

        for batch in batches:
            for found in (x for texts in _groups(batch.column(0)) for x in shingle_sets(texts, size)):
                digest = xxhash.xxh3_128_digest(found.tobytes())
                if digest in seen:
                    continue
                seen.add(digest)
                held.append(found)
                many += len(found)
                if many >= COUNT_CHUNK:
                    yield flush()
                    held, many = [], 0
                    seen.clear()
        yield flush()

    return run


def _sets(size: int, percent: int, light: int, often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        common = Common(*often.value)
        seen: set[bytes] = set()
        for batch in batches:
            ns, digests, sigs, ends = [], [], [], [0]
            for found in (x for texts in _groups(batch.column(2)) for x in shingle_sets(texts, size)):
                digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                own = np.zeros(0, np.uint64) if digest in seen else signatures(found, common, light, percent)
                seen.add(digest)
                ns.append(len(found))
                digests.append(digest)
                sigs.append(own)
                ends.append(ends[-1] + len(own))
            flat = np.concatenate(sigs or [np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), lists], names=["doc", "mark", "n", "digest", "sigs"])

    return run


def _links(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        last, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            rows = zip(values(batch.column(0)), values(batch.column(2)), (x for texts in _groups(batch.column(3)) for x in shingle_sets(texts, size)))
            for i, (a, left, other) in enumerate(rows):
                if a != last:
                    last, known = a, shingle_sets([left], size)[0]
                both = len(np.intersect1d(known, other, assume_unique=True))
                if 100 * both >= percent * (len(known) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


def _close(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Of two sets of n and m that link: how many of the elements that both are listed under they share at least.

    With an overlap of t, the first n - t + k and m - t + k share k of any k; this is
    the largest k for which both are within what is listed (see prefix()).
    """
    return F.ceil(percent * (n + m) / (100 + percent)) - F.ceil(percent * F.greatest(n, m) / 100) + 1


def _known(entries: DataFrame, most: int) -> DataFrame:
    """entries (sig, class, n, weight) -> class, n, lists (their sigs), elements (names of the elements they stand for), rest.

    Of each class the first lists are known, ``most`` elements at most; rest: how many elements are not.
    """
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["weight"])
    listed = entries.groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("sig", "weight"))).alias("all"))
    listed = listed.select("class", "n", total(F.col("all")).alias("total"), F.slice("all", 1, most).alias("all"))
    listed = listed.withColumn("upto", F.aggregate("all", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["weight"]))))
    listed = listed.withColumn("k", F.array_size(F.filter("upto", lambda x: x <= most)) - 1)
    named = F.flatten(F.transform(F.slice("all", 1, F.col("k")), lambda x: F.transform(F.sequence(F.lit(1).cast("long"), x["weight"]), lambda i: F.xxhash64(x["sig"], i))))
    return listed.select("class", "n", F.transform(F.slice("all", 1, F.col("k")), lambda x: x["sig"]).alias("lists"), named.alias("elements"), (F.col("total") - F.get("upto", F.col("k"))).alias("rest"))


def _enough(a: str, b: str, light: int, percent: int) -> Column:
    """Whether the elements that are known to be shared, with all that are not known, are as many as a pair needs (see _needed()). a, b: the columns' ends."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    return (F.least(n, m) <= light) | (F.size(F.array_intersect(f"elements{a}", f"elements{b}")) + F.col(f"rest{a}") + F.col(f"rest{b}") >= _needed(n, m, percent))


def _promising(pairs: DataFrame, known: DataFrame, light: int, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by what is known of their lists; far fewer texts are compared."""
    end = lambda x: known.select(F.col("class").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "elements", "rest")))
    return pairs.join(end("a"), "a").join(end("b"), "b").filter(_enough("_a", "_b", light, percent)).select("a", "b")


def _undecided(entries: DataFrame, light: int, percent: int) -> DataFrame:
    """entries (sig, class, n, weight, label) -> a, b: pairs of classes with different labels that may link, about once each.

    A row carries the first lists of its class, KNOWN elements at most. A pair comes of
    the first list that both stand in, and only if it has _enough(). Lists that are not
    known make a pair come again or be compared in vain; none is left out.
    """
    rows = entries.drop("weight").join(_known(entries, KNOWN).drop("n"), "class").withColumn("before", F.filter("lists", lambda x: x < F.col("sig"))).drop("lists")
    one = rows.select("sig", *(F.col(x).alias(f"{x}_a") for x in ("class", "n", "label", "elements", "rest", "before")))
    near = (F.col("class_a") < F.col("class")) & (F.col("label") != F.col("label_a")) & _close(F.col("n"), F.col("n_a"), percent)
    met = rows.join(one, "sig").filter(near & ~F.arrays_overlap("before", "before_a") & _enough("", "_a", light, percent))
    return met.select(F.col("class_a").alias("a"), F.col("class").alias("b"))


def _common_shared(often: DataFrame):
    """Broadcast of the hashes (sorted) and ranks of shingles (sig, n), COMMON at most, 12 bytes each; the sum of their squared counts. The driver keeps no copy."""
    found = often.toArrow()
    hashes, n = found["sig"].to_numpy().view(np.uint64), found["n"].to_numpy().astype(np.float64)
    by_hash = np.argsort(hashes)
    rank = np.empty(len(hashes), np.int32)
    rank[np.lexsort((hashes, n))] = np.arange(len(hashes), dtype=np.int32)
    shared = often.sparkSession.sparkContext.broadcast((hashes[by_hash], rank[by_hash]))
    squared = float((n * n).sum())
    del found, hashes, n, by_hash, rank
    pa.default_memory_pool().release_unused()
    return shared, squared


def _labelled(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """One row per document: doc, mark (xxhash64 of its text), n, component (a number of its own)."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))

    seen = held(own.select("text").mapInArrow(_count(size), "sig long, n long, all boolean"))
    total = seen.filter("all").agg(F.sum("n")).first()[0] or 0
    counts = seen.filter("not all").groupBy("sig").agg(F.sum("n").alias("n"))
    counts = held(counts)
    # The least count that no more than COMMON shingles reach: found from how many have which count, without sorting them.
    by_count = sorted(((r["n"], r["many"]) for r in counts.groupBy("n").agg(F.count("*").alias("many")).collect()), reverse=True)
    reached = np.cumsum([many for _, many in by_count] or [0])
    fits = int((reached <= COMMON).sum()) if by_count else 0
    shared, squared = _common_shared(counts.filter(F.col("n") >= (by_count[fits - 1][0] if fits else 1 << 62)))
    squares = counts.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    light = boundary(1 + max(0.0, squares - squared) / max(total, 1), percent)  # of lists of shingles that are not ordered last
    dropped(counts)
    dropped(seen)

    sets = own.mapInArrow(_sets(size, percent, light, shared), f"doc {kind}, mark long, n long, digest binary, sigs array<long>")
    sets = stored(sets.withColumn("row", F.monotonically_increasing_id()), "sets")
    shared.destroy()  # sets is a table now
    copies = sets.filter("n > 0").groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    copies = held(copies.filter("rows > 1").drop("rows"))
    classes = sets.select("row", "doc", "mark", "n", "digest").join(copies, "digest", "left")
    classes = stored(classes.select("row", "doc", "mark", "n", F.coalesce("first", "row").alias("class")), "classes")
    dropped(copies)

    # Inverted lists with two entries or more.
    entries = sets.select("row", F.explode("sigs").alias("sig"))
    beside = Window.partitionBy("sig").orderBy("row")
    lists = entries.select("sig", "row", F.lag("row").over(beside).alias("before"), F.lead("row").over(beside).alias("after"))
    lists = lists.filter("before is not null or after is not null").join(classes.select("row", "class", "n"), "row")
    lists = held(lists.select("sig", "class", "n").distinct())
    released(spark)
    # Lists with the same members (all shingles of a passage, say) become one, with their number as its weight.
    member = lambda seed: F.bit_xor(F.xxhash64("class", F.lit(seed)))
    alike = lists.groupBy("sig").agg(member(1).alias("x"), member(2).alias("y"), F.count("*").alias("k")).filter("k > 1")
    same = Window.partitionBy("x", "y", "k")
    alike = held(alike.select("sig", F.min("sig").over(same).alias("list"), F.count("*").over(same).alias("weight")))
    each = lists
    lists = each.join(alike, "sig").groupBy(F.col("list").alias("sig"), "class", "n").agg(F.first("weight").alias("weight"))
    lists = stored(lists, "merged-lists")
    for df in (each, alike, sets):
        dropped(df)
    released(spark)

    # The text of one document of each class that stands in a list.
    listed = lists.select("class").distinct().join(classes.filter("row = class"), "class").select("class", F.col("doc").alias("of"), F.col("mark").alias("marked"))
    texts = own.join(listed, own["doc"].eqNullSafe(listed["of"]) & (own["mark"] == listed["marked"]))
    texts = texts.select("class", "text")
    if classes.groupBy("doc", "mark").agg(F.count("*").alias("rows")).filter("rows > 1").limit(1).count():
        texts = texts.dropDuplicates(["class"])  # rows that repeat id and text
    texts = stored(texts, "texts")
    known_lists = held(_known(lists, KNOWN_OF_PAIR).drop("lists"))
    released(spark)

    def verified(pairs: DataFrame) -> tuple[DataFrame, int]:
        right = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("right")), "b")
        whole = right.join(texts.select(F.col("class").alias("a"), F.col("text").alias("left")), "a").select("a", "b", "left", "right")
        return counted(whole.mapInArrow(_links(size, percent), "a long, b long"))

    stars, labels, turn, last = None, None, 0, False
    while True:
        now = lists if labels is None else lists.join(labels, lists["class"] == labels["node"], "left")
        known = (F.col("class"), F.lit(1)) if labels is None else (F.coalesce("component", "class"), F.coalesce("members", F.lit(1)))
        now = now.select("sig", "class", "n", "weight", known[0].alias("label"), known[1].alias("members"))
        if last:
            heads = now.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("sig")
            open_lists = held(now.join(heads, "sig", "left_semi").select("sig", "class", "n", "weight", "label"))
            pairs, done = _undecided(open_lists, light, percent), [open_lists]
        else:
            # The pivots are of the largest component in the list, others each round.
            pivot = lambda k: F.min(F.struct(-F.col("members"), F.xxhash64("class", F.lit(turn * PIVOTS + k)).alias("mixed"), "class", "n", "label"))
            heads = now.groupBy("sig").agg(F.array(*(pivot(k) for k in range(PIVOTS))).alias("pivots"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
            heads = heads.select("sig", F.explode(F.array_distinct("pivots")).alias("pivot"))
            heads = heads.select("sig", F.col("pivot.class").alias("a"), F.col("pivot.n").alias("an"), F.col("pivot.label").alias("alabel")).distinct()
            different = (F.col("label") != F.col("alabel")) & _close(F.col("n"), F.col("an"), percent)
            pairs, done = now.join(heads, "sig").filter(different).select("a", F.col("class").alias("b")), []
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs, compared = counted(_promising(pairs, known_lists, light, percent))
        released(spark)
        found, linked = verified(pairs)
        released(spark)
        if linked:
            # What was linked before is one star for each component.
            every = found if stars is None else found.unionByName(stars.select(F.col("node").alias("a"), F.col("component").alias("b")))
            new_stars = stored(components(every), "components")
            new_labels = stored(new_stars.join(new_stars.groupBy("component").agg(F.count("*").alias("members")), "component"), "labels")
            for df in (stars, labels):
                if df is not None:
                    dropped(df)
            stars, labels = new_stars, new_labels
            released(spark)
        for df in [*done, pairs, found]:
            dropped(df)
        if last:
            break
        turn += 1
        last = turn == STAR_ROUNDS or linked * WORTH < compared
    for df in (lists, texts, known_lists):
        dropped(df)
    if labels is None:
        return classes.select("doc", "mark", "n", F.col("class").alias("component"))
    return classes.join(labels, classes["class"] == labels["node"], "left").select("doc", "mark", "n", F.coalesce("component", "class").alias("component"))


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id it reaches by links).

    Null, empty and wordless texts have no shingles and link with nothing, not even
    with each other. A null id takes part in links and never is a component's id
    unless all its ids are null. Repeated rows have equal sets and so link. An empty
    table gives an empty result; other columns are ignored.
    """
    joined = _labelled(docs, id_col, text_col, size, percent)
    least = held(joined.groupBy("component").agg(F.min("doc").alias("least"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"))
    return joined.join(least, "component", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps one: that with the smallest id (null last).

    Of several texts with that id the one with the smallest hash stays, of several rows
    with that id and text one. Documents without shingles all stay; an empty table
    stays empty.
    """
    joined = held(_labelled(docs, id_col, text_col, size, percent).filter("n > 0"))
    place = F.struct(F.isnull("doc").alias("none"), "doc", "mark")
    groups = held(joined.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"))
    members = joined.join(groups, "component")
    is_first = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("mark") == F.col("first.mark"))
    of, mark, row = (unused(docs, x) for x in ("__of", "__mark", "__row"))
    gone = held(members.filter(~is_first).select("doc", "mark").distinct().toDF(of, mark))
    same = lambda df, other: df[id_col].eqNullSafe(other[of]) & (F.xxhash64(df[text_col]) == other[mark])
    stay = docs.join(gone, same(docs, gone), "left_anti")
    twice, many = counted(members.filter(is_first).groupBy("doc", "mark").agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows").toDF(of, mark))
    if not many:
        return stay
    columns = [F.col(c) for c in docs.columns]
    once = stay.join(twice, same(stay, twice), "left_semi").groupBy(F.col(id_col).alias(of), F.xxhash64(text_col).alias(mark))
    once = once.agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(row)).select(f"{row}.*")
    return stay.join(twice, same(stay, twice), "left_anti").unionByName(once)
