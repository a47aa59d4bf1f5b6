"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Each text is cut into blocks of a fixed number of bytes. The distinct blocks are
sorted and every one gets an integer as its name; then adjacent names are paired,
the distinct pairs are sorted and named in turn, until each document has one name.
Two documents have the same (level, name) exactly if their texts are the same, as
a name stands for one content by construction: no hash decides equality.

Blocks travel once, to be sorted. Documents look their blocks' names up by a 64-bit
address of the block; an address that two different blocks share (which the sorted
blocks show) is looked up by the block's bytes instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, space_normalised, stored

BLOCK_BYTES = 4096


def _named(distinct: DataFrame, by: list[str], name: str, label: str) -> DataFrame:
    """Distinct rows, sorted in each partition, with an integer name; stored, so that names stay as they are."""
    return stored(distinct.sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()), label)


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, address: Column) -> DataFrame:
    """A row for each block: doc, digest (of the whole text), pos, block, address."""
    whole = docs.select(F.col(id_col).alias("doc"), space_normalised(F.col(text_col)).alias("norm"))
    whole = whole.select("doc", F.unhex(F.sha2("norm", 256)).alias("digest"), F.col("norm").cast("binary").alias("bytes"))
    n = F.greatest(F.lit(1), F.ceil(F.length("bytes") / F.lit(block_bytes)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    return whole.select("doc", "digest", F.posexplode(cut).alias("pos", "block")).withColumn("address", address)


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, address_bits: int = 64) -> DataFrame:
    """One row per (id, text) with its identity: doc, digest, copies, level, name.

    copies: how many input rows had this id and this text. Equal texts have equal
    (level, name), different ones never. address_bits: of a block's address; fewer
    only make more addresses shared, which costs time and changes no result.
    """
    address = F.xxhash64("block")
    if address_bits < 64:
        address = F.pmod(address, F.lit(1 << address_bits))
    blocks = _blocks(docs, id_col, text_col, block_bytes, address)

    # Names of the sorted blocks. Partial aggregation thins out common blocks before the shuffle.
    sorted_blocks = blocks.select("address", "block").distinct().sortWithinPartitions("block")
    names = stored(sorted_blocks.select("address", F.monotonically_increasing_id().alias("name")), "block-names")
    by_address = stored(names.groupBy("address").agg(F.min("name").alias("name"), F.count("*").alias("contents")), "addresses")
    shared = stored(by_address.filter("contents > 1").select("address"), "shared-addresses")

    at = blocks.select("doc", "digest", "pos", "address")
    found = at.join(by_address.filter("contents = 1"), "address").select("doc", "digest", "pos", "name")
    if shared.limit(1).count():
        among = blocks.join(shared, "address", "left_semi")
        first = names.agg(F.max("name")).first()[0] + 1
        own = _named(among.select("address", "block").distinct(), ["block"], "name", "shared-names")
        found = found.unionByName(among.join(own, ["address", "block"]).select("doc", "digest", "pos", (F.col("name") + F.lit(first)).alias("name")))

    counted = found.groupBy("doc", "digest", "pos", "name").agg(F.count("*").alias("n"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    now = stored(counted.groupBy("doc", "digest").agg(F.max("n").alias("copies"), listed.alias("names")), "named-0")
    dropped(names)
    dropped(by_address)

    done, level = [], 0
    while True:
        done.append(now.filter(F.size("names") == 1).select("doc", "digest", "copies", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        more = now.filter(F.size("names") > 1)
        if not more.limit(1).count():
            break
        level += 1
        half = F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int"))
        pairs = F.transform(half, lambda i: F.struct(F.get("names", 2 * i).alias("left"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("right")))
        each = more.select("doc", "digest", "copies", F.posexplode(pairs).alias("pos", "pair")).select("doc", "digest", "copies", "pos", "pair.left", "pair.right")
        own = _named(each.select("left", "right").distinct(), ["left", "right"], "name", f"pair-names-{level}")
        now = stored(each.join(own, ["left", "right"]).groupBy("doc", "digest", "copies").agg(listed.alias("names")), f"named-{level}")
        dropped(own)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, address_bits: int = 64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space has become
    one space; null counts as empty. The row with the smallest id stays. Rows with a
    null id take part; they stay only where no row of the group has an id (then one
    of them does). Of rows that repeat id and text, one stays. An empty table gives
    an empty result; other columns are ignored.
    """
    known = block_names(docs, id_col, text_col, block_bytes, address_bits)
    groups = known.groupBy("level", "name").agg(F.min("doc").alias("least"), F.sum("copies").alias("size"))
    groups = stored(groups.filter("size > 1"), "groups")  # a table of its own: AQE can then split a group's rows
    rows = known.join(groups, ["level", "name"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    alone = F.col("size").isNull()
    kept = alone | (F.col("doc").eqNullSafe(F.col("least")) & (F.col("copy") == 1))
    keep_id = F.when(alone, F.col("doc")).otherwise(F.col("least"))
    return rows.select(F.col("doc").alias(id_col), keep_id.alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
