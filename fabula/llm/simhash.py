"""SimHash near-duplicates through a segment-popcount grid.

A fingerprint of 64 bits is cut into 32 segments of 2 bits and mapped to the vector of its
segments' bit counts. The Manhattan distance of two such vectors is a lower bound of the Hamming
distance, so fingerprints within 2 bits lie within 2 steps on the grid, and then some grid point is
at most one step from both. Every distinct fingerprint is sent to its own point and to those one step away
(49 on average); a fingerprint that shares no point with another one has no link and leaves.

The rest is verified exactly without forming pairs: two fingerprints differ in 2 bits or fewer if
and only if some 64-bit value is within one bit of both. Each remaining fingerprint is sent to these
65 values; all that meet at one are linked to the smallest there, and at most 65 distinct
fingerprints can meet, so no group grows with the data and no link is lost.

Defined results: a null or blank text has fingerprint zero and is linked like any other; rows that repeat
a doc_id keep a row each; a null doc_id keeps its row, and names its component only if no other id
is in it (then null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

SHINGLE = 3
SEED = 42
SEGMENTS, WIDTH = 32, 2


def text_fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of a UTF-8 text over word shingles, repeats counted."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: lowers A-Z only, splits at ASCII white space
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = pa.array((text_fingerprint(t.as_py() or b"") for t in texts), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every whole text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """Bit counts (0 to 2) of the 32 segments, each in its own 2 bits of a long."""
    odd = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def grid_points(counts: Column) -> Column:
    """The point itself and the points one step away; null where a step leaves the grid."""
    near = [counts]
    for i in range(SEGMENTS):
        n = F.shiftrightunsigned(counts, WIDTH * i).bitwiseAND(F.lit(3))
        low, both = (F.shiftleft(F.lit(x).cast("long"), WIDTH * i) for x in (1, 3))
        near += [F.when(n < 2, counts.bitwiseXOR(low)), F.when(n > 0, counts.bitwiseXOR(both))]  # 0 and 1 change places; 1 and 2
    return F.array(*near)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints fp that differ in 2 bits or fewer: enough links to connect all of them."""
    cells = prints.select("fp", segment_counts(F.col("fp")).alias("e")).select("fp", F.explode(grid_points(F.col("e"))).alias("cell")).where("cell is not null")
    shared = cells.groupBy("cell").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("cell")
    left = cells.join(shared, "cell").select("fp").distinct()
    centres = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)])
    balls = left.select("fp", F.explode(centres).alias("centre")).groupBy("centre").agg(F.sort_array(F.collect_set("fp")).alias("met")).where("size(met) > 1")
    return balls.select(F.col("met")[0].alias("a"), F.explode(F.slice("met", 2, 64)).alias("b")).distinct()


def components(rows: DataFrame) -> DataFrame:
    """rows without text, and component: a fingerprint that names each row's near-duplicate group."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            prints = pa.array((text_fingerprint(t.as_py() or b"") for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), prints], [*names, "fp"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    prints = materialize(rows.mapInArrow(run, f"{kinds}, fp long"), "simhash")
    parts = connected_components(links(prints.select("fp").distinct()))
    return prints.join(parts, prints.fp == parts.node, "left").select(*names, F.coalesce("root", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable over links)."""
    prints = materialize(fingerprints(docs), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    parts = connected_components(links(distinct.select("fp")))
    rooted = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
