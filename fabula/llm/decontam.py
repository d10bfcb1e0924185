"""Benchmark decontamination by winnowing.

From each run of consecutive k-grams, that of a window of words, the smallest hash is kept (the rightmost of equal ones), on both sides by the same rule, so any
window that document and benchmark share keeps the same k-gram at the same place on both sides: k + run - 1 = window. Kept hashes
meet in a join; a document gram that meets is extended to the windows whose smallest hash it is, and each of these is compared, on the words themselves,
with the benchmark's different windows. Benchmark items shorter than a window are one window of their own length; for those lengths every gram is
kept (a run of one).

Items come last: a document window meets at most one row, the window itself, however many items hold it. Windows that the same items hold are of one class, and the item lists
are made once for each different set of classes that a document meets. So a line that all items and a third of the documents hold costs a row for each of
the documents' windows, not one for each item, too. The list of a document's items is a row of the result; it is as long as its items are many.

Only a bitmap of fixed size, of the hashes kept from the benchmark, goes to all tasks: it drops most document grams
before the join while the benchmark keeps far fewer hashes than it has bits; at millions of kept hashes it fills up and lets ever more through. Results don't
depend on it: what it lets through wrongly the join drops. Texts of any length count whole. Document
grams pass the shuffle only after it. A passage that a third of the documents hold makes one hot join key: its rows
are on the document side, which Spark splits, and are never paired with each other.

Defined results: null or wordless texts have no words and no hits; an item without words matches nothing; repeated rows each
get their row, and repeated item rows count once; a null item_id counts as no item but its windows still hit;
an empty documents table gives an empty result, an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WINDOW, GRAM = 10, 4
BITMAP_BITS = 22
#: A kept gram: length of its windows, its hash, the place of the first window whose smallest it is, and the words of all such windows.
_FOUND = "array<struct<need:int,hash:bigint,first:int,words:array<string>>>"
_ARROW = pa.list_(pa.struct([("need", pa.int32()), ("hash", pa.int64()), ("first", pa.int32()), ("words", pa.list_(pa.string()))]))
#: Keeps 0-9, a-z and all bytes of non-ASCII letters, lowers A-Z, makes the rest blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def kept_grams(words: list[bytes], need: int):
    """(hashes, first windows, last windows): the k-grams that winnowing keeps, each with the windows of `need` words whose smallest it is."""
    import numpy as np
    import xxhash

    gram = min(GRAM, need) if need == WINDOW else need
    n = len(words) - gram + 1
    if len(words) < need:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = np.full(n, need, np.uint64)
    for i in range(gram):
        h = (h ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    run = need - gram + 1
    if run == 1:
        return h, np.arange(n), np.arange(n)
    at = np.arange(n - run + 1) + run - 1 - np.argmin(np.lib.stride_tricks.sliding_window_view(h, run)[:, ::-1], axis=1)  # never falls
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return h[at[first]], first, np.append(first[1:], len(at)) - 1


def _gram_batches(needs: list[int] | None, bitmap: bytes | None) -> Callable:
    """Key columns, n_words and the grams kept. needs: the window lengths; None: the text's own (a benchmark item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bits = np.frombuffer(bitmap, np.uint8) if bitmap else None
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(2).cast(pa.binary()):
                words, out = words_of(text.as_py() or b""), []
                for need in needs if needs is not None else [min(WINDOW, len(words))] * bool(words):
                    h, first, last = kept_grams(words, need)
                    if bits is not None:
                        slot = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                        hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                        h, first, last = h[hit], first[hit], last[hit]
                    out += [{"need": need, "hash": x, "first": i, "words": [w.decode() for w in words[i : j + need]]} for x, i, j in zip(h.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True)]
                sizes.append(len(words))
                found.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, _ARROW)], ["id", "rid", "n_words", "found"])

    return run


def row_id(doc_id, text):
    """Names a row by id and text."""
    return F.xxhash64(doc_id.cast("long"), text)


def _grams(rows: DataFrame, key: str, needs: list[int] | None, bitmap: bytes | None) -> DataFrame:
    rows = rows.select(F.col(key).cast("long").alias("id"), row_id(F.col(key), F.col("text")).alias("rid"), "text")
    return rows.mapInArrow(_gram_batches(needs, bitmap), f"id long, rid long, n_words long, found {_FOUND}")


def _bitmap(grams: DataFrame) -> bytes:
    """2 ** BITMAP_BITS bits, at most 2 ** (BITMAP_BITS - 5) rows to the driver, however large the benchmark is."""
    import numpy as np

    slot = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    rows = grams.groupBy(F.shiftright(slot, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).collect()
    out = np.zeros(1 << (BITMAP_BITS - 5), "<u4")
    for r in rows:
        out[r["at"]] = r["bits"]
    return out.tobytes()


def _windows(df: DataFrame, *columns: str) -> DataFrame:
    """Columns, need, first and window (its words with blanks between them): a row for each window whose smallest gram a row's is."""
    each = F.transform(
        F.sequence(F.lit(0), F.size("words") - F.col("need")),
        lambda i: F.struct((F.col("first") + i).alias("first"), F.array_join(F.slice("words", i + 1, F.col("need")), " ").alias("window")),
    )
    return df.select(*columns, "need", F.explode(each).alias("w")).select(*columns, "need", "w.first", "w.window")


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, rid, n_words), their hit windows (id, rid, first, last, items_class), and (items_class, item_id).

    items_class names a set of items; windows that no item with an id holds have none.
    """
    grams = _grams(benchmark.select("item_id", "text").distinct(), "item_id", None, None)
    grams = materialize(grams.select(F.col("id").alias("item_id"), F.explode("found").alias("g")).select("item_id", "g.*"), "winnow-items")
    needs = sorted(r["need"] for r in grams.select("need").distinct().collect())  # WINDOW of them at most
    held = materialize(_windows(grams, "item_id").select("need", "window", "item_id").distinct(), "winnow-held")
    # A set of items by its size and two sums over hashes, which tasks add up in part before the shuffle.
    name = F.xxhash64(F.col("item_id"), F.lit(1))
    of_items = F.when(F.count("item_id") > 0, F.md5(F.concat_ws(",", F.count("item_id"), F.sum(F.xxhash64("item_id").cast("decimal(38,0)")), F.bit_xor(F.when(F.col("item_id").isNotNull(), name)))))
    windows = materialize(held.groupBy("need", "window").agg(of_items.alias("items_class")), "winnow-windows")
    heads = windows.where("items_class is not null").groupBy("items_class").agg(F.min(F.struct("need", "window")).alias("w")).select("items_class", "w.*")
    lists = held.join(heads, ["need", "window"]).where("item_id is not null").select("items_class", "item_id")

    found = materialize(_grams(docs, "doc_id", needs, _bitmap(grams)), "winnow-docs")
    met = found.select("id", "rid", F.explode("found").alias("g")).select("id", "rid", "g.*").join(grams.select("need", "hash").distinct(), ["need", "hash"], "left_semi")
    spans = _windows(met, "id", "rid").join(windows, ["need", "window"])
    return found.select("id", "rid", "n_words"), spans.select("id", "rid", "first", (F.col("first") + F.col("need") - 1).alias("last"), "items_class").distinct(), lists


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (ids sorted as strings), contaminated."""
    return report(docs, benchmark).drop("items_sha256")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of contamination() and items_sha256, of the comma-joined items: made once for a set of items, so that lists nobody selects don't travel."""
    rows, spans, lists = hits(docs, benchmark)
    spans = materialize(spans, "winnow-spans")
    before = Window.partitionBy("rid", "id").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    lone = spans.select("id", "rid", "first", "last").distinct().withColumn("done", F.coalesce(F.max("last").over(before), F.lit(-1)))
    words = lone.groupBy("rid", "id").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first"), F.col("done") + 1) + 1)).alias("n_hit"))
    classes = spans.groupBy("rid", "id").agg(F.sort_array(F.collect_set("items_class")).alias("classes"))
    met = words.join(classes, (words.rid == classes.rid) & words.id.eqNullSafe(classes.id)).select(words.rid.alias("r"), words.id.alias("i"), "n_hit", "classes")
    met = materialize(met.withColumn("set", F.md5(F.array_join("classes", ","))), "winnow-met")
    sets = met.select("set", "classes").dropDuplicates(["set"]).select("set", F.explode("classes").alias("items_class"))
    names = sets.join(lists, "items_class").groupBy("set").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    names = names.withColumn("sha", F.sha2(F.array_join("items", ","), 256)).withColumn("n", F.size("items").cast("long"))
    out = rows.join(met.join(names, "set", "left").drop("set", "classes"), (rows.rid == F.col("r")) & rows.id.eqNullSafe(F.col("i")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
