"""Token ids as binary shards with a minimal perfect hash index.

Documents are dealt by ranges of doc_id into shards, and each task encodes its texts, streams the ids
to one payload file and then writes the index file beside it: both go to a name of the attempt and
are renamed, so a task that runs again leaves the same files.

    shard-00007.bin   ids of the documents one after the other, little-endian unsigned integers of 2 bytes (vocabularies up to 65,536) or 4
    shard-00007.idx   header of 8 little-endian u64: magic, version, bytes per id, keys, ids, levels, keys with null doc_id, seed of the keys' hash;
                      then for each level its number of 64-bit words, the words, and the ones before each word;
                      then by slot: fingerprint u32 of each key, offset u64, number of ids u64;
                      then in document order: doc_id i64, ordinal u32 (0, 1, ... among rows that repeat a doc_id)

The index is minimal and perfect: a key's hash picks one bit on each level until it meets a set one, whose rank is the key's slot.
Keys that collide on a level go on to the next. A lookup reads a few bits and one slot, and the stored fingerprint turns away foreign keys but for one in 2 ** 32.

`shards.parquet` beside the shards names each one's first and last doc_id: `Store` leads a key to its shard by them. A doc_id repeated so often that it fills several shards
is cut by the hash of its texts and found by counting on.

Encoding: the tokenizers library encodes pieces of text, and each piece once per cache life: byte-level BPE of this
vocabulary first cuts a text into words, numbers and marks (a single space goes with what follows it), so the ids of a text are
those of its pieces. Texts with a special token's string or characters beyond Latin letters are encoded whole.

Defined results: null text is empty (only the end id); null doc_id sorts first; repeated rows are stored each, ties of doc_id in the order of a hash of the text; a text of any length is one document; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, shuffle_partitions

END_ID = 0
MAGIC, VERSION = 0x5844495F4E454B54, 2
LOAD = 2  # bits for each key on a level
CACHE_PIECES = 800_000
SHARD_BYTES = 1 << 28
_SHARD = "shard int, path string, n_docs long, n_ids long, first long, last long, n_last long"
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
#: The pre-tokenizer's pattern (a fixed value of the vocabulary) on texts of the characters in _PLAIN, where it cuts alike.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^ \t\r\n{_LETTER}{_NUMBER}]+|[ \t\r\n]+(?![^ \t\r\n])|[ \t\r\n]+")
_PLAIN = re.compile(r"[\t\n\r -~¡-ɏ]*")
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of texts as bytes, through a bounded cache of pieces."""

    def __init__(self, tokenizer_path: str):
        import os

        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.cache: dict[str, bytes] = {}
        self.piecewise = self._cuts_alike(tokenizer_path)

    @staticmethod
    def _cuts_alike(tokenizer_path: str) -> bool:
        """Whether the tokenizer's file names the pre-tokenizer that _PIECE restates, no normalizer and no added token but _SPECIAL; else texts are encoded whole."""
        with open(tokenizer_path, encoding="utf-8") as f:
            said = json.load(f)
        cut = said.get("pre_tokenizer") or {}
        same = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        return same and not said.get("normalizer") and {t["content"] for t in said.get("added_tokens", [])} <= {_SPECIAL}

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if not self.piecewise or _SPECIAL in text or not _PLAIN.fullmatch(text):
                yield self.whole([text])[0] + self.end
                continue
            pieces, cache = _PIECE.findall(text), self.cache
            try:
                yield b"".join(map(cache.__getitem__, pieces)) + self.end
            except KeyError:
                new = list({p for p in pieces if p not in cache})
                fresh = dict(zip(new, self.whole(new), strict=True))
                if len(cache) + len(fresh) <= CACHE_PIECES:
                    cache.update(fresh)
                    yield b"".join(map(cache.__getitem__, pieces)) + self.end
                else:
                    yield b"".join([cache[p] if p in cache else fresh[p] for p in pieces]) + self.end


@lru_cache(maxsize=1)
def encoder_of(tokenizer_path: str) -> Encoder:
    """One encoder, and so one cache, for all tasks of a Python worker."""
    return Encoder(tokenizer_path)


def key_hash(ids, ordinals, seed: int = 0):
    """64-bit hashes of (doc_id, ordinal) keys."""
    import numpy as np

    h = np.uint64(seed * MAGIC & (1 << 64) - 1) ^ ordinals.astype(np.uint64)
    h = _stir(h) ^ ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _stir(h)


def _stir(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _level_bit(h, level: int, words: int):
    import numpy as np

    return _stir(h + np.uint64((level + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)) % np.uint64(64 * words)


def build_levels(h) -> list:
    """Bit words of each level for distinct hashes h."""
    import numpy as np

    levels = []
    while len(h):
        words = max(1, -(-LOAD * len(h) // 64))
        bit = _level_bit(h, len(levels), words)
        alone = np.bincount(bit.astype(np.int64), minlength=64 * words) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        h = h[~alone[bit.astype(np.int64)]]
    return levels


def ranks(levels: list) -> list:
    """Ones before each word, over all levels."""
    import numpy as np

    out, base = [], 0
    for words in levels:
        ones = np.bitwise_count(words).astype(np.uint64)
        out.append(np.uint64(base) + np.cumsum(ones) - ones)
        base += int(ones.sum())
    return out


def slots(levels: list, before: list, h):
    """Slot of each hash, -1 for one that meets no set bit."""
    import numpy as np

    out = np.full(len(h), -1, np.int64)
    left = np.arange(len(h))
    for k, words in enumerate(levels):
        bit = _level_bit(h[left], k, len(words))
        word, at = words[(bit >> np.uint64(6)).astype(np.int64)], bit & np.uint64(63)
        hit = (word >> at) & np.uint64(1) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << at) - np.uint64(1))).astype(np.uint64)
        out[left[hit]] = (before[k][(bit >> np.uint64(6)).astype(np.int64)] + below)[hit].astype(np.int64)
        left = left[~hit]
    return out


def _index_bytes(ids: list[int | None], ordinals: list[int], lengths: list[int], width: int) -> bytes:
    import numpy as np

    nulls = sum(x is None for x in ids)  # they come first
    doc = np.array([-(2**63) if x is None else x for x in ids], np.int64)
    order, size = np.array(ordinals, np.uint32), np.array(lengths, np.uint64)
    seed, at = 0, order + (np.arange(len(doc)) < nulls) * np.uint32(1 << 31)
    while len(np.unique(h := key_hash(doc, at, seed))) < len(doc):  # equal hashes would never part
        seed += 1
    levels = build_levels(h)
    before = ranks(levels)
    slot = slots(levels, before, h)
    prints, offsets, n = np.zeros(len(h), "<u4"), np.zeros(len(h), "<u8"), np.zeros(len(h), "<u8")
    prints[slot], offsets[slot], n[slot] = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.cumsum(size) - size, size
    head = np.array([MAGIC, VERSION, width, len(h), int(size.sum()), len(levels), nulls, seed], "<u8").tobytes()
    parts = [np.array([len(w)], "<u8").tobytes() + w.tobytes() + b.astype("<u8").tobytes() for w, b in zip(levels, before, strict=True)]
    return b"".join([head, *parts, prints.tobytes(), offsets.tobytes(), n.tobytes(), doc.astype("<i8").tobytes(), order.astype("<u4").tobytes()])


class Shard:
    """Keyed reader of one shard."""

    def __init__(self, path: str):
        import numpy as np
        from pyarrow import fs

        self.fs, at = fs.FileSystem.from_uri(path)
        with self.fs.open_input_file(at + ".idx") as f:
            data = f.read()
        head = np.frombuffer(data, "<u8", 8)
        if int(head[0]) != MAGIC or int(head[1]) != VERSION:
            raise ValueError(f"{path}.idx is no index of this format")
        self.width, n, self.n_ids, levels, self.nulls, self.seed = (int(x) for x in head[2:8])
        self.levels, self.before, pos = [], [], 64
        for _ in range(levels):
            words = int(np.frombuffer(data, "<u8", 1, pos)[0])
            self.levels.append(np.frombuffer(data, "<u8", words, pos + 8))
            self.before.append(np.frombuffer(data, "<u8", words, pos + 8 + 8 * words))
            pos += 8 + 16 * words
        columns = []
        for kind in ("<u4", "<u8", "<u8", "<i8", "<u4"):
            columns.append(np.frombuffer(data, kind, n, pos))
            pos += n * np.dtype(kind).itemsize
        self.prints, self.offsets, self.sizes, self.doc_ids, self.ordinals = columns
        self.payload = self.fs.open_input_file(at + ".bin")

    def find(self, ids, ordinals, null):
        """Slots of keys, -1 where the shard holds no such key."""
        import numpy as np

        h = key_hash(ids, ordinals + null * np.uint32(1 << 31), self.seed)
        at = slots(self.levels, self.before, h)
        good = (at >= 0) & (len(self.prints) > 0)
        good[good] = self.prints[at[good]] == (h[good] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return np.where(good, at, -1)

    def read(self, slot: int):
        """Ids at a slot."""
        import numpy as np

        raw = self.payload.read_at(int(self.sizes[slot]) * self.width, int(self.offsets[slot]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def lookup(self, doc_id: int | None, ordinal: int = 0):
        """Ids of a document, None if it isn't here."""
        import numpy as np

        at = self.find(np.array([-(2**63) if doc_id is None else doc_id], np.int64), np.array([ordinal], np.uint32), np.array([doc_id is None]))[0]
        return None if at < 0 else self.read(at)


def _writer(folder: str, tokenizer_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        name, attempt = f"{base}/shard-{task.partitionId():05d}", f"{base}/.attempt-{task.taskAttemptId()}"
        encoder, out = encoder_of(tokenizer_path), None
        ids, ordinals, lengths = [], [], []
        for batch in batches:
            if out is None:
                out = store.open_output_stream(attempt + ".bin")
            ids_here, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, data in zip(ids_here, encoder.encode(texts), strict=True):
                ordinals.append(ordinals[-1] + 1 if ids and ids[-1] == doc_id else 0)
                ids.append(doc_id)
                lengths.append(len(data) // encoder.dtype.itemsize)
                out.write(data)
        if out is None or not ids:
            return
        out.close()
        with store.open_output_stream(attempt + ".idx") as f:
            f.write(_index_bytes(ids, ordinals, lengths, encoder.dtype.itemsize))
        for end in (".bin", ".idx"):
            if store.get_file_info(name + end).type != fs.FileType.NotFound:
                store.delete_file(name + end)  # of an attempt that was lost on its way from here on: it wrote the same
            store.move(attempt + end, name + end)
        scheme = folder[: folder.index(base)] if base in folder else ""
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [scheme + name], "n_docs": [len(ids)], "n_ids": [sum(lengths)], "first": pa.array(ids[:1], pa.int64()), "last": pa.array(ids[-1:], pa.int64()), "n_last": [ordinals[-1] + 1]})

    return run


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards and, beside them, the table of shards that Store.open reads: shard, path, n_docs, n_ids, first and last doc_id, n_last (rows of the
    last one), and base, the number of ids in the shards before. A shard holds some `shard_bytes` of text, less in small tables."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    n = max(shuffle_partitions(spark), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    shards = materialize(dealt.mapInArrow(_writer(folder, tokenizer_path), _SHARD), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    shards.write.parquet(f"{folder}/shards.parquet")
    return spark.read.schema(shards.schema).parquet(f"{folder}/shards.parquet")


class Store:
    """Keyed reader of all shards: the bounds of their ranges lead a key to its shard.

    Rows that repeat a doc_id have ordinals over the whole store. They follow each other, so only a doc_id that ends a shard goes on in the next ones;
    its ordinals there are moved by the rows before.
    """

    def __init__(self, shards: list) -> None:
        key = lambda x: (x is not None, x or 0)
        self.shards = sorted(shards, key=lambda r: r["shard"])
        self.last = [key(r["last"]) for r in self.shards]
        self.key, self.open_shards = key, {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Store:
        return cls(spark.read.parquet(f"{folder}/shards.parquet").collect())  # a row for each shard

    def lookup(self, doc_id: int | None, ordinal: int = 0):
        """Ids of a document, None if there is none of this key."""
        at = bisect_left(self.last, self.key(doc_id))
        while at < len(self.shards) and self.key(self.shards[at]["first"]) <= self.key(doc_id):
            row = self.shards[at]
            if row["last"] != doc_id or ordinal < row["n_last"]:
                shard = self.open_shards.setdefault(row["path"], None) or Shard(row["path"])
                self.open_shards[row["path"]] = shard
                return shard.lookup(doc_id, ordinal)
            ordinal -= row["n_last"]
            at += 1
        return None


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard(path)
            null = np.arange(len(shard.doc_ids)) < shard.nulls
            at = shard.find(shard.doc_ids, shard.ordinals, null)
            if (at < 0).any():
                raise ValueError(f"{path}: a key has no slot")
            for i in range(0, len(at), 8192):
                here = at[i : i + 8192]
                crc = [zlib.crc32(shard.read(s).astype("<u4").tobytes()) for s in here]
                ids = pa.array(shard.doc_ids[i : i + 8192], pa.int64(), mask=null[i : i + 8192])
                start = pa.array((shard.offsets[here] + np.uint64(base)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([ids, start, pa.array(shard.sizes[here].astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_store(shards: DataFrame) -> DataFrame:
    """One row per stored document, each read from its payload by key through the index: doc_id, start, n_tokens, ids_crc32."""
    n = shuffle_partitions(shards.sparkSession)
    return shards.select("path", "base").repartition(n, "path").mapInArrow(_read_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Encodes, writes and reads back."""
    spark: SparkSession = docs.sparkSession
    return read_store(write_store(docs, folder or new_path(spark, "token-store"), tokenizer_path))
