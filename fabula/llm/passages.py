"""Near-duplicate passages by compact windows.

Tokens of a text are its shingles of five words (lower case). Each of `FUNCTIONS` hash functions orders the tokens. A node of
the Cartesian tree over a function's hashes whose range holds `TOKENS` tokens or more is a compact window: all passages of `PASSAGE`
words inside the range that hold the node's token have it as their smallest one, so they share that signature. The smallest
tokens of the passages, walked from left to right, are those nodes in order: a sliding minimum finds them in linear time, whatever the
text repeats. A window is kept as the interval [a, b] of its passages' first words, with the place c of the smallest token.

Two passages of 50 words whose shingle sets have Jaccard similarity 0.8 agree in each function with that chance; they meet
when `ENOUGH` = 2 of them agree (0.993 of such pairs, and more of longer passages). The windows of two functions are joined on overlap of
their intervals, which gives composite windows: (key of both signatures, a, b, c). Only windows whose signature occurs
at another place take part: a first pass over the texts counts signatures, combined before the shuffle, and ORs the repeated ones
into a bitmap; a second pass forms the composite windows. The bitmap has a size fixed by the count of repeated signatures and a limit
(`BITMAP_BITS`); whatever it lets through besides is removed by the grouping after it.

The places of a composite key all meet its first place (smallest text name, then place): no pairs within a group. A meeting is verified on
the words around both places: every two stretches of 50 words with shingle sets of similarity 0.8 or more are marked, on the
diagonal of the meeting and across to the ones beside it (a word inserted or deleted). Where a place of a key isn't
verified against the first one anywhere in its window, all places of that key take part in an exact join (`one_edit`): where two stretches of 50 words
have the same 25 words in one half and differ by one edit in the other, their link is an equality of keys, and equal ones are linked
to one of them. So a text with the passage is linked even if the first holder of its key has another one. What that join can miss: stretches that share 45 to 49
words in a row and differ by several words at one end are similar enough, too, and where the first holder of their key fails, single edits don't spell them out.

Copies of one text are one text here (named by a 64-bit hash of text and length) and inherit its marks.

Defined results: texts of fewer than 50 words, null and empty ones have no passages; repeated rows each get their row; a passage
that one text repeats counts, linked within the text; copies of a whole text of 50 words or more mark it whole; ties between equal tokens go
to the first; a text of any length is cut into pieces of `PIECE` tokens that overlap by a passage; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import BLOCK, MIX, Segments, mixed, word_hashes
from .common import connected_components, discard, materialize

SHINGLE, PASSAGE, SIMILARITY = 5, 50, 0.8
TOKENS, HALF = PASSAGE - SHINGLE + 1, PASSAGE // 2
FUNCTIONS, ENOUGH = 5, 2
PIECE = 1 << 20
BITMAP_BITS = 26
AROUND = 2 * PASSAGE
_RUNS = "t long, u long, first int, last int"


def shingles(h):
    """Hash of every run of five words."""
    import numpy as np

    out = np.full(max(0, len(h) - SHINGLE + 1), 1, np.uint64)
    for i in range(SHINGLE if len(out) else 0):
        out = (out ^ h[i : i + len(out)]) * np.uint64(MIX[0])
        out ^= out >> np.uint64(29)
    return out


class Texts:
    """Words of several texts in one array: hashes h, and for each text its name, number of words and the place of its first one in the whole text."""

    def __init__(self, names: list, sizes, h, moved: list) -> None:
        import numpy as np

        ends = np.cumsum(sizes)
        self.h, self.names = h, np.array(names, np.int64)
        self.text = np.repeat(np.arange(len(names)), sizes)
        self.moved = np.array(moved, np.int64) - (ends - sizes)
        self.starts = np.flatnonzero(np.arange(len(h)) + PASSAGE <= ends[self.text])

    def name(self, at):
        return self.names[self.text[at]]

    def local(self, at):
        """Place within the text."""
        return at + self.moved[self.text[at]]


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    """Rows (t, text), up to `BLOCK` bytes at a time; a longer text in pieces that overlap by a passage less a word."""
    import numpy as np

    def joined(kept: list) -> Texts:
        h, begin = word_hashes(b"\n".join(x for _, x in kept))
        ends = np.cumsum([len(x) + 1 for _, x in kept])
        sizes = np.diff(np.searchsorted(begin, ends), prepend=0)
        return Texts([t for t, _ in kept], sizes, h, [0] * len(kept))

    kept, n = [], 0
    for t, text in _each(batches):
        if len(text) > BLOCK:
            h, _ = word_hashes(text)
            for at in range(0, max(0, len(h) - PASSAGE + 1), PIECE):
                part = h[at : at + PIECE + PASSAGE - 1]
                yield Texts([t], [len(part)], part, [at])
            continue
        if n + len(text) > BLOCK:
            yield joined(kept)
            kept, n = [], 0
        kept.append((t, text))
        n += len(text) + 1
    if kept:
        yield joined(kept)


def compact_windows(texts: Texts, tokens, function: int) -> tuple:
    """(a, b, c, key) of the windows of one hash function: passages that begin at a to b have their smallest token at c. Each passage is in one."""
    import numpy as np

    bits = np.uint64((1 << 24) - 1)
    low = (mixed(tokens, MIX[1] + function) & ~bits) | np.arange(len(tokens), dtype=np.uint64)
    width = 1
    while width * 2 <= TOKENS:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = TOKENS - width
    centre = (np.minimum(low[: len(low) - rest], low[rest:])[texts.starts] & bits).astype(np.int64)
    first = np.flatnonzero(np.diff(centre, prepend=-1))
    c = centre[first]
    return texts.starts[first], texts.starts[np.append(first[1:], len(centre)) - 1], c, mixed(tokens[c], MIX[2] + function).view(np.int64)


def signatures(texts: Texts) -> list[tuple]:
    tokens = shingles(texts.h)
    return [compact_windows(texts, tokens, f) for f in range(FUNCTIONS)]


def composite_windows(windows: list[tuple], chosen: list) -> list:
    """(key, a, b, c) arrays: the interval join of each two functions' windows among the chosen ones."""
    import numpy as np

    out: list[list] = [[], [], [], []]
    for f in range(len(windows)):
        for g in range(f):
            (a, b, c, key), (a2, b2, _, key2) = ([x[chosen[k]] for x in windows[k]] for k in (f, g))
            if not len(a) or not len(a2):
                continue
            # Intervals of one function are apart and in order: those of g that overlap [a, b] follow each other.
            first, n = np.searchsorted(b2, a), np.searchsorted(a2, b, "right")
            n = np.maximum(n - first, 0)
            i = np.repeat(np.arange(len(a)), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]
            both = mixed(key[i].view(np.uint64) + mixed(key2[j].view(np.uint64), f * FUNCTIONS + g), 7).view(np.int64)
            for x, y in zip(out, (both, np.maximum(a[i], a2[j]), np.minimum(b[i], b2[j]), c[i]), strict=True):
                x.append(y)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _in_chunks(rows: Iterator[list], names: list[str], least: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Lists of arrays, one list for each text, as batches of `least` rows and more."""
    import numpy as np

    kept, n = [], 0
    for arrays in rows:
        kept.append(arrays)
        n += len(arrays[0])
        if n >= least:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept, strict=True)], names)
            kept, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept, strict=True)], names)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(t, text) of rows (t, text), one text at a time."""
    for batch in batches:
        for t, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            yield t, text.as_py()


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place): signatures of all windows; place is a hash of text and place, equal in copies of a text."""
    import numpy as np

    def rows():
        for texts in together(batches):
            for _, _, c, key in signatures(texts):
                yield [key, (mixed(texts.name(c).view(np.uint64), 3) + texts.local(c).view(np.uint64)).astype(np.uint32).view(np.int32)]

    return _in_chunks(rows(), ["key", "place"])


def _in_bitmap(bitmap: bytes, key):
    """Which of the 64-bit keys have their bit set."""
    import numpy as np

    bits = np.frombuffer(bitmap, np.uint8)
    slot = (key.view(np.uint64) >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _bits(n: int) -> int:
    """Logarithm of a bitmap's size for n keys: 32 bits for each, 2 ** BITMAP_BITS at most (8 MB), whatever their number."""
    return max(12, min(BITMAP_BITS, (32 * n).bit_length()))


def _slot(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def _bitmap(keys: DataFrame, bits: int) -> bytes:
    """Bitmap of the column key, ORed in Spark: the driver gets 2 ** (bits - 6) rows at most."""
    import numpy as np

    slot = _slot(F.col("key"), bits)
    rows = keys.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    out = np.zeros(1 << (bits - 6), "<i8")
    packed = rows.toArrow()
    out[packed.column("at").to_numpy()] = packed.column("bits").to_numpy()
    return out.tobytes()


def _equal_rows(bitmap: bytes) -> Callable:
    """(same, t, place): the first function's windows of signatures in the bitmap; same is a hash of all words of the window's passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def rows():
            for texts in together(batches):
                a, b, _, key = (x for x in compact_windows(texts, shingles(texts.h), 0))
                hit = _in_bitmap(bitmap, key)
                a, b = a[hit], b[hit]
                same = mixed(Segments(texts.h)(a, b - a + PASSAGE) + (b - a).astype(np.uint64), 53).view(np.int64)
                yield [same, texts.name(a), (texts.local(a) << 16) | ((b - a) << 8)]

        return _in_chunks(rows(), ["same", "t", "place"])

    return run


def _window_rows(bitmap: bytes, others: bytes, kept: bytes) -> Callable:
    """(key, same, t, place): composite windows of signatures in the bitmap; same is a hash of key and of all words of the window's passages.

    Left out are those whose passages all lie in windows that equal a first one elsewhere (in others and not in kept).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def rows():
            for texts in together(batches):
                found = signatures(texts)
                chosen = [_in_bitmap(bitmap, w[3]) for w in found]
                a, b = found[0][0], found[0][1]
                t, at = texts.name(a), texts.local(a) << 38
                gone = chosen[0] & _in_bitmap(others, t ^ at) & ~_in_bitmap(kept, (t << 26) ^ at)
                news = np.zeros(len(texts.h) + 1, np.int64)
                news[a[~gone]] += 1
                np.subtract.at(news, b[~gone] + 1, 1)
                news = np.concatenate([[0], np.cumsum(np.cumsum(news))])  # number of first words before a place that are of other windows
                key, a, b, c = composite_windows(found, chosen)
                new = news[b + 1] > news[a]
                key, a, b, c = key[new], a[new], b[new], c[new]
                if len(key):
                    same = mixed(Segments(texts.h)(a, b - a + PASSAGE) + mixed(key.view(np.uint64), 47), 53).view(np.int64)
                    yield [key, same, texts.name(a), (texts.local(a) << 16) | ((b - a) << 8) | (c - a)]

        return _in_chunks(rows(), ["key", "same", "t", "place"])

    return run


def _bodies(bitmap: bytes) -> Callable:
    """(t, body) of the texts whose name is in the bitmap: the hashes of their words, 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            near = batch.filter(pa.array(_in_bitmap(bitmap, batch.column(0).to_numpy())))
            for at in range(0, near.num_rows, 256):
                part = near.slice(at, 256)
                words = [(word_hashes(text)[0] >> np.uint64(32)).astype("<u4").tobytes() for _, text in _each([part])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.binary())], ["t", "body"])

    return run


def _words(body: bytes):
    import numpy as np

    return mixed(np.frombuffer(body, "<u4").astype(np.uint64), 3)


def similar_starts(lanes: list[tuple]) -> list:
    """For lanes (a, b, skip): (lane, start in a, start in b) arrays of similar stretches of PASSAGE words.

    a and b are word hashes, b from one word before a's partner on to one after it; words that b's text lacks there are zero. A stretch's shared tokens
    lie on the diagonal of the lane (0), or on it and one beside it (a word inserted or deleted in between). skip: the diagonal, of -1 and 1, to leave out. All
    lanes are compared at once, as one array.
    """
    import numpy as np

    sizes = np.array([len(a) for a, _, _ in lanes])
    ends = np.cumsum(sizes + 2)  # two places apart, so that b has its two words more
    begins = ends - sizes - 2
    lane = np.repeat(np.arange(len(lanes)), sizes + 2)
    a, b = np.full(ends[-1], 1, np.uint64), np.full(ends[-1], 2, np.uint64)
    for at, (x, y, _) in zip(begins.tolist(), lanes, strict=True):
        a[at : at + len(x)] = x
        b[at : at + len(y)] = y
    one, two = shingles(a), shingles(b)
    inside = np.arange(len(one)) + SHINGLE <= (ends - 2)[lane[: len(one)]]
    known = np.concatenate([[0], np.cumsum(b == 0)])
    skips = np.array([s or 0 for _, _, s in lanes])[lane[: len(one)]]

    def equal(e: int):
        out = np.zeros(len(one), bool)
        n = len(one) - 2
        out[:n] = (one[:n] == two[1 + e : 1 + e + n]) & inside[:n]
        return out & (skips != e) if e else out

    def count(mask):
        n = np.concatenate([[0], np.cumsum(mask)])
        return n[TOKENS:] - n[:-TOKENS]

    starts = np.flatnonzero(np.arange(max(0, len(one) - TOKENS + 1)) + PASSAGE <= (ends - 2)[lane[: max(0, len(one) - TOKENS + 1)]])
    found = [np.zeros((3, 0), np.int64)]

    def keep(n, e: int) -> None:
        at = starts[n[starts] >= (2 * TOKENS - n[starts]) * SIMILARITY]
        at = at[(at + 1 + e + PASSAGE <= len(b))]
        at = at[known[at + 1 + e + PASSAGE] == known[at + 1 + e]]
        k = lane[at]
        found.append(np.stack([k, at - begins[k], at - begins[k] + e]))

    if not len(starts):
        return found[0]
    here = equal(0)
    keep(count(here), 0)
    for e in (-1, 1):
        beside = equal(e) & ~here
        if beside.any():
            both = count(here | beside)
            head, tail = slice(0, len(both)), slice(TOKENS - 1, None)
            keep(both - beside[tail if e > 0 else head], 0)  # b's stretch ends, or begins, before this token's partner
            keep(both - (here & ~equal(e))[head if e > 0 else tail], e)
    return np.concatenate(found, 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, u, first, last): passages of t that begin at first to last are similar to one of u; both ways."""
    import numpy as np

    def runs(lane, at, t, u):
        """Runs of consecutive places of each lane."""
        both = np.unique((lane << 40) + at)  # runs of two lanes are never consecutive
        new = np.flatnonzero(np.diff(both, prepend=-2) != 1)
        k, place = both >> 40, (both & ((1 << 40) - 1)).astype(np.int32)
        return [t[k[new]], u[k[new]], place[new], place[np.append(new[1:], len(both)) - 1]]

    def rows():
        for batch in batches:
            u, t, shift, at = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("u", "t", "shift", "at"))
            own, other = (batch.column(batch.schema.get_field_index(x)) for x in ("own", "other"))
            k = 0
            while k < batch.num_rows:
                lanes, first, n = [], k, 0
                while k < batch.num_rows and n < 1 << 17:
                    a, b = (_words(x[k].as_py()) for x in (own, other))
                    if at[k] + shift[k] == 0:
                        b = np.concatenate([np.zeros(1, np.uint64), b])
                    b = b[: len(a) + 2]
                    lanes.append((a, np.concatenate([b, np.zeros(len(a) + 2 - len(b), np.uint64)]), -shift[k] if u[k] == t[k] and abs(shift[k]) == 1 else None))
                    n += len(a)
                    k += 1
                lane, x, y = similar_starts(lanes)
                if len(lane):
                    lane += first
                    yield runs(lane, x + at[lane], u, t)
                    yield runs(lane, y + at[lane] + shift[lane], t, u)

    return _in_chunks(rows(), ["t", "u", "first", "last"])


def _half_keys(h, at, side: int):
    """The half that is equal: the first (side 0) or the second one of the passages that begin at `at`."""
    return mixed(h(at + side * HALF, HALF), 11 + side)


def _half_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, t, at, side, open): the halves of each passage; `wanted` are intervals of first words."""
    import numpy as np

    def covered(a, b, n: int):
        """Which of n places lie in one of the intervals a to b."""
        return np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b + 1, minlength=n + 1))[:n] > 0

    def rows():
        for batch in batches:
            for t, body, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = _words(body.as_py())
                a, b, is_open = (wanted.values.field(x).to_numpy(zero_copy_only=False) for x in ("a", "b", "open"))
                at = np.flatnonzero(covered(a, b, len(words)))
                opened, h = covered(a[is_open], b[is_open], len(words))[at], Segments(words)
                for side in (0, 1):
                    yield [_half_keys(h, at, side).view(np.int64), np.full(len(at), t, np.int64), at.astype(np.int32), np.full(len(at), side, np.int8), opened]

    return _in_chunks(rows(), ["key", "t", "at", "side", "open"])


def _by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(t, its runs, side, first words, open) of rows (t, body, wanted), wanted being (at, side, open)."""
    import numpy as np

    for batch in batches:
        for t, body, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            h = Segments(_words(body.as_py()))
            at, of, is_open = (wanted.values.field(x).to_numpy(zero_copy_only=False) for x in ("at", "side", "open"))
            for side in (0, 1):
                places, slot = np.unique(at[of == side], return_inverse=True)
                if len(places):
                    opened = np.bincount(slot, is_open[of == side], len(places)) > 0
                    yield t, h, side, places.astype(np.int64), opened


def _quarter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, t, at, side, open): an equal half with twelve words of the other one, which an edit elsewhere in it leaves equal: beside the half, or
    at the far end, there with and without its last word, as an inserted word moves them by one."""
    import numpy as np

    def rows():
        for t, h, side, at, is_open in _by_side(batches):
            same, n = _half_keys(h, at, side), HALF // 2
            near, far = (HALF, (PASSAGE - n - 1, PASSAGE - n)) if side == 0 else (HALF - n, (0, 1))
            for offset, salt in ((near, 37), (far[0], 41), (far[1], 41)):
                key = mixed(same + mixed(h(at + offset, n), salt), 43).view(np.int64)
                yield [key, np.full(len(at), t, np.int64), at.astype(np.int32), np.full(len(at), side, np.int8), is_open]

    return _in_chunks(rows(), ["key", "t", "at", "side", "open"])


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, t, at, edge): a passage's equal half with the other half less one word.

    With a hole where the word was, equal keys are passages with one word replaced. Without a hole, the one that lost its outermost word (edge)
    is similar to all that are equal to it: a word was inserted or deleted.
    """
    import numpy as np

    def rows():
        for t, h, side, at, _ in _by_side(batches):
            same, rest = _half_keys(h, at, side), at + (1 - side) * HALF
            for hole in range(HALF):
                left = h(rest, hole)
                right = h(rest + hole + 1, HALF - 1 - hole)
                # The words after the gap, moved back by one place: the hash of the 24 words without it.
                joined = left + right * np.uint64(pow(MIX[0] | 1, hole, 1 << 64))
                outer = hole == (0 if side else HALF - 1)
                for key, edge in ((mixed(same + mixed(mixed(left, 13) ^ mixed(right, 17 + hole), 19), 23), True), (mixed(same + mixed(joined, 29), 31), outer)):
                    yield [key.view(np.int64), np.full(len(at), t, np.int64), at.astype(np.int32), np.full(len(at), edge, bool)]

    return _in_chunks(rows(), ["key", "t", "at", "edge"])


def texts(docs: DataFrame) -> DataFrame:
    """(t, text) of the rows with a text: t names it."""
    return docs.select(name_of(docs["text"]).alias("t"), docs["text"].alias("text")).where("text is not null")


def name_of(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def placed(df: DataFrame) -> DataFrame:
    """place as the window's first passages a to b and the place c of its token: one number, so that windows take little room and have an order."""
    a = F.shiftright("place", 16)
    at = lambda bits: F.shiftright("place", bits).bitwiseAND(F.lit(255))
    return df.select("*", a.cast("int").alias("a"), (a + at(8)).cast("int").alias("b"), (a + at(0)).cast("int").alias("c"))


def windows_of(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, same, t, place) of the composite windows of repeated signatures, not yet written, and (t, u, first, last) of windows equal to a first one.

    Equal windows of the first function are linked to the first one of them. For all but that one, composite windows would
    find the same texts again, so they are left out: others is a bitmap of them, kept one of the windows that share a bit of it though they aren't among them.
    """
    seen = named.mapInArrow(_signature_rows, "key long, place int").groupBy("key").agg(F.min("place").alias("x"), F.max("place").alias("y")).where("x <> y")
    seen = materialize(seen.select("key"), "passage-signatures")
    bitmap = _bitmap(seen, _bits(seen.count()))
    rows = materialize(named.mapInArrow(_equal_rows(bitmap), "same long, t long, place long"), "passage-firsts")
    place = F.struct("t", "place")
    heads = rows.groupBy("same").agg(F.min(place).alias("head"), F.max(place).alias("tail")).where("head <> tail").select("same", F.col("head.t").alias("u"), F.col("head.place").alias("u_place"))
    firsts = rows
    rows = materialize(placed(rows.join(heads, "same", "left")).withColumn("other", F.coalesce((F.col("t") != F.col("u")) | (F.col("place") != F.col("u_place")), F.lit(False))).select("t", "u", "a", "b", "other"), "passage-equal")
    discard(firsts, seen)
    at = F.call_function("shiftleft", F.col("a").cast("long"), F.lit(38))
    keyed = rows.select("other", F.col("t").bitwiseXOR(at).alias("key"), F.call_function("shiftleft", F.col("t"), F.lit(26)).bitwiseXOR(at).alias("kept"))
    bits = _bits(rows.where("other").count())
    slot = _slot(F.col("key"), bits)
    mixed = keyed.groupBy(slot.alias("slot")).agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y").select("slot")
    kept = materialize(keyed.where("not other").join(mixed, slot == F.col("slot"), "left_semi").select(F.col("kept").alias("key")), "passage-kept")
    windows = named.mapInArrow(_window_rows(bitmap, _bitmap(keyed.where("other"), bits), _bitmap(kept, _bits(kept.count()))), "key long, same long, t long, place long")
    return windows, rows.where("u is not null").select("t", "u", F.col("a").alias("first"), F.col("b").alias("last")).distinct()


def meetings(heads: DataFrame) -> DataFrame:
    """(key, t, a, b, c, u, u_c, n): the different windows of a composite key, each with the first one, which is in it, too; n of them."""
    keys = heads.groupBy("key").agg(F.min(F.struct("t", "place")).alias("head"), F.count("*").alias("n")).where("n > 1")
    keys = keys.select("key", F.col("head.t").alias("u"), (F.shiftright("head.place", 16) + F.col("head.place").bitwiseAND(F.lit(255))).cast("int").alias("u_c"), "n")
    return materialize(placed(heads.select("key", "t", "place").join(keys, "key")).drop("place"), "passage-meetings")


def verified(met: DataFrame, bodies: DataFrame) -> DataFrame:
    """(t, u, first, last) of the meetings that are similar passages."""
    lanes = met.where("t <> u or c <> u_c").groupBy("u", "t", (F.col("c") - F.col("u_c")).alias("shift")).agg(F.min("u_c").alias("low"), F.max("u_c").alias("high"))
    lanes = lanes.withColumn("at", F.greatest(F.lit(0), -F.col("shift"), F.col("low") - AROUND)).withColumn("n", F.col("high") - F.col("at") + AROUND + PASSAGE)
    cut = lambda at, n: F.substring("body", at * 4 + 1, n * 4)
    before = F.greatest(F.lit(0), F.col("at") + F.col("shift") - 1)
    one = lanes.join(bodies.withColumnRenamed("t", "u"), "u").select("u", "t", "shift", "at", before.alias("before"), "n", cut(F.col("at"), F.col("n")).alias("own"))
    two = one.join(bodies, "t").select("u", "t", "shift", "at", "own", cut(F.col("before"), F.col("n") + 2).alias("other"))
    return two.mapInArrow(_verify, _RUNS)


def unsettled(met: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, t, c) of meetings with no similar passage of their window, of texts that aren't of one class already or have no mark there."""
    moved = met.where("n > 2 and (t <> u or c <> u_c)")  # of two windows both have met
    runs_of = lambda *k: runs.groupBy(*k).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    hit = F.coalesce(F.exists("runs", lambda r: (r["first"] <= F.col("b")) & (r["last"] >= F.col("a"))), F.lit(False))
    lost = materialize(moved.join(runs_of("t", "u"), ["t", "u"], "left").where(~hit).select("key", "t", "u", "a", "b", "c"), "passage-failed")
    parts = materialize(connected_components(links_of(runs)), "passage-classes")
    near = lost.join(parts.withColumnRenamed("node", "t"), "t", "left").withColumnRenamed("root", "t_root").join(parts.withColumnRenamed("node", "u"), "u", "left")
    apart = F.coalesce("t_root", "t") != F.coalesce("root", "u")
    near = near.join(runs_of("t"), "t", "left")
    return near.where(apart | ~hit).select("key", "t", "c")


def links_of(runs: DataFrame) -> DataFrame:
    return runs.where("t <> u").select(F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b")).distinct()


def one_edit(met: DataFrame, runs: DataFrame, bodies: DataFrame) -> DataFrame:
    """runs, and (t, u, first, last) of all passages, among the places of keys with failed meetings, that are equal but for one edit."""
    lost = unsettled(met, runs)
    lost = materialize(lost.distinct().withColumn("open", F.lit(True)), "passage-open")
    part = met.join(lost.select("key").distinct(), "key", "left_semi").join(lost, ["key", "t", "c"], "left")
    wanted = part.groupBy("t").agg(F.collect_set(F.struct("a", "b", F.coalesce("open", F.lit(False)).alias("open"))).alias("wanted"))
    kind, place = "key long, t long, at int, side byte, open boolean", F.struct("t", "at")
    rows = materialize(bodies.join(wanted, "t").select("t", "body", "wanted").mapInArrow(_half_rows, kind), "passage-halves")

    def shared(rows: DataFrame) -> DataFrame:
        """(t, body, wanted): the rows whose key another place has, too, one of them in an open window."""
        keys = rows.groupBy("key").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("open").alias("open")).where("x <> y and open")
        near = rows.join(keys.select("key"), "key", "left_semi").groupBy("t").agg(F.collect_set(F.struct("at", "side", "open")).alias("wanted"))
        return bodies.join(near, "t").select("t", "body", "wanted")

    halves = rows
    rows = materialize(shared(rows).mapInArrow(_quarter_rows, kind).withColumnRenamed("at", "c"), "passage-quarters")
    discard(halves, lost)
    quarters = rows
    # Places with the same 37 words meet the first of them, as before; only where that fails, too, edits are spelled out.
    rows = rows.groupBy("key", "t", "c", "side").agg(F.max("open").alias("open"))
    keys = rows.groupBy("key").agg(F.min(F.struct("t", "c")).alias("head"), F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 and open")
    near = rows.join(keys.select("key", F.col("head.t").alias("u"), F.col("head.c").alias("u_c"), "n"), "key")
    near = materialize(near.select("key", "t", (F.col("c") - HALF).alias("a"), (F.col("c") + HALF).alias("b"), "c", "u", "u_c", "n", "side"), "passage-near")
    discard(quarters)
    runs = materialize(runs.union(verified(near, bodies)), "passage-again")
    lost = materialize(unsettled(near, runs).select("key").distinct(), "passage-lost")
    wanted = near.join(lost, "key", "left_semi").groupBy("t").agg(F.collect_set(F.struct(F.col("c").alias("at"), "side", F.lit(True).alias("open"))).alias("wanted"))
    edits = bodies.join(wanted, "t").select("t", "body", "wanted").mapInArrow(_edit_rows, "key long, t long, at int, edge boolean")
    edits = materialize(edits, "passage-edits")
    heads = edits.groupBy("key").agg(F.min(F.when(F.col("edge"), place)).alias("head"), F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y and head is not null")
    linked = edits.join(heads.select("key", "head"), "key").where(place != F.col("head"))
    both = linked.select(F.explode(F.array(F.struct("t", F.col("head.t").alias("u"), "at"), F.struct(F.col("head.t").alias("t"), F.col("t").alias("u"), F.col("head.at").alias("at")))).alias("e"))
    return runs.union(both.select("e.t", "e.u", F.col("e.at").alias("first"), F.col("e.at").alias("last")).distinct())


def passages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_links (texts that it shares passages with by links made), spans (marked word spans, first and last), n_marked (words), class_id (smallest doc_id reachable)."""
    named = texts(docs)
    bare = F.btrim(docs["text"], F.lit(" \t\n\x0b\x0c\r"))
    n_words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+")))
    sizes = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), name_of(docs["text"]).alias("t"), n_words.alias("n_words"))
    kinds = materialize(sizes.groupBy("t").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("n_words").alias("n_words")), "passage-kinds")
    windows, equal = windows_of(named)
    heads = materialize(windows.groupBy("key", "same").agg(F.min(F.struct("t", "place")).alias("head")).select("key", "same", "head.t", "head.place"), "passage-heads")
    met = meetings(heads)
    discard(heads)
    involved = materialize(met.select(F.col("t").alias("key")).distinct(), "passage-involved")
    bodies = named.mapInArrow(_bodies(_bitmap(involved, _bits(involved.count()))), "t long, body binary").dropDuplicates(["t"])
    bodies = materialize(bodies.join(involved, F.col("t") == F.col("key"), "left_semi"), "passage-bodies")
    runs = materialize(verified(met, bodies).union(equal), "passage-runs")
    runs = materialize(one_edit(met, runs, bodies), "passage-links")
    before = Window.partitionBy("t").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("t").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    lone = runs.select("t", "first", (F.col("last") + PASSAGE - 1).alias("last")).distinct()
    lone = lone.withColumn("new", F.coalesce((F.col("first") > F.max("last").over(before) + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(upto))
    joined = lone.groupBy("t", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    joined = joined.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    pairs = links_of(runs)
    links = pairs.union(pairs.select("b", "a")).groupBy(F.col("a").alias("t")).agg(F.count("*").alias("links"))
    parts = connected_components(pairs)
    per = kinds.join(joined, "t", "left").join(links, "t", "left").join(parts.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    named_classes = per.groupBy("root").agg(F.min("first_id").alias("class_id"))
    whole = F.when((F.col("copies") > 1) & (F.col("n_words") >= PASSAGE), F.array(F.struct(F.lit(0).alias("first"), (F.col("n_words") - 1).alias("last"))))
    none = F.array().cast("array<struct<first:int,last:int>>")
    per = per.join(named_classes, "root").select("t", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(whole, "spans", none).alias("spans"))
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), name_of(docs["text"]).alias("t")).join(per, "t", "left")
    spans = F.coalesce("spans", none)
    n_marked = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return out.select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), spans.alias("spans"), n_marked.alias("n_marked"), F.coalesce("class_id", "doc_id").alias("class_id"))
