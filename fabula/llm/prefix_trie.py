"""The trie of conversation prefixes, by truncation peeling.

Equal conversations are merged first. Then, from the greatest depth down: the conversations that end at this depth join the nodes that survive from below, each
stripped of its last turn, and all are grouped by the path they have now. A group is a node: its counts, children, leaves and sums are those of what met, so
every level is discovered and aggregated at once, in one pass over the depths. A level is one grouping with partial aggregates, so a first turn that a third of
all conversations share is combined before the shuffle. Deep levels that few conversations reach are peeled together: while the turns on them are at most
`band` in all (a count that is known beforehand), they are grouped by their path at the band's foot, and each group peels its levels alone.

A path is a chain of SHA-256 digests of (role, text), so texts of any length travel as 32 bytes, and the key of a node is the last link. Levels are tables in the shared folder.

Defined results: turns in order of `turn`, null first, equal ones by the digest of role and text; null role or text is empty; repeated rows are turns each; rows with a null
conv_id take no part; a conversation is one row of digests (its texts are not gathered); an empty table has no root; other columns are ignored. Digests of a node's members are
taken over a stream of sorted pieces of text, made where the ids lie, so that copies of one conversation never fill a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BAND = 100_000
#: Levels from here up are always groupings of their own: their paths may be shared by any number of conversations.
SHALLOW = 4
#: Ids in one piece of a node's list of members.
PIECE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
_PATH = "keys array<binary>, sizes array<int>"
_PART = f"depth int, {_PATH}, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string"
_NODE = f"key binary, parent binary, {_PART}"
FIELDS = [f.split()[0] for f in _PART.split(", ")]


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turns): digests and code points of the turns in order."""
    role, text = (F.coalesce(messages[c], F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = messages.where(messages["conv_id"].isNotNull()).select(messages["conv_id"].cast("long").alias("conv_id"), messages["turn"].alias("turn"), digest.alias("digest"), F.length(text).alias("size"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns"))


def rebuilt(convs: DataFrame, share: Column | None = None, block: int = 100, longest: int = 5) -> DataFrame:
    """Each conversation with its first `share` turns (0 to `longest`) replaced by those of the first of its block of ids; by default crc32 of its decimal id, modulo 6."""
    convs = convs.withColumn("share", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6 if share is None else share)
    heads = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, longest).alias("head"))
    met = convs.join(heads, F.col("conv_id") - F.col("conv_id") % block == F.col("base"), "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("share"))
    own = F.slice("turns", F.col("share") + 1, F.greatest(F.size("turns") - F.col("share"), F.lit(0)))
    return met.select("conv_id", F.concat(head, own).alias("turns"))


def _chained(batches: Iterator) -> Iterator:
    """Keys of all prefixes of each row of digests."""
    import pyarrow as pa

    for batch in batches:
        keys = []
        for digests in batch["digests"].to_pylist():
            key, links = b"", []
            for digest in digests:
                key = hashlib.sha256(key + digest).digest()
                links.append(key)
            keys.append(links)
        yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(keys, pa.list_(pa.binary())), batch["sizes"]], names=["conv_id", "keys", "sizes"])


def _last(items: str, other) -> Column:
    return F.coalesce(F.try_element_at(items, F.lit(-1)), F.lit(other))


def _pieces(batches: Iterator) -> Iterator:
    """Sorted (key, conv_id) to (key, first id, ids as text), some thousand ids a piece."""
    import pyarrow as pa

    key, ids = None, []
    done: list[tuple] = []
    for batch in batches:
        for k, c in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist()):
            if ids and (k != key or len(ids) == PIECE):
                done.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*done)) or [[]] * 3, (pa.binary(), pa.int64(), pa.string()))], names=["key", "first", "ids"])
        done = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["key", "first", "ids"])


def _digested(batches: Iterator) -> Iterator:
    """Sorted pieces to (key, SHA-256 of all ids of the key)."""
    import pyarrow as pa

    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
            if state is not None and k == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["key", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])


def ended(paths: DataFrame) -> DataFrame:
    """Equal conversations merged: what ends at each depth, with the digest of its members' ids."""
    paths = materialize(paths.withColumn("key", _last("keys", b"")), "trie-paths")
    one = paths.groupBy("key").agg(F.size(F.first("keys")).alias("depth"), F.first("keys").alias("keys"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    one = materialize(one.sortWithinPartitions("depth"), "trie-merged")
    members = paths.select("key", "conv_id").join(one.where("n_convs > 1").select("key"), "key", "left_semi")
    pieces = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first long, ids string")
    digests = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digested, "key binary, ends string")
    several = one.where("n_convs > 1").join(digests, "key", "left")
    out = one.where("n_convs = 1").withColumn("ends", F.sha2(F.col("conv_id").cast("string"), 256)).unionByName(several)
    zero = F.lit(0).cast("long")
    out = out.withColumns({"n_children": zero, "n_leaves": zero, "saved": zero}).select(*FIELDS)
    return materialize(out.sortWithinPartitions("depth"), "trie-ended")


def stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of `depth` as parts of the level above."""
    cut = [F.slice(c, 1, depth - 1).alias(c) for c in ("keys", "sizes")]
    return nodes.where(F.col("depth") == depth).select(F.lit(depth - 1).alias("depth"), *cut, "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved", F.lit(None).cast("string").alias("ends"))


def level(parts: DataFrame, depth: int) -> DataFrame:
    """One level: parts grouped by their path."""
    one = parts.groupBy(_last("keys", b"").alias("key")).agg(
        *[F.first(c).alias(c) for c in ("keys", "sizes")], F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    )
    parent = F.coalesce(F.try_element_at("keys", F.lit(depth - 1)), F.lit(b"")) if depth > 1 else F.lit(b"" if depth else None).cast("binary")
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves")
    saved = F.col("saved") + (F.col("n_convs") - 1) * _last("sizes", 0)
    return one.select("key", parent.alias("parent"), F.lit(depth).alias("depth"), "keys", "sizes", "conv_id", "n_convs", "n_children", leaves, saved.alias("saved"), F.coalesce("ends", F.lit(EMPTY)).alias("ends"))


def peel(parts: list[tuple], foot: int) -> Iterator[tuple]:
    """The nodes deeper than `foot` of parts (FIELDS): the same as `level`, level by level, for a bounded group."""
    waiting: dict[int, list[tuple]] = {}
    for part in parts:
        waiting.setdefault(part[0], []).append(part)
    frontier: list[tuple] = []
    for depth in range(max(waiting, default=foot), foot, -1):
        met: dict[bytes, list] = {}
        for _, keys, sizes, conv, n, children, leaves, saved, ends in frontier + waiting.pop(depth, []):
            node = met.setdefault(keys[depth - 1], [keys, sizes, conv, 0, 0, 0, 0, None])
            node[2] = min(node[2], conv)
            for k, x in enumerate((n, children, leaves, saved), 3):
                node[k] += x
            node[7] = ends or node[7]
        frontier = []
        for key, (keys, sizes, conv, n, children, leaves, saved, ends) in met.items():
            leaves, saved = leaves if children else 1, saved + (n - 1) * sizes[depth - 1]
            kept = (keys[:depth], sizes[:depth]) if depth == foot + 1 else ([], [])
            yield key, keys[depth - 2] if depth > 1 else b"", depth, *kept, conv, n, children, leaves, saved, ends or EMPTY
            frontier.append((depth - 1, keys, sizes, conv, n, 1, leaves, saved, None))


def _band(foot: int):
    def peeled(table):
        import pyarrow as pa

        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}
        nodes = list(peel(list(zip(*[table[c].to_pylist() for c in FIELDS])), foot))
        names = [f.split() for f in _NODE.split(", ")]
        return pa.table([pa.array([n[k] for n in nodes], kinds[kind]) for k, (_, kind) in enumerate(names)], names=[name for name, _ in names])

    return peeled


def bands(lengths: dict[int, int], band: int, shallow: int) -> list[tuple[int, int]]:
    """(top, foot): levels top to foot + 1 together, from the deepest down, from the number of sequences of each length."""
    alive, n = {}, 0
    for d in range(max(lengths), -1, -1):
        n += lengths.get(d, 0)
        alive[d] = n
    out, top = [], max(lengths)
    while top >= 0:
        foot, turns = top - 1, alive[top]
        while foot > shallow and turns + alive[foot] <= band:
            turns += alive[foot]
            foot -= 1
        out.append((top, foot))
        top = foot
    return out


def trie(paths: DataFrame, band: int = BAND, shallow: int = SHALLOW) -> DataFrame:
    """The nodes of paths(conv_id, keys, sizes)."""
    ends = ended(paths)
    lengths = {r.depth: r.n for r in ends.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # as many rows as there are lengths
    nodes: list[DataFrame] = []
    for top, foot in bands(lengths, band, shallow) if lengths else []:
        parts = ends.where((F.col("depth") <= top) & (F.col("depth") > foot))
        if nodes:
            parts = parts.unionByName(stripped(nodes[-1], top + 1))
        if top - foot == 1:
            found = level(parts, top)
        else:
            at = F.element_at("keys", foot) if foot > 0 else F.lit(b"")
            found = parts.groupBy(at.alias("at")).applyInArrow(_band(foot), _NODE)
        nodes.append(materialize(found, f"trie-{top}"))
    if not nodes:
        return ends.select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved", "ends")
    every = nodes[0].drop("keys", "sizes")
    for level_nodes in nodes[1:]:
        every = every.unionByName(level_nodes.drop("keys", "sizes"))
    above = every.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return every.join(above, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")


def prefix_trie(messages: DataFrame, band: int = BAND, shallow: int = SHALLOW, rebuild=rebuilt) -> DataFrame:
    """A row for each distinct prefix of the (rebuilt) conversations of messages(conv_id, turn, role, text)."""
    convs = rebuild(conversations(messages))
    flat = convs.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))
    out = trie(flat.mapInArrow(_chained, f"conv_id long, {_PATH}"), band, shallow)
    long = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves")]
    return out.select(*long, F.col("saved").cast("long").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
