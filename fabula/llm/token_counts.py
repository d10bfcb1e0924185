"""Token counts without encoding: whole-token shortcut.

Offline, once per vocabulary, the library itself is asked which vocabulary strings it encodes, alone, as one token. A text is then cut into pre-tokens that
no merge can cross; a pre-token that is such a string counts one at once, and only the others are merged, by the library, each on its own. Counts of
pre-tokens add up to the count of the text.

A sentencepiece model (.model) is cut before each run of spaces. That is only exact if no vocabulary string has a space after another character, if its
normaliser changes nothing but spaces, and if nothing in a text stands for a special piece; all three are proved on the model when it is opened, else its texts
are encoded whole. A byte-level BPE of the tokenizers library (.json) is cut by its own pre-tokenizer; a text that holds the string of an added token is
encoded whole, as the library then cuts it there first.

Each text is a row of one Arrow pass: no shuffle, no state but two bounded tables for each worker. Texts of any length are counted whole; null and empty
texts have no tokens; repeated rows are counted each; a null doc_id stays; there are no ties; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
#: Counts of merged pre-tokens that a worker keeps.
KEPT = 400_000
_SPACED = re.compile(" +[^ ]*")


class Counts(dict):
    """Pre-token: tokens. Merges what it has not met, and keeps up to KEPT of those."""

    def __init__(self, merge) -> None:
        self.merge = merge

    def __missing__(self, token: str) -> int:
        n = self.merge(token)
        if len(self) < KEPT:
            self[token] = n
        return n


class PieceCounter:
    """Of a sentencepiece model. A pre-token is written without its first space."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = SentencePieceProcessor(model_file=path)
        model = proto.ModelProto.FromString(self.library.serialized_model_proto())
        rule, kinds, names = model.normalizer_spec, proto.ModelProto.SentencePiece, [p.piece for p in model.pieces]
        plain = not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
        is_bpe = model.trainer_spec.model_type == proto.TrainerSpec.BPE
        self.cuts = plain and is_bpe and not any(p.type == kinds.USER_DEFINED or re.search("[^▁]▁", p.piece) for p in model.pieces)
        alone = [name[1:].replace("▁", " ") for name in names if name[:1] == "▁"]
        self.whole = frozenset(a for a, n in zip(alone, self.tokens(alone)) if n == 1)
        if self.tokens(["a", "a "]) == [1, 2]:  # a last space, which the library encodes as nothing when alone
            self.whole |= {""}
        else:
            self.cuts = False
        self.merged = Counts(lambda token: len(self.library.encode(token)))

    def tokens(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, pre-tokens that were whole tokens)"""
        if not text or not self.cuts:
            return len(self.library.encode(text)), 0
        if "▁" in text:
            text = text.replace("▁", " ")
        parts = text.split(" ")
        if "" in parts:
            parts = [part[1:] for part in _SPACED.findall(" " + text)]
        rest = [part for part in parts if part not in self.whole]
        return len(parts) - len(rest) + sum(map(self.merged.__getitem__, rest)), len(parts) - len(rest)


class ByteCounter:
    """Of a byte-level BPE in the tokenizers library's format."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        model = self.library.model
        self.whole = frozenset(s for s in self.library.get_vocab(with_added_tokens=False) if len(model.tokenize(s)) == 1)
        self.merged = Counts(lambda token: len(model.tokenize(token)))

    def count(self, text: str) -> tuple[int, int]:
        if any(a in text for a in self.added):
            return len(self.library.encode(text, add_special_tokens=False).ids), 0
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        parts = [part for part, _ in self.library.pre_tokenizer.pre_tokenize_str(text)] if text else []
        rest = [part for part in parts if part not in self.whole]
        return len(parts) - len(rest) + sum(map(self.merged.__getitem__, rest)), len(parts) - len(rest)


@cache
def counter(path: str) -> PieceCounter | ByteCounter:
    return (PieceCounter if path.endswith(".model") else ByteCounter)(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_whole: tokens of each whole text, and how many of them the shortcut counted."""

    def counted(batches):
        import pyarrow as pa

        count = counter(path).count
        for batch in batches:
            n = [count(text) for text in batch["text"].to_pylist()]
            columns = [batch["doc_id"], batch["n_bytes"], pa.array([a for a, _ in n], pa.int64()), pa.array([b for _, b in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "n_whole"])

    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, n_whole long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_whole")
