"""Pairs of works compared a block at a time: Spark deals query works and works out by block, and numpy compares a query work with many works at once.

The rules are those of compare.with_scores, best_matches, isomorphism, lcs_length and tension_score, in the same order of additions, so results are equal to the last bit.
A task holds the query works of a block and some of its works. Only the columns asked for are made and handed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..lexicon import REGISTER_DISTANCE, ROLES
from .compare import BEST, BLOCKS, MATCH, VERDICTS, WEIGHTS
from .extract import MODALITIES

#: Works that a query work is compared with at once, and rows of a batch that is handed on.
WORKS, ROWS = 8_000, 20_000
#: Works that a query work is bounded against at once.
AT_ONCE = 10_000
#: Pairs of nodes that are counted in an array of their own, not by sorting.
FLAT = 1_000_000
#: Bits of a word of a sequence.
BITS = 62
MATCHES = "array<struct<cand_pos:int,cand_code:string,ref_pos:int,ref_code:string,similarity:double>>"
#: Columns of a pair that are text or whole numbers; the others are doubles.
KINDS = {"lcs": "int", "n_points": "int", "alignment": "string", "modality": "string", "srj_level": "string", "verdict": "string", "warnings": "string", "verdict_text": "string"}
#: What a column is made of: columns of a work, or of a pair.
_PARTS = {
    "s_iso": ["nodes"], "lcs": ["plain"], "s_tens": ["curves"], "s_ged": ["codes", "n_nodes"], "s_func": ["codes", "plain"], "s_chain": ["actant_sums"],
    "roles": ["role_sets", "role_sets_v2"], "s_greimas": ["roles"], "alignment": ["roles"], "s_act": ["s_chain", "s_greimas"], "sns": [n for n, _ in WEIGHTS], "sns_normalized": ["sns"], "ss": ["sns"],
    "structure_delta": ["s_iso"], "form_delta": ["form"], "register_delta": ["form"], "focus_delta": ["lead"], "moral_delta": ["form", "codes"], "st": [f"{d}_delta" for d in ("structure", "form", "register", "focus", "moral")],
    "modality": ["s_iso", "s_func", "s_tens", "n_nodes"], "srj": ["sns", "ss", "modality"], "srj_level": ["srj"], "verdict": ["sns"], "verdict_text": ["verdict", "ss", "modality"], "warnings": ["sns", "n_nodes", "codes"],
    "n_points": ["curve_totals"], "ref_sum": ["curve_totals"], "cand_sum": ["curve_totals"],
}
#: Columns that works may lack.
_MAY_LACK = ("role_sets", "role_sets_v2", "lead", "form")
MODES = ("none", "partial", "amplification", "condensation", "inversion", "transposition", "hybridation")
LEVELS = ("Faible", "Modéré", "Élevé", "Critique")
VERDICT_NAMES = ("different", "conventional", "notable", "close")
NOTES = ("high_score", "short_text", "few_functions")
LABELS = (*(f"v{i + 1}↔v{j + 1}" for i in (0, 1) for j in (0, 1)), "indisponible")
_NEAR = {frozenset((a, b)): d for a, b, d in REGISTER_DISTANCE}


def columns_for(wanted: list[str], have: list[str]) -> list[str]:
    """Columns of a work that the wanted columns of a pair are made of."""
    found, todo = [], list(wanted)
    while todo:
        name = todo.pop().removesuffix("_share")
        if name in _PARTS:
            todo += _PARTS[name]
        elif name not in found and (name in have or name not in _MAY_LACK):
            found.append(name)
    return found


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds doubles: halves of their shortest decimal form away from zero."""
    scale = 10.0**digits
    y = x * scale
    whole = np.rint(y)
    rest = np.abs(y - whole)
    out = whole / scale + 0.0
    half = 0.5 - 1e-7 - 4e-16 * np.abs(y).max(initial=0.0)
    if rest.max(initial=0.0) > half:
        for i in np.flatnonzero(rest > half):
            out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def _ids(*columns: pa.Array) -> list[np.ndarray]:
    """Equal strings of the columns as equal numbers; null: -1."""
    ids = pa.chunked_array(columns, pa.string()).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(ids, np.cumsum([len(c) for c in columns])[:-1])


def _starts(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


def _kinds(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct row, the number of each row's)."""
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values, at = np.unique(c, return_inverse=True)
        key = np.unique(key * max(1, len(values)) + at.ravel(), return_inverse=True)[1].ravel()
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    return first, of.ravel()


class _Postings:
    """For each of n ids its distinct holders."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, n: int):
        pairs = np.unique(np.stack([ids, owner]), axis=1) if len(ids) else np.zeros((2, 0), np.int64)
        self.holders, self.starts = pairs[1], np.searchsorted(pairs[0], np.arange(n + 1))

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(holders of all the ids, how many each has)."""
        a, b = self.starts[ids], self.starts[ids + 1]
        return self.holders[_ranges(a, b)], b - a


class _Side:
    """The works of one side as flat arrays."""

    def __init__(self, t: pa.Table):
        self.table, self.ids, self.n = t, t["work_id"].to_numpy(), len(t)

    def col(self, name: str) -> pa.Array:
        return self.table[name].combine_chunks()

    @cached_property
    def flat(self) -> pa.Array:
        return self.col("nodes").flatten()

    def field(self, name: str) -> pa.Array:
        return pc.struct_field(self.flat, name)

    @cached_property
    def at(self) -> np.ndarray:
        return _starts(self.col("nodes"))

    @cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.at))

    def number(self, name: str) -> np.ndarray:
        return self.field(name).to_numpy(zero_copy_only=False)

    @cached_property
    def numbers(self) -> list[np.ndarray]:
        """Modalities, length of their vector, tension."""
        return [self.number(m) for m in (*MODALITIES, "norm", "tension")]

    @cached_property
    def pos(self) -> np.ndarray:
        return self.number("pos")

    @cached_property
    def names(self) -> pa.Array:
        return self.field("names").flatten()

    @cached_property
    def name_owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.flat)), np.diff(_starts(self.field("names"))))

    @cached_property
    def plain(self) -> pa.Array:
        return self.col("plain").flatten()

    @cached_property
    def plain_at(self) -> np.ndarray:
        return _starts(self.col("plain"))

    @cached_property
    def codes_at(self) -> np.ndarray:
        return _starts(self.col("codes"))

    @cached_property
    def n_nodes(self) -> np.ndarray:
        return self.table["n_nodes"].to_numpy() if "n_nodes" in self.table.column_names else np.diff(self.at)

    @cached_property
    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        return _padded(self.col("actant_sums"))

    @cached_property
    def curve_at(self) -> np.ndarray:
        return _starts(self.col("curves"))

    @cached_property
    def points(self) -> np.ndarray:
        return np.diff(self.curve_at)

    @cached_property
    def _curves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        made = self.col("curves").flatten()
        centred = pc.struct_field(made, "centred")
        return centred.flatten().to_numpy(zero_copy_only=False), _starts(centred), pc.struct_field(made, "norm").to_numpy(zero_copy_only=False)

    def curve(self, works: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The centred curves of n points of the works, a row for each point, and their norms."""
        flat, at, norm = self._curves
        k = self.curve_at[works] + n - 1
        return flat[at[k] + np.arange(n)[:, None]], norm[k]

    @cached_property
    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        return _starts(self.col("curve_totals")), self.col("curve_totals").flatten().to_numpy(zero_copy_only=False)

    @cached_property
    def form(self) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """(form, size, register, told: -1 for null, moral: -1 for null); what a missing form counts as."""
        if "form" not in self.table.column_names:
            none = pa.array([""] * self.n, pa.string())
            return none, np.full(self.n, 3), none, np.full(self.n, -1), np.full(self.n, -1)
        s = self.col("form")
        text = lambda name: pc.struct_field(s, name).fill_null("")
        flag = lambda name: pc.struct_field(s, name).cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False)
        return text("form_key"), pc.struct_field(s, "size").fill_null(3).to_numpy(zero_copy_only=False), text("register_key"), flag("told"), flag("moral")

    def roles(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(known, blank, sizes, words, place of each word's role): role_sets() of the works, six roles each."""
        lists = self.col(name)
        known, flat = lists.is_valid().to_numpy(zero_copy_only=False), lists.flatten()
        blank, words = pc.struct_field(flat, "blank").to_numpy(zero_copy_only=False), pc.struct_field(flat, "words")
        n, place = np.zeros((self.n, len(ROLES)), np.int64), np.flatnonzero(np.repeat(known, len(ROLES)))
        out, sizes = np.zeros(n.shape, bool), np.diff(_starts(words))
        out.ravel()[place], n.ravel()[place] = blank, sizes
        return known, out, n, words.flatten(), np.repeat(place, sizes)


def _padded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, rows of up to three numbers, padded by 0)."""
    at, flat = _starts(lists), lists.flatten().to_numpy(zero_copy_only=False)
    n, out = np.diff(at), np.zeros((len(at) - 1, 3))
    for i in range(3):
        out[n > i, i] = flat[at[:-1][n > i] + i]
    return n, out


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is not above 0."""
    return np.divide(a, b, out=np.zeros(len(b)), where=b > 0)


class _Nodes:
    """Nodes of the query works against those of the works.

    What nodes give without their names depends on few kinds of nodes, so it is found once for each pair of kinds, and a query node meets each kind with each tension once;
    names raise it where both have a code or family in common, which the holders of a name show.
    """

    def __init__(self, q: _Side, w: _Side):
        self.q, self.w = q, w
        (self.qc, self.wc), (self.qf, self.wf), (self.qp, self.wp) = (_ids(q.field(n), w.field(n)) for n in ("code", "family", "phase"))
        qn, wn = _ids(q.names, w.names)
        self.names = _Postings(wn, w.name_owner, int(max(qn.max(initial=-1), wn.max(initial=-1))) + 1)
        pairs = np.unique(np.stack([q.name_owner, qn]), axis=1) if len(qn) else np.zeros((2, 0), np.int64)
        self.q_name, self.q_name_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.qc) + 1))
        self.n_names = np.bincount(self.names.holders, minlength=len(self.wc))
        # Kinds of nodes, and kinds with a tension.
        place, kind = _kinds(self.wc, self.wf, self.wp, *w.numbers[:5])
        self.kind, self.kind_at = kind, place
        shape_at, self.shape = _kinds(kind, w.numbers[5])
        self.shape_kind, self.shape_tension = kind[shape_at], w.numbers[5][shape_at]
        self.q_place, self.q_kind = _kinds(self.qc, self.qf, self.qp, *q.numbers[:5])
        self.made: dict[int, tuple] = {}
        _, code_of, times = np.unique(np.stack([w.owner, self.wc]), axis=1, return_inverse=True, return_counts=True) if len(self.wc) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.weight = np.where(self.wc < 0, 1.0, 1.0 / np.sqrt(times[code_of.ravel()].astype(float)))
        self.every = np.bincount(w.owner, self.weight, w.n)

    def of_kind(self, kind: int) -> tuple[np.ndarray, ...]:
        """What a kind of query nodes gives with each kind of nodes: (similarity without names for tensions apart, then for near ones; whether code or family are the same; 0.60 or 0.15; phase; modalities)."""
        if kind not in self.made:
            r, at = self.q_place[kind], self.kind_at
            phase = np.where((self.wp[at] == self.qp[r]) & (self.qp[r] >= 0), 0.10, 0.0)
            same, kin = (self.wc[at] == self.qc[r]) & (self.qc[r] >= 0), (self.wf[at] == self.qf[r]) & (self.qf[r] >= 0)
            base, norm, dot = np.where(same, 0.60, 0.15), self.w.numbers[4][at], np.zeros(len(at))
            if (mine := self.q.numbers[4][r]) > 0:
                for a, b in zip(self.q.numbers[:4], self.w.numbers[:4], strict=True):
                    dot = dot + a[r] * b[at]
                dot = np.divide(dot, mine * norm, out=np.zeros(len(at)), where=norm > 0)
            modal = 0.05 * dot
            sims = [np.where(same | kin, base + phase + tension + modal, phase + tension) for tension in (0.0, 0.05)]
            self.made[kind] = (np.concatenate(sims), same | kin, base, phase, modal)
        return self.made[kind]

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node of the works, the query work's most similar node (ties: the first) and the similarity."""
        start, end = self.q.at[k], self.q.at[k + 1]
        n, tension = len(self.shape_kind), self.q.numbers[5]
        best, back, far = np.full(n, -1.0), np.zeros(n, np.int64), len(self.kind_at)
        for r in range(start, end):
            near = np.abs(tension[r] - self.shape_tension) < 0.15
            sim = self.of_kind(self.q_kind[r])[0][self.shape_kind + far * near]
            better = sim > best
            np.copyto(best, sim, where=better)
            back[better] = r
        best, back = best[self.shape], back[self.shape]
        mine = slice(self.q_name_at[start], self.q_name_at[end])
        if mine.start < mine.stop:
            nodes, times = self.names.of(self.q_name[mine])
            r = np.repeat(np.repeat(np.arange(start, end), np.diff(self.q_name_at[start : end + 1])), times)
            known = np.stack([self.of_kind(x)[1] for x in self.q_kind[start:end]])
            met = known[r - start, self.kind[nodes]]
            keys, size = (r[met] - start) * len(self.wc) + nodes[met], (end - start) * len(self.wc)
            if size <= FLAT:
                times = np.bincount(keys, minlength=size)
                keys = np.flatnonzero(times)
                times = times[keys]
            else:
                keys, times = np.unique(keys, return_counts=True)
            r, nodes = keys // max(1, len(self.wc)) + start, keys % max(1, len(self.wc))
            cuts = np.searchsorted(r, np.arange(start, end + 1))
            for i in range(start, end):
                part = slice(cuts[i - start], cuts[i - start + 1])
                if part.start == part.stop:
                    continue
                at, shared, (_, _, base, phase, modal) = nodes[part], times[part], self.of_kind(self.q_kind[i])
                kind, names = self.kind[at], self.q_name_at[i + 1] - self.q_name_at[i]
                sim = base[kind] + 0.20 * (shared / (names + self.n_names[at] - shared)) + phase[kind] + np.where(np.abs(tension[i] - self.w.numbers[5][at]) < 0.15, 0.05, 0.0) + modal[kind]
                better = (sim > best[at]) | (sim == best[at]) & (i < back[at])
                best[at[better]], back[at[better]] = sim[better], i
        return back, best

    def iso(self, best: np.ndarray) -> np.ndarray:
        return _over(np.bincount(self.w.owner, np.where(best >= MATCH, self.weight, 0.0), self.w.n), self.every)


class _Sequences:
    """Longest common subsequences of plain codes: a work's distinct sequence is a row of bits, a step of the query work's sequence moves those of all works at once."""

    def __init__(self, q: _Side, w: _Side):
        self.q_at, (self.qs, ws) = q.plain_at, _ids(q.plain, w.plain)
        codes, seen, self.which, at = ws.tolist(), {}, np.empty(w.n, np.int64), w.plain_at.tolist()
        for k in range(w.n):
            self.which[k] = seen.setdefault(tuple(codes[at[k] : at[k + 1]]), len(seen))
        sizes, n_codes = np.array([len(x) for x in seen], np.int64), int(ws.max(initial=-1)) + 1
        words, self.sizes, self.groups = np.maximum(1, -(-sizes // BITS)), sizes, []
        lists, self.n_codes = list(seen), n_codes
        for n in np.unique(words):
            rows = np.flatnonzero(words == n)
            masks = np.zeros((n_codes, n, len(rows)), np.int64)
            for i, x in enumerate(rows):
                for j, c in enumerate(lists[x]):
                    masks[c, j // BITS, i] |= 1 << j % BITS
            left = np.clip(sizes[rows] - BITS * np.arange(n)[:, None], 0, BITS)
            self.groups.append((rows, masks, (np.int64(1) << left) - 1))

    def of(self, k: int) -> np.ndarray:
        out, mine = np.zeros(len(self.sizes), np.int64), self.qs[self.q_at[k] : self.q_at[k + 1]]
        mine = mine[mine < self.n_codes]
        for rows, masks, full in self.groups:
            row, top = full.copy(), np.int64((1 << BITS) - 1)
            if len(full) == 1:
                row = row[0]
                for c in mine:
                    u = row & masks[c, 0]
                    row = ((row + u) | (row ^ u)) & top
                ones = np.bitwise_count(row & full[0])
            else:
                for c in mine:
                    carry = np.zeros(len(rows), np.int64)
                    for i in range(len(full)):
                        u = row[i] & masks[c, i]
                        total = row[i] + u + carry
                        row[i] = (total & top) | (row[i] ^ u)
                        carry = total >> BITS
                ones = np.bitwise_count(row & full).sum(axis=0)
            out[rows] = self.sizes[rows] - ones
        return out[self.which].astype(np.int32)


class _Tensions:
    """Pearson of the curves of as many points as both works have."""

    def __init__(self, q: _Side, w: _Side):
        self.q, self.w, self.groups = q, w, {}

    def group(self, n: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if (n, last) not in self.groups:
            works = np.flatnonzero(self.w.points >= n if last else self.w.points == n)
            self.groups[n, last] = (works, *self.w.curve(works, n))
        return self.groups[n, last]

    def of(self, k: int) -> np.ndarray:
        points = self.q.points[k]
        out = np.where(np.minimum(self.w.points, points) > 0, 0.5, 0.0)
        for n in range(3, points + 1):
            works, curve, norm = self.group(n, n == points)
            if not len(works):
                continue
            mine, (my_norm,) = self.q.curve(np.array([k]), n)
            num = np.zeros(len(works))
            for i in range(n):
                num = num + mine[i, 0] * curve[i]
            down = my_norm * norm
            out[works] = np.where((norm == 0) | (my_norm == 0), 0.5, (np.divide(num, down, out=np.zeros(len(num)), where=down != 0) + 1) / 2)
        return out


class _Roles:
    """role_match() and focus_of(): words of roles are met by their holders."""

    def __init__(self, q: _Side, w: _Side):
        have = [n for n in ("role_sets", "role_sets_v2") if n in q.table.column_names]
        self.w, self.have, self.sides = w, have, [[s.roles(n) for n in have] for s in (q, w)]
        if not have:
            return
        ids = _ids(*[x[3] for side in self.sides for x in side])
        n = max((int(x.max(initial=-1)) for x in ids), default=-1) + 1
        mine, theirs = ids[: len(have)], ids[len(have) :]
        self.words = [(x, np.searchsorted(s[4], np.arange(q.n * len(ROLES) + 1))) for x, s in zip(mine, self.sides[0], strict=True)]
        self.held = [[_Postings(x[s[4] % len(ROLES) == r], s[4][s[4] % len(ROLES) == r] // len(ROLES), n) for r in range(len(ROLES))] for x, s in zip(theirs, self.sides[1], strict=True)]
        self.all_blank = [[bool(s[1][:, r].all()) for r in range(len(ROLES))] for s in self.sides[1]]

    def one(self, k: int, i: int, j: int) -> np.ndarray:
        """role_similarity() of the query work's version i with the works' version j."""
        (known, blank, size, _, _), (w_known, w_blank, w_size, _, _) = self.sides[0][i], self.sides[1][j]
        if not known[k]:
            return np.zeros(self.w.n)
        total, n, (words, at) = np.zeros(self.w.n), np.zeros(self.w.n, np.int64), self.words[i]
        for r in range(len(ROLES)):
            if blank[k, r]:
                both = True if self.all_blank[j][r] else w_blank[:, r]
                total, n = total + 0.5 * both, n + both
            elif size[k, r]:
                mine = words[at[k * len(ROLES) + r] : at[k * len(ROLES) + r + 1]]
                holders, _ = self.held[j][r].of(mine)
                met = np.bincount(holders, minlength=self.w.n)
                told = w_size[:, r] > 0
                total, n = total + np.where(told, met / (size[k, r] + w_size[:, r] - met), 0.0), n + told
        return np.where(w_known, total / np.maximum(n, 1), 0.0)

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, place in LABELS)."""
        if not self.have:
            return np.full(self.w.n, 0.5), np.full(self.w.n, 4)
        two = len(self.have) > 1
        made = {(i, j): self.one(k, i, j) for i in range(len(self.have)) for j in range(len(self.have))}
        scores = np.stack([made[i * two, j * two] for i in (0, 1) for j in (0, 1)])
        label = scores.argmax(axis=0)
        missing = ~np.any([s[0][k] for s in self.sides[0]]) | ~np.any([s[0] for s in self.sides[1]], axis=0)
        return np.where(missing, 0.5, scores.max(axis=0)), np.where(missing, 4, label)


class _Pair:
    """One query work with all works of a part: columns by name, made when they are asked for."""

    def __init__(self, part: _Part, k: int):
        self.part, self.k, self.made, self.q, self.w = part, k, {}, part.q, part.w

    def __getitem__(self, name: str) -> np.ndarray:
        """name_share: what the score of that name adds to sns."""
        if name not in self.made:
            score = name.removesuffix("_share")
            self.made[name] = dict(WEIGHTS)[score] * self[score] if score != name else getattr(self, name)()
        return self.made[name]

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        return self.part.nodes.of(self.k)

    def s_iso(self):
        return self.part.nodes.iso(self["nodes"][1])

    def lcs(self):
        return self.part.sequences.of(self.k)

    def s_tens(self):
        return self.part.tensions.of(self.k)

    def s_ged(self):
        q, w, k, (mine, has, distinct) = self.q, self.w, self.k, self.part.code_sets
        shared = np.zeros(w.n, np.int64)
        for c in mine[k]:
            if c < len(has):
                shared += has[c]
        n, size = len(mine[k]), np.maximum(q.n_nodes[k], w.n_nodes)
        made = _over(shared, distinct + n - shared) * (1 - 0.3 * np.abs(q.n_nodes[k] - w.n_nodes) / np.maximum(size, 1))
        made = np.where((distinct == 0) & (n == 0), 0.5, np.where((distinct == 0) | (n == 0), 0.0, made))
        return np.where((q.n_nodes[k] == 0) | (w.n_nodes == 0), 0.0, made)

    def func_of(self, lcs: np.ndarray) -> np.ndarray:
        """S_FUNC of common subsequences so long."""
        plain, theirs = self.q.plain_at[self.k + 1] - self.q.plain_at[self.k], self.part.n_plain
        score = np.sqrt(lcs / np.maximum(np.maximum(plain, theirs), 1))
        empty = (self.part.n_codes == 0) | (self.q.codes_at[self.k] == self.q.codes_at[self.k + 1])
        return np.where(empty, 0.0, np.where((plain == 0) | (theirs == 0), 0.5, score))

    def s_func(self):
        return self.func_of(self["lcs"])

    def s_chain(self):
        (n, sums), k = self.q.sums, self.k
        at, place, b = self.part.sums_of(int(n[k]))
        a = sums[k][place]
        return np.where(at > 0, np.minimum(a, b) / np.maximum(np.maximum(a, b), 1), 0.0)

    def roles(self):
        return self.part.roles.of(self.k)

    def s_greimas(self):
        return self["roles"][0]

    def alignment(self):
        return self["roles"][1], LABELS

    def s_act(self):
        return (self["s_chain"] + self["s_greimas"]) / 2

    def sns(self):
        return sum(w * self[n] for n, w in WEIGHTS)

    def sns_normalized(self):
        return np.minimum(1.0, self["sns"] * 1.15)

    def ss(self):
        return np.maximum(0.0, (self["sns"] - 0.4) / 0.6)

    def structure_delta(self):
        return 1 - self["s_iso"]

    def form_delta(self):
        (mine, theirs), k = self.part.forms[0], self.k
        return (np.where(mine[k] == theirs, 0.0, 1.0) + np.abs(self.q.form[1][k] - self.w.form[1]) / 4) / 2

    def register_delta(self):
        mine, theirs, table = self.part.forms[1]
        return table[mine[self.k]][theirs]

    def focus_delta(self):
        if self.part.leads is None:
            return np.full(self.w.n, 0.5)
        words, at, held, sizes = self.part.leads
        mine = words[at[self.k] : at[self.k + 1]]
        if not len(mine):
            return np.full(self.w.n, 0.5)
        met = np.bincount(held.of(mine)[0], minlength=self.w.n)
        return np.where(sizes == 0, 0.5, 1 - _over(met, len(mine) + sizes - met))

    def moral_delta(self):
        moral, theirs = self.part.morals
        told, others = self.q.form[3][self.k], self.w.form[3]
        narrator = np.where((told < 0) | (others < 0) | (told == others), 0.0, 1.0)
        return (np.where(moral[self.k] == theirs, 0.0, 1.0) + narrator) / 2

    def st(self):
        total = self["structure_delta"]
        for d in ("form", "register", "focus", "moral"):
            total = total + self[f"{d}_delta"]
        return np.maximum(0.0, np.minimum(1.0, total / 5))

    def modality(self):
        iso, func, tens = self["s_iso"], self["s_func"], self["s_tens"]
        ratio = self.w.n_nodes / max(self.q.n_nodes[self.k], 1)
        firm = func > 0.45
        cases = [~((iso >= 0.45) & (func >= 0.35)) & (iso < 0.25), ~((iso >= 0.45) & (func >= 0.35)), (ratio > 1.4) & firm, (ratio < 0.7) & firm, (tens < 0.3) & (iso > 0.45), (iso >= 0.55) & (func >= 0.45) & (ratio > 0.8) & (ratio < 1.3), (iso < 0.55) | (func < 0.45)]
        return np.select(cases, list(range(len(MODES))), 1), MODES

    def srj(self):
        return 0.4 * self["sns"] + 0.4 * self["ss"] + np.where(self["modality"][0] == 0, 0.0, 0.1)

    def srj_level(self):
        return np.searchsorted([0.25, 0.55, 0.80], self["srj"], side="right"), LEVELS

    def verdict(self):
        return np.searchsorted([0.30, 0.50, 0.70], self["sns"], side="right"), VERDICT_NAMES

    def verdict_text(self):
        (verdict, _), (mode, _) = self["verdict"], self["modality"]
        hundredths = np.rint(rounded(rounded(self["ss"], 9), 2) * 100).astype(np.int64)
        told = [text for _, text in VERDICTS]
        names = [told[0], *(told[1] % (x / 100) for x in range(101)), *(t % m for t in told[2:] for m in MODES)]
        return np.select([verdict == 0, verdict == 1, verdict == 2], [np.zeros_like(mode), 1 + hundredths, 102 + mode], 102 + len(MODES) + mode), names

    def warnings(self):
        q, w, k = self.q, self.w, self.k
        short = (q.n_nodes[k] < 5) | (w.n_nodes < 5)
        few = q.n_nodes[k] > 0 and (q.codes_at[k + 1] - q.codes_at[k]) / max(q.n_nodes[k], 1) < 0.4
        names = [",".join(["decision_support", *(n for i, n in enumerate(NOTES) if at >> i & 1)]) for at in range(8)]
        return (self["sns"] > 0.70) + 2 * short + 4 * few, names

    def n_points(self):
        return np.minimum(self.w.totals[0][1:] - self.w.totals[0][:-1], self.q.totals[0][self.k + 1] - self.q.totals[0][self.k]).astype(np.int32)

    def _total(self, side: _Side, at: np.ndarray) -> np.ndarray:
        """NaN, a null in the result, without points."""
        n = self["n_points"]
        return np.where(n == 0, np.nan, np.append(side.totals[1], np.nan)[np.where(n == 0, 0, at + n - 1)])

    def ref_sum(self):
        return self._total(self.q, np.full(self.w.n, self.q.totals[0][self.k]))

    def cand_sum(self):
        return self._total(self.w, self.w.totals[0][:-1])


class _Part:
    """Query works with some works; what is needed of all of them is made once, when it is asked for."""

    def __init__(self, q: _Side, w: _Side):
        self.q, self.w, self.known_sums = q, w, {}

    @cached_property
    def nodes(self):
        return _Nodes(self.q, self.w)

    @cached_property
    def sequences(self):
        return _Sequences(self.q, self.w)

    @cached_property
    def tensions(self):
        return _Tensions(self.q, self.w)

    @cached_property
    def roles(self):
        return _Roles(self.q, self.w)

    @cached_property
    def n_plain(self):
        return np.diff(self.w.plain_at)

    @cached_property
    def n_codes(self):
        return np.diff(self.w.codes_at)

    @cached_property
    def code_sets(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(distinct codes of each query work, for each code which works have it, how many distinct ones these have)."""
        qc, wc = _ids(self.q.col("codes").flatten(), self.w.col("codes").flatten())
        has = np.zeros((int(wc.max(initial=-1)) + 1, self.w.n), np.int64)
        has[wc, np.repeat(np.arange(self.w.n), self.n_codes)] = 1
        return [np.unique(x) for x in np.split(qc, self.q.codes_at[1:-1])], has, has.sum(axis=0)

    def sums_of(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many sums both have, the place of the last of them, that sum of the works) for a query work with n sums."""
        if n not in self.known_sums:
            at = np.minimum(n, self.w.sums[0])
            place = np.maximum(at, 1) - 1
            self.known_sums[n] = (at, place, self.w.sums[1][np.arange(self.w.n), place])
        return self.known_sums[n]

    @cached_property
    def forms(self) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Forms as numbers, and registers as numbers with a table of their distances."""
        (a, _, b, _, _), (c, _, d, _, _) = self.q.form, self.w.form
        every = pa.chunked_array([b, d], pa.string()).combine_chunks().dictionary_encode().dictionary.to_pylist()
        far = lambda x, y: 0.5 if "" in (x, y) else 0.0 if x == y else _NEAR.get(frozenset((x, y)), 0.7)
        return _ids(a, c), (*_ids(b, d), np.array([[far(x, y) for y in every] for x in every]))

    @cached_property
    def morals(self) -> list[np.ndarray]:
        def one(s: _Side) -> np.ndarray:
            hit = pc.equal(s.col("codes").flatten(), "F49").fill_null(False).to_numpy(zero_copy_only=False)
            ends = np.bincount(np.repeat(np.arange(s.n), np.diff(s.codes_at)), hit, s.n) > 0
            return np.where(s.form[4] < 0, ends, s.form[4] > 0)

        return [one(self.q), one(self.w)]

    @cached_property
    def leads(self) -> tuple[np.ndarray, np.ndarray, _Postings, np.ndarray] | None:
        if "lead" not in self.q.table.column_names:
            return None
        cols = [s.col("lead") for s in (self.q, self.w)]
        mine, theirs = _ids(*[c.flatten() for c in cols])
        owner = [np.repeat(np.arange(len(c)), np.diff(_starts(c))) for c in cols]
        pairs = np.unique(np.stack([owner[0], mine]), axis=1) if len(mine) else np.zeros((2, 0), np.int64)
        held = _Postings(theirs, owner[1], int(max(mine.max(initial=-1), theirs.max(initial=-1))) + 1)
        return pairs[1], np.searchsorted(pairs[0], np.arange(self.q.n + 1)), held, np.bincount(held.holders, minlength=self.w.n)


class _Bounds:
    """What bounds the scores of query works with the works of a part: search.bound(), over arrays."""

    def __init__(self, part: _Part):
        self.part, q, w = part, part.q, part.w
        nodes = part.nodes
        self.qc, wc, self.qf, self.wf = nodes.qc, nodes.wc, nodes.qf, nodes.wf
        self.n_codes, self.n_families = int(max(self.qc.max(initial=-1), wc.max(initial=-1))) + 1, int(max(self.qf.max(initial=-1), self.wf.max(initial=-1))) + 1
        self.plain, names = np.zeros(self.n_codes, bool), pa.chunked_array([q.field("code"), w.field("code")]).combine_chunks().dictionary_encode().dictionary
        self.plain[:] = ~pc.starts_with(names, "FN").to_numpy(zero_copy_only=False)
        coded = wc >= 0
        (self.d_owner, self.d_code), self.d_n = np.unique(np.stack([w.owner[coded], wc[coded]]), axis=1, return_counts=True)
        self.wc, self.weight, self.every = wc, nodes.weight, nodes.every

    def of(self, pair: _Pair) -> tuple[np.ndarray, ...]:
        """(bound of S_ISO, S_GED, bound of S_FUNC, chain, bound of S_TENS) of a query work with each of the works."""
        q, w, k = pair.q, pair.w, pair.k
        mine = slice(q.at[k], q.at[k + 1])
        count = np.bincount(self.qc[mine][self.qc[mine] >= 0], minlength=self.n_codes + 1)
        family = np.zeros(self.n_families + 1, bool)
        family[self.qf[mine]] = True
        family[-1] = False
        known = (count > 0)[self.wc] | family[self.wf]
        iso = _over(np.bincount(w.owner, self.weight * known, w.n), self.every)
        common = np.bincount(self.d_owner, np.minimum(count[self.d_code], self.d_n) * self.plain[self.d_code], w.n)
        points = np.minimum(q.points[k], w.points)
        return iso, pair["s_ged"], pair.func_of(common), pair["s_chain"], np.where(points == 0, 0.0, np.where(points < 3, 0.5, 1.0))


def _sum(parts, roles: float) -> np.ndarray:
    iso, ged, func, chain, tens = parts
    return sum(w * x for (_, w), x in zip(WEIGHTS, (iso, ged, func, (chain + roles) / 2, tens), strict=True))


def _best(owner: np.ndarray, n: int, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, starts): for each of n works, its nodes that match, the k most similar ones in order (ties: the earlier one), as compare.correspondences()."""
    hits = np.flatnonzero(best >= MATCH)
    hits = hits[np.lexsort((-best[hits], owner[hits]))]
    starts = np.searchsorted(owner[hits], np.arange(n + 1))
    hits = hits[np.arange(len(hits)) - starts[owner[hits]] < k]
    return hits, np.searchsorted(owner[hits], np.arange(n + 1))


def _batches(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """The tables' rows in batches of ROWS or more."""
    out, n = [], 0
    for t in tables:
        out.append(t)
        n += len(t)
        if n >= ROWS:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out, n = [], 0
    yield from pa.concat_tables(out).combine_chunks().to_batches() if out else ()


def _shown(x: np.ndarray, digits: tuple[int, ...]) -> np.ndarray:
    for d in digits:
        x = rounded(x, d)
    return x


def _column(x: np.ndarray | tuple, pick: np.ndarray | None, digits: tuple[int, ...]) -> pa.Array:
    if isinstance(x, tuple):
        at, names = x
        return pa.array(names, pa.string()).take(pa.array(at if pick is None else at[pick]))
    x = x if pick is None else x[pick]
    x = _shown(x, digits) if x.dtype.kind == "f" else x
    return pa.array(x, mask=np.isnan(x)) if x.dtype.kind == "f" and np.isnan(x.min(initial=0.0)) else pa.array(x)


def _others(part: _Part) -> Callable[[int], np.ndarray | None]:
    """Of a query work, the places of the other works; None: all are."""
    there = set(part.w.ids.tolist())
    return lambda k: np.flatnonzero(part.w.ids != part.q.ids[k]) if part.q.ids[k] in there else None


def _rows(part: _Part, wanted: list[str], keep: list[str], matches: str | None, digits: tuple[int, ...], schema: pa.Schema, top: int | None) -> Iterator[pa.Table]:
    a, b, others = part.q, part.w, _others(part)
    ids, kept = [s.col("work_id") for s in (a, b)], [(f"ref_{c}", a.col(c)) for c in keep] + [(f"cand_{c}", b.col(c)) for c in keep]
    codes = [s.field("code") for s in (a, b)] if matches else None
    for k in range(a.n):
        pair, pick = _Pair(part, k), others(k)
        if top is not None:
            rest = np.arange(b.n) if pick is None else pick
            pick = rest[np.lexsort((b.ids[rest], -rounded(pair["sns"][rest], 9)))[:top]]
        there = None if pick is None else pa.array(pick)
        n = b.n if pick is None else len(pick)
        take = lambda x: x if there is None else x.take(there)  # noqa: B023, E731
        columns = [pa.repeat(ids[0][k], n), take(ids[1]), *[_column(pair[c], pick, digits) for c in wanted]]
        if matches:
            back, best = pair["nodes"]
            nodes, starts = (slice(None), b.at) if matches == "matches" else _best(b.owner, b.n, best, BEST)
            parts = [pa.array(b.pos[nodes], pa.int32()), codes[1] if matches == "matches" else codes[1].take(pa.array(nodes)), pa.array(a.pos[back[nodes]], pa.int32()), codes[0].take(pa.array(back[nodes])), pa.array(_shown(best[nodes], digits))]
            struct = pa.StructArray.from_arrays(parts, ["cand_pos", "cand_code", "ref_pos", "ref_code", "similarity"])
            columns.append(take(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), struct)))
        columns += [x.take(pa.array(np.full(n, k))) if c.startswith("ref_") else take(x) for c, x in kept]
        yield pa.table(columns, names=schema.names).cast(schema)


def _node_rows(part: _Part, top: int | None, digits: int, schema: pa.Schema) -> Iterator[pa.Table]:
    a, b, others, ids = part.q, part.w, _others(part), part.w.col("work_id")
    for k in range(a.n):
        back, best = part.nodes.of(k)
        nodes, starts = (np.arange(len(b.owner)), b.at) if top is None else _best(b.owner, b.n, best, top)
        rank = np.arange(len(nodes)) - starts[b.owner[nodes]] + 1
        if others(k) is not None:
            stay = b.ids[b.owner[nodes]] != a.ids[k]
            nodes, rank = nodes[stay], rank[stay]
        made = [pa.repeat(a.col("work_id")[k], len(nodes)), ids.take(pa.array(b.owner[nodes])), rank, b.pos[nodes], a.pos[back[nodes]], rounded(best[nodes], digits)]
        yield pa.table(made, names=schema.names).cast(schema)


def dealt(queries: DataFrame, works: DataFrame, columns: list[str], schema: StructType, n: int, at_once: int, begin: Callable) -> DataFrame:
    """Works in n blocks, and all query works in each. For a block, begin() gives (part, end): part(queries, some works) for each `at_once` works, then end(); both yield batches. `queries` is the same table for all parts of a block."""
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_block"), F.lit(0).alias("_side"), *columns)
    w = works.select(F.pmod(F.xxhash64("work_id"), F.lit(n)).cast("int").alias("_block"), F.lit(1).alias("_side"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked, held, (part_of, end) = None, [], [], begin()

        def done() -> Iterator[pa.RecordBatch]:
            if asked and held:
                if len(asked) > 1 or asked[0].column(0).num_chunks > 1:
                    asked[:] = [pa.concat_tables(asked).combine_chunks()]
                yield from part_of(asked[0], pa.concat_tables(held).combine_chunks())
            held.clear()

        for t in batches:
            t = pa.Table.from_batches([t])
            key = t["_block"].to_numpy() * 2 + t["_side"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if key[i] // 2 != block:
                    yield from done()
                    yield from end()
                    block, asked, (part_of, end) = key[i] // 2, [], begin()
                for k in range(i, j, at_once):
                    part = t.slice(k, min(at_once, j - k))
                    (held if key[i] % 2 else asked).append(part)
                    if sum(map(len, held)) >= at_once:
                        yield from done()
        yield from done()
        yield from end()

    return q.unionByName(w).repartition(n, "_block").sortWithinPartitions("_block", "_side").mapInArrow(run, schema)


def _parts(rows: Callable[[_Part], Iterator[pa.Table]]) -> Callable:
    """For dealt(): the rows of each part; the query works' arrays are made once for a block."""

    def begin() -> tuple[Callable, Callable]:
        known = {}

        def part(q: pa.Table, w: pa.Table) -> Iterator[pa.RecordBatch]:
            if known.get("table") is not q:
                known.update(table=q, side=_Side(q))
            return _batches(rows(_Part(known["side"], _Side(w))))

        return part, lambda: iter(())

    return begin


def _blocks(works: DataFrame, blocks: int | None) -> int:
    return blocks or max(BLOCKS, int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def scored(queries: DataFrame, works: DataFrame, wanted: list[str], keep: list[str] = (), with_matches: bool | str = False, digits: int | tuple[int, ...] = (), top: int | None = None, blocks: int | None = None) -> DataFrame:
    """Every query work against all others: ref_work_id, cand_work_id, the wanted columns as compare.with_scores() has them, and the columns to keep as ref_ and cand_.

    with_matches: True for a column matches, as best_matches(); "best" for a column of that name instead, of the matches that correspondences() leaves, in its order.
    digits: doubles are rounded to so many, or to the first and then the next. top: only pairs that can be among the so many best of a query work (by sns to nine digits, then the smaller id): those of each part of a block.
    warnings is the list, joined by commas. form: compare.form_keys().
    queries, works: compare.prepared() profiles, or the columns of them that columns_for() names. A block has part of the works and all query works, which are a small share of them.
    """
    matches = "matches" if with_matches is True else with_matches or None
    columns = list(dict.fromkeys(["work_id", *columns_for([*wanted, *(["s_iso"] if matches else []), *(["sns"] if top is not None else [])], works.columns), *keep]))
    kinds = StructType.fromDDL(", ".join([*[f"{c} {KINDS.get(c, 'double')}" for c in wanted], *([f"{matches} {MATCHES}"] if matches else [])]))
    schema = _pair_schema(works, kinds, list(keep))
    digits = (digits,) if isinstance(digits, int) else tuple(digits)
    rows = lambda part: _rows(part, wanted, list(keep), matches, digits, to_arrow_schema(schema), top)
    return dealt(queries, works, columns, schema, _blocks(works, blocks), WORKS, _parts(rows))


def compared(queries: DataFrame, works: DataFrame, keep: list[str], with_matches: bool | str = False, blocks: int | None = None) -> DataFrame:
    """scored() with s_iso, lcs and s_tens, for with_scores() to go on from."""
    return scored(queries, works, ["s_iso", "lcs", "s_tens"], keep, with_matches, blocks=blocks)


def node_rows(queries: DataFrame, works: DataFrame, top: int | None = None, digits: int = 6, blocks: int | None = None) -> DataFrame:
    """(ref_work_id, cand_work_id, rank, cand_pos, ref_pos, similarity): a row for each match of a pair, as best_matches(), in candidate order; top: those of correspondences(), the so many best. Similarities are rounded."""
    schema = _pair_schema(works, StructType.fromDDL("rank int, cand_pos int, ref_pos int, similarity double"), [])
    return dealt(queries, works, ["work_id", "nodes"], schema, _blocks(works, blocks), WORKS, _parts(lambda part: _node_rows(part, top, digits, to_arrow_schema(schema))))


def _pair_schema(works: DataFrame, kinds: StructType, keep: list[str]) -> StructType:
    fields = [StructField(f"{s}_{c}", works.schema[c].dataType) for s, cs in (("ref", ["work_id"]), ("cand", ["work_id"]), ("ref", keep), ("cand", keep)) for c in cs]
    return StructType([*fields[:2], *kinds.fields, *fields[2:]])


def best(queries: DataFrame, works: DataFrame, keep: list[str], k: int, first: int, roles: tuple[float, float], slack: float, blocks: int | None = None) -> DataFrame:
    """As compared(), for each query work the pairs of a block that can be among its k best there, and found and scored: how many pairs were bounded and scored (in one row for each block and query work).

    In a block the pairs with the `first` highest bounds are ranked, then those whose bound is not below the k-th score so far. numpy scores a query work with all works of a part at once if any
    of them is to be ranked; the rest of the scores is not looked at. roles: the least and the most that
    S_ACT's roles can give. No pair but a block's best leaves its task.
    """
    n = blocks or int(works.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = list(dict.fromkeys(["work_id", "nodes", "curves", "plain", "actant_sums", *keep]))
    schema = _pair_schema(works, StructType.fromDDL("s_iso double, lcs int, s_tens double, found bigint, scored bigint"), keep)

    def begin() -> tuple[Callable, Callable]:
        state, known, out, exact = {}, {}, to_arrow_schema(schema), roles[0] == roles[1]

        def part(qt: pa.Table, wt: pa.Table) -> Iterator[pa.RecordBatch]:
            if known.get("table") is not qt:
                known.update(table=qt, side=_Side(qt))
            q, w = known["side"], _Side(wt)
            both = _Part(q, w)
            bounds = _Bounds(both)
            for i in range(q.n):
                mine = state.setdefault(i, {"asked": qt.slice(i, 1), "low": np.zeros(0), "high": np.zeros(0), "rows": [], "found": 0, "scored": 0})
                pair = _Pair(both, i)
                parts = bounds.of(pair)
                bound, other = _sum(parts, roles[1]), w.ids != q.ids[i]
                mine["found"] += int(other.sum())
                left = other
                # The first of them set a bound, if there is none yet.
                for last in (False, True):
                    least = np.partition(mine["low"], -k)[-k] - slack if len(mine["low"]) >= k else -1.0
                    pick = np.flatnonzero(left & (bound >= least))
                    if not last and len(pick) > first:
                        pick = pick[np.argpartition(-bound[pick], first)[:first]] if first else pick[:0]
                    if not len(pick):
                        continue
                    left = left.copy()
                    left[pick] = False
                    some = wt.take(pa.array(pick))
                    iso, lcs, tens, func = (pair[c][pick] for c in ("s_iso", "lcs", "s_tens", "s_func"))
                    made = (iso, parts[1][pick], func, parts[3][pick], tens)
                    low, high = (np.concatenate([mine[name], _sum(made, r)]) for name, r in zip(("low", "high"), roles, strict=True))
                    rows = pa.table({"work_id": some["work_id"], "s_iso": iso, "lcs": pa.array(lcs, pa.int32()), "s_tens": tens} | {f"cand_{c}": some[c] for c in keep})
                    mine["scored"] += len(pick)
                    rows = pa.concat_tables([*mine["rows"], rows])
                    stay = np.flatnonzero(high >= np.partition(low, -k)[-k] - slack) if len(low) > k else np.arange(len(low))
                    if exact:
                        # Of equal scores the smallest ids come first, so copies without number don't stay.
                        stay = stay[np.lexsort((rows["work_id"].to_numpy()[stay], high[stay]))]
                        _, begins, of = np.unique(high[stay], return_index=True, return_inverse=True)
                        stay = stay[np.arange(len(stay)) - begins[of] < k]
                    mine |= {"low": low[stay], "high": high[stay], "rows": [rows.take(pa.array(stay))]}
            yield from ()

        def end() -> Iterator[pa.RecordBatch]:
            for mine in state.values():
                for rows in mine["rows"]:
                    here, zero = pa.array(np.zeros(len(rows), np.int64)), np.zeros(len(rows), np.int64)
                    counts = [np.where(np.arange(len(rows)) == 0, mine[c], zero) for c in ("found", "scored")]
                    made = [mine["asked"]["work_id"].take(here), *[rows[c] for c in ("work_id", "s_iso", "lcs", "s_tens")], *map(pa.array, counts), *[mine["asked"][c].take(here) for c in keep], *[rows[f"cand_{c}"] for c in keep]]
                    yield from pa.table(made, names=out.names).cast(out).combine_chunks().to_batches()

        return part, end

    return dealt(queries, works, columns, schema, n, AT_ONCE, begin)


def sharing(queries: DataFrame, works: DataFrame, blocks: int | None = None) -> DataFrame:
    """(ref_id, cand_id) of the pairs that share a code, or of which one has only African codes and the other any. Made and handed on in a block: no pair is shuffled."""
    n = blocks or max(BLOCKS, int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = works.schema["work_id"].dataType
    schema = StructType([StructField("ref_id", kind), StructField("cand_id", kind)])

    def part(qt: pa.Table, wt: pa.Table) -> Iterator[pa.RecordBatch]:
        out, (q, w) = to_arrow_schema(schema), (t["codes"].combine_chunks() for t in (qt, wt))
        qc, wc = _ids(q.flatten(), w.flatten())
        (q_at, w_at), owner = (_starts(q), _starts(w)), np.repeat(np.arange(len(w)), np.diff(_starts(w)))
        coded, african = np.diff(w_at) > 0, (np.diff(w_at) > 0) & (np.diff(_starts(wt["plain"].combine_chunks())) == 0)
        mine_african = np.diff(_starts(qt["plain"].combine_chunks())) == 0
        known, ids, mine = np.zeros(int(max(qc.max(initial=-1), wc.max(initial=-1))) + 1, bool), wt["work_id"].to_numpy(), qt["work_id"].to_numpy()
        for k in range(len(q)):
            codes = qc[q_at[k] : q_at[k + 1]]
            if not len(codes):
                continue
            known[:] = False
            known[codes] = True
            met = (coded if mine_african[k] else african).copy()
            met[owner[known[wc]]] = True
            cand = ids[met & (ids != mine[k])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cand), mine[k]), out[0].type), pa.array(cand, out[1].type)], schema=out)

    return dealt(queries, works, ["work_id", "codes", "plain"], schema, n, AT_ONCE, lambda: (part, lambda: iter(())))
