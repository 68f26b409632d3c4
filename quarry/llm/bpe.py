"""Byte-level BPE with a hierarchical-bitmap rank queue over linked lists.

All pre-tokens of a batch lie in one linked list that is cut between them.
``RankQueue`` has a bucket of list positions for each merge rank; a bitmap of
three levels tells which buckets hold something, and find-first-set walks down
to the least rank.  A bucket is merged at once: entries whose pair has changed
since are stale and skipped, of overlapping pairs (a a a) the leftmost goes
first, and the pairs that arise are queued under their own ranks.  A position
is queued again only when a neighbour merged, so a pre-token of n bytes costs
O(n) queue entries however long it is.
"""

from __future__ import annotations

import base64
import re
from itertools import islice

import numpy as np
import regex

#: White space as Unicode's White_Space property has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A text falls into these units; each holds whole pre-tokens of the pattern.
UNITS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
DECODE_IDS = 1 << 18
NO_RANK = np.iinfo(np.int32).max


class RankQueue:
    """Buckets of positions by rank, with a bitmap tree to find the least."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels = []
        n = ranks
        while True:
            n = (n + 63) >> 6
            self.levels.append([0] * n)
            if n == 1:
                break

    def push(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            before = level[word]
            level[word] = before | bit
            if before:
                break
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        heads = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        ends = [*heads[1:].tolist(), len(ranks)]
        for rank, a, b in zip(ranks[heads].tolist(), heads.tolist(), ends, strict=True):
            self.push(rank, positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The least rank and its positions in text order."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank = at
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        held = self.buckets.pop(rank)
        return rank, held[0] if len(held) == 1 else np.unique(np.concatenate(held))


class Numbers(dict):
    """Numbers units in the order in which they are first looked up."""

    def __missing__(self, unit: str) -> int:
        i = self[unit] = len(self)
        return i


class Bpe:
    """Encoder and decoder for a file of ranks (base64 token, rank per line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, units: int = 100_000):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        left, right, rank = (np.array(x, np.int64) for x in (left, right, rank))
        key = left * self.size + right
        order = np.argsort(key)
        self.key, self.rank = np.r_[key[order], np.iinfo(np.int64).max], np.r_[rank[order], NO_RANK].astype(np.int32)
        #: Whether some pair with this token has a lower rank than the merge that makes it.
        self.turns_back = np.zeros(self.size, bool)
        self.turns_back[left[rank < left]] = True
        self.turns_back[right[rank < right]] = True
        table = [b""] * self.size
        for t, r in ranks.items():
            table[r] = t
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_at = np.r_[0, np.cumsum([len(t) for t in table])]
        self.limit = units
        self.forget()

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}, pattern)

    def forget(self) -> None:
        self.cache = Numbers()
        self.unit_ids = np.zeros(0, np.int32)
        self.unit_at = np.zeros(1, np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        i = np.searchsorted(self.key, key)
        return np.where(self.key[i] == key, self.rank[i], NO_RANK)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts) of pre-tokens by the rank queue."""
        text = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(text)
        cuts = np.r_[0, np.cumsum([len(p) for p in pieces])].astype(np.int64)
        token = self.byte[text]
        nxt, prev = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[cuts[1:] - 1] = -1
        nxt, prev = nxt[:n], prev[:n]
        prev[cuts[:-1]] = -1
        alive = np.ones(n, bool)
        current = np.full(n, NO_RANK, np.int32)
        has = np.flatnonzero(nxt >= 0)
        current[has] = self.pair_rank(token[has], token[has + 1])
        queue = RankQueue(self.size)
        ready = np.flatnonzero(current != NO_RANK)
        queue.push_all(current[ready], ready)
        while (popped := queue.pop()) is not None:
            rank, at = popped
            at = at[(current[at] == rank) & alive[at]]  # stale entries go
            if not len(at):
                continue
            if len(at) > 1:
                chained = np.r_[False, nxt[at[:-1]] == at[1:]]
                if chained.any():
                    i = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(chained, 0, i))
                    at = at[(i - start) % 2 == 0]
                if self.turns_back[rank]:
                    at = self._in_turn(queue, rank, at, token, nxt, prev, cuts)
            right = nxt[at]
            after = nxt[right]
            alive[right] = False
            current[right] = NO_RANK
            token[at] = rank
            nxt[at] = after
            inside = after >= 0
            prev[after[inside]] = at[inside]
            current[at] = NO_RANK
            before = prev[at]
            touched = np.r_[at[inside], before[before >= 0]]
            if not len(touched):
                continue
            touched = np.unique(touched)
            ranks = self.pair_rank(token[touched], token[nxt[touched]])
            current[touched] = ranks
            good = ranks != NO_RANK
            queue.push_all(ranks[good], touched[good])
        return token[alive].astype(np.int32), np.r_[0, np.cumsum(alive)][cuts]

    def _in_turn(self, queue, rank, at, token, nxt, prev, cuts):
        """Merges that can be made together; of a pre-token where one would
        make a pair of lower rank, only the leftmost, and the rest wait."""
        after, before = nxt[nxt[at]], prev[at]
        made = np.full(len(at), rank, np.int32)
        low = np.zeros(len(at), bool)
        for ok, left, right in ((after >= 0, made, token[after]), (before >= 0, token[before], made)):
            low |= ok & (self.pair_rank(left, right) < rank)
        if self.pair_rank(made[:1], made[:1])[0] < rank:
            low[:-1] |= after[:-1] == at[1:]
        if not low.any():
            return at
        piece = np.searchsorted(cuts, at, "right")
        first = np.r_[True, piece[1:] != piece[:-1]]
        wait = np.isin(piece, piece[low]) & ~first
        if wait.any():
            queue.push(rank, at[wait])
        return at[~wait]

    def _learn(self, units: list[str]) -> None:
        """Append the ids of new units, in the order of their numbers."""
        pieces, of = [], []
        for i, unit in enumerate(units):
            for piece in self.pattern.findall(unit):
                pieces.append(piece.encode())
                of.append(i)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        lengths = np.ones(len(pieces), np.int64)
        todo = np.flatnonzero(whole < 0)
        ids, cuts = self.merge([pieces[i] for i in todo.tolist()])
        lengths[todo] = np.diff(cuts)
        at = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.int32)
        out[at[whole >= 0]] = whole[whole >= 0]
        out[gather(at[todo], lengths[todo])] = ids
        per_unit = np.bincount(np.asarray(of, np.int64), weights=lengths, minlength=len(units)).astype(np.int64)
        self.unit_at = np.r_[self.unit_at, self.unit_at[-1] + np.cumsum(per_unit)]
        self.unit_ids = np.r_[self.unit_ids, out]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts) of whole texts; equal units of the batch are encoded once."""
        if len(self.cache) > self.limit:
            self.forget()
        cache, known = self.cache, len(self.cache)
        parts = []
        for text in texts:
            found = UNITS.findall(text)
            parts.append(np.fromiter(map(cache.__getitem__, found), np.int32, len(found)))
        if len(cache) > known:
            self._learn(list(islice(cache, known, None)))
        units = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        size = self.unit_at[units + 1] - self.unit_at[units]
        ids = self.unit_ids[gather(self.unit_at[units], size)]
        ends = np.r_[0, np.cumsum(size)]
        return ids, ends[np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)]

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, cuts) of id sequences bounded by ``cuts``, DECODE_IDS ids at a time."""
        parts = []
        for a in range(0, len(ids), DECODE_IDS):
            some = ids[a : a + DECODE_IDS]
            at = self.token_at[some]
            parts.append(self.token_bytes[gather(at, self.token_at[some + 1] - at)])
        size = self.token_at[ids + 1] - self.token_at[ids]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.r_[0, np.cumsum(size)][cuts]


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (size[i] of them), for each i in turn."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    end = int((start + size).max())
    kind = np.int32 if max(total, end) <= np.iinfo(np.int32).max else np.int64
    out = np.repeat((start - (np.cumsum(size) - size)).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


_loaded: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """The encoder of this worker process for a file of ranks."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe.load(path, pattern)
    return _loaded[path, pattern]
