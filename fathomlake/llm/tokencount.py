"""Token counts under a byte-level BPE vocabulary.

Rank-synchronous array merging: the distinct pre-tokens of a batch lie in one
ragged numpy array of symbols; each round applies the lowest-rank pair of every
sequence at the same time, until no pair is left; the symbols that survive are
the tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .shared import appended

#: Splits text before merges, as the rank files were made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_NONE = np.int64(1) << 40
#: Distinct pre-tokens that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class Merger:
    """The merges of a vocabulary as arrays.

    ``keys`` holds each pair of tokens whose joined bytes are a token, sorted;
    ``ranks`` the rank of that token, which is also its id.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), _NONE)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The token ids of each piece (for tests; ``count`` is the fast form)."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
        self._run(pieces, lambda number, symbols: out.__setitem__(number, symbols))
        return out

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """How many tokens each piece has."""
        out = np.zeros(len(pieces), np.int64)
        self._run(pieces, None, out)
        return out

    def _run(self, pieces: list[bytes], take, counts: np.ndarray | None = None) -> None:
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        symbols = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), lengths)
        rank = self._pairs(symbols, seq)
        while len(symbols):
            heads = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            over = low == _NONE
            if over.any():  # sequences without a pair left leave the arrays
                for h, size in zip(heads[over], sizes[over]) if take else ():
                    take(int(seq[h]), symbols[h : h + size].copy())
                if counts is not None:
                    counts[seq[heads[over]]] = sizes[over]
                stays = np.repeat(~over, sizes)
                symbols, seq, rank = symbols[stays], seq[stays], rank[stays]
                low, sizes = low[~over], sizes[~over]
                if not len(symbols):
                    return
            lowest = np.repeat(low, sizes)
            hit = self._apart(rank == lowest)
            at = self._safe(np.flatnonzero(hit), symbols, seq, lowest)
            symbols[at] = rank[at]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            keep = ~gone
            moved = np.cumsum(keep) - 1
            symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
            new = moved[at]
            k = np.concatenate([new, new[new > 0] - 1])
            nxt = np.minimum(k + 1, len(symbols) - 1)
            inside = (k + 1 < len(symbols)) & (seq[nxt] == seq[k])
            rank[k] = np.where(inside, self._rank(symbols[k], symbols[nxt]), _NONE)

    def _pairs(self, symbols: np.ndarray, seq: np.ndarray) -> np.ndarray:
        rank = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            rank[:-1] = np.where(seq[1:] == seq[:-1], self._rank(symbols[:-1], symbols[1:]), _NONE)
        return rank

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Of overlapping pairs (a run of equal symbols) every other one, from the left."""
        at = np.flatnonzero(hit)
        run = np.append(True, np.diff(at) > 1)
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        out = np.zeros(len(hit), bool)
        out[at[place % 2 == 0]] = True
        return out

    def _safe(self, at: np.ndarray, symbols: np.ndarray, seq: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """The pairs up to the first of a sequence whose merge makes a pair of lower rank.

        One at a time, such a pair would be merged before the next of the same
        rank; so what lies beyond waits for the next round.
        """
        made, n = lowest[at], len(symbols)
        after = np.minimum(at + 2, n - 1)
        right = np.where((at + 2 < n) & (seq[after] == seq[at]), self._rank(made, symbols[after]), _NONE)
        before = np.maximum(at - 1, 0)
        previous = symbols[before]
        joined = np.append(False, (at[1:] - 2 == at[:-1]) & (seq[at[1:]] == seq[at[:-1]]))
        previous = np.where(joined, made, previous)  # the left neighbour was merged just before
        left = np.where((at > 0) & (seq[before] == seq[at]), self._rank(previous, made), _NONE)
        breaks = np.minimum(left, right) < made
        if not breaks.any():
            return at
        first = np.flatnonzero(np.append(True, seq[at[1:]] != seq[at[:-1]]))
        earlier = np.cumsum(breaks) - breaks  # breaks before this one, over all sequences
        base = np.repeat(earlier[first], np.diff(np.append(first, len(at))))
        return at[earlier == base]


class TokenCounter:
    """Counts the tokens of texts, remembering the counts of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], merger: Merger, pattern: str = PATTERN, remembered: int = REMEMBERED) -> None:
        self.ranks, self.merger, self.remembered = ranks, merger, remembered
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [self.split(t) for t in texts]
        new = list(set(chain.from_iterable(pieces)).difference(self.known))
        if new:
            if len(self.known) + len(new) > self.remembered:
                self.known = {}
                new = list(set(chain.from_iterable(pieces)))
            raw = [p.encode("utf-8", "surrogatepass") for p in new]
            n = np.ones(len(raw), np.int64)
            rest = [i for i, r in enumerate(raw) if r not in self.ranks]
            n[rest] = self.merger.count([raw[i] for i in rest])
            self.known.update(zip(new, n.tolist()))
        known = self.known
        return [sum(map(known.__getitem__, p)) for p in pieces]


def count_tokens(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, n_tokens)``, one row for each input row.

    A null text has null tokens, an empty one 0; repeated rows repeat. The driver
    reads the vocabulary and sends it, of fixed size, to the executors.
    """
    ranks = load_ranks(ranks_path)
    sent = docs.sparkSession.sparkContext.broadcast((ranks, Merger(ranks)))

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        counter = TokenCounter(*sent.value, pattern)

        def count(texts: list[str | None]) -> list[pa.Array]:
            out: list[int | None] = [None] * len(texts)
            has = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(has), 500):
                part = has[k : k + 500]
                for i, n in zip(part, counter.counts([texts[i] for i in part])):
                    out[i] = n
            return [pa.array(out, pa.int64())]

        return count

    return appended(docs, [F.col("doc_id").cast("long").alias("doc_id")], [StructField("n_tokens", LongType())], start)
