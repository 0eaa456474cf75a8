"""Byte-pair merging over a pair occurrence index, for many distinct words at once."""

from __future__ import annotations

import heapq

import numpy as np

#: The rank of a pair that no merge has.
NONE = np.iinfo(np.int32).max


class PairIndex:
    """Merges by rank: ``left``, ``right`` and ``result`` are symbols; of equal ranks, the leftmost pair comes first.

    ``encode`` maps each pair to all its positions among the given words, takes the ranks that are in use in
    ascending order, merges all positions of a rank at once (leftmost first where they overlap), and updates the
    lists of the pairs beside them. The few words where this order could differ from the plain rule's are done
    again by that rule: where ranks with several results meet, or a merge makes a pair of a lower rank than its own.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray, symbols: int) -> None:
        key = left.astype(np.int64) * symbols + right
        order = np.lexsort((rank, key))
        first = np.concatenate([[True], np.diff(key[order]) != 0]) if len(key) else np.zeros(0, bool)
        self.symbols, self.key, self.rank = symbols, key[order][first], rank[order][first].astype(np.int32)
        self.made = result[order][first].astype(np.int32)
        self.result = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.result[self.rank] = self.made
        self.tied = set(self.rank[self.result[self.rank] != self.made].tolist())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(a), NONE, np.int32)
        key = a.astype(np.int64) * self.symbols + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def one_word(self, word: np.ndarray) -> list[int]:
        """The plain rule: merge the leftmost pair of the lowest rank until none is left."""
        if not hasattr(self, "plain"):
            self.plain = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        now, n = word.tolist(), len(word)
        after, ahead, waiting = [*range(1, n), -1], list(range(-1, n - 1)), []

        def note(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := self.plain.get(key := now[i] * self.symbols + now[after[i]])):
                heapq.heappush(waiting, (found[0], i, key, found[1]))

        for i in range(n - 1):
            note(i)
        while waiting:
            _, i, key, made = heapq.heappop(waiting)
            if now[i] < 0 or (j := after[i]) < 0 or now[i] * self.symbols + now[j] != key:
                continue
            now[i], now[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                ahead[after[j]] = i
            note(i)
            note(ahead[i])
        return [x for x in now if x >= 0]

    def encode(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of all words, joined, and how many each word has.

        ``symbols``: the words' symbols, joined; ``starts``: where each word begins. Words are not empty.
        """
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        n, sym = len(symbols), symbols.astype(np.int32)
        after, ahead = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[np.append(starts[1:], n) - 1] = -1
        ahead[starts] = -1
        here = np.full(n, NONE, np.int32)  # the rank of the pair that begins at each position
        alive = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        odd: list[np.ndarray] = []  # positions in words that the plain rule does again

        def note(at: np.ndarray, of: np.ndarray) -> None:
            kept = of != NONE
            at, of = at[kept], of[kept]
            if not len(at):
                return
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = np.flatnonzero(np.diff(of)) + 1
            for r, part in zip(of[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                if r in lists:
                    lists[r].append(part)
                else:
                    lists[r] = [part]
                    heapq.heappush(active, r)

        pairs = np.flatnonzero(after >= 0)
        here[pairs] = self.ranks(sym[pairs], sym[pairs + 1])
        note(pairs, here[pairs])
        while active:
            r = heapq.heappop(active)
            parts = lists.pop(r)
            at = np.concatenate(parts) if len(parts) > 1 else parts[0]
            at = np.sort(at[here[at] == r])
            if not len(at):
                continue
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            if r in self.tied:
                odd.append(at)
                continue
            if len(at) > 1:
                follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if follows.any():
                    k = np.arange(len(at))
                    at = at[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.result[r]
            alive[gone] = False
            here[gone] = NONE
            after[at] = beyond
            more = beyond >= 0
            ahead[beyond[more]] = at[more]
            before = ahead[at]
            changed = np.concatenate([at[more], before[before >= 0]])
            here[at[~more]] = NONE
            of = self.ranks(sym[changed], sym[after[changed]])
            here[changed] = of
            if len(of) and of.min() < r:
                odd.append(changed[of < r])
            note(changed, of)
        counts = np.add.reduceat(alive, starts, dtype=np.int64)
        out = sym[alive]
        if odd:
            ends, cuts = np.append(starts[1:], n), np.cumsum(counts)
            words = np.unique(np.searchsorted(starts, np.concatenate(odd), side="right") - 1).tolist()
            pieces, done = [], 0
            for w in words:
                new = self.one_word(symbols[starts[w] : ends[w]])
                pieces += [out[done : cuts[w] - counts[w]], np.array(new, np.int32)]
                done = cuts[w]
            counts[words] = [len(p) for p in pieces[1::2]]
            out = np.concatenate([*pieces, out[done:]])
        return out, counts


class Words(dict):
    """Distinct words in order of appearance, each with its number."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))
