"""The lattice of a batch of words as numpy arrays: what ``pieces.encoded_words`` does in columns, for words in a task.

Every substring that begins in a word is joined with the beginnings of pieces, one character more at a
time and for all words at once, so it is followed no further than pieces go. The pieces met are the edges; the
fold of the file's kind then runs over the edges of all words together, one step of each word at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points take so many bits in a key; a batch of words has at most about so many characters.
CODE_BITS, BATCH_CHARS = 21, 1 << 16


def runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _batches(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    stops, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(stops, (stops[a - 1] if a else 0) + BATCH_CHARS, "right")))
        yield a, b
        a = b


def _first_of_each(words: np.ndarray) -> np.ndarray:
    """Where a word's run begins in sorted word numbers."""
    return np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.empty(0, dtype=np.int64)


class Lattice:
    """The pieces of a ``pieces.PieceTable`` by their beginnings."""

    def __init__(self, table, unigram: bool):
        ranks = {s: i for i, s in enumerate(sorted(set(table.scores), reverse=True))}
        nodes: dict[int, int] = {}
        best: dict[int, tuple[int, int]] = {}
        for i, (piece, score, normal) in enumerate(zip(table.pieces, table.scores, table.normal, strict=True)):
            if normal and piece:
                node = 0
                for c in piece:
                    node = nodes.setdefault(node << CODE_BITS | ord(c), len(nodes) + 1)
                best[node] = min(best.get(node, (len(ranks), 0)), (ranks[score], i))
        keys = np.array(list(nodes), dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.array(list(nodes.values()), dtype=np.int64)[order]
        self.ranks, self.ids = np.full(len(nodes) + 1, -1, dtype=np.int64), np.full(len(nodes) + 1, -1, dtype=np.int64)
        for node, (rank, i) in best.items():
            self.ranks[node], self.ids[node] = rank, i
        self.unigram, self.bytes_from, self.unknown = unigram, table.bytes_from, table.unknown
        self.costs = np.array([-float(s) for s in sorted(ranks, reverse=True)])
        self.unknown_cost = 10.0 - min((s for s, n in zip(table.scores, table.normal, strict=True) if n), default=0.0)

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, node) of all substrings that are pieces; ``left``: a word's characters from each place on."""
        at, node, found = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), []
        length = 0
        while len(at) and len(self.keys):
            inside = left[at] > length
            at, key = at[inside], node[inside] << CODE_BITS
            key |= codes[at + length]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[place] == key
            at, node, length = at[met], self.nodes[place[met]], length + 1
            whole = self.ranks[node] >= 0
            found.append((at[whole], np.full(whole.sum(), length), node[whole]))
        if not found:
            return (np.empty(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def merged(self, sizes: np.ndarray, word: np.ndarray, s: np.ndarray, e: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The fold of BPE files: the symbol borders of each word, as bits."""
        one = np.int64(1)
        masks = (one << sizes) | ((one << sizes) - one)
        longer = np.flatnonzero(e - s > 1)
        longer = longer[np.argsort(((word[longer] << 21 | rank[longer]) << 6 | s[longer]) << 7 | e[longer])]
        word, s, e = word[longer], s[longer], e[longer]
        ends, inner = one << s | one << e, (one << e) - (one << s + 1)
        while len(word):
            mask = masks[word]
            between = mask & inner
            # a border that is gone does not come back
            able = ((mask & ends) == ends) & (between != 0)
            word, ends, inner, between = word[able], ends[able], inner[able], between[able]
            fits = np.flatnonzero((between & (between - one)) == 0)
            first = fits[_first_of_each(word[fits])]
            masks[word[first]] &= ~inner[first]
            moved = np.zeros(len(masks), dtype=bool)
            moved[word[first]] = True
            going = moved[word]
            word, ends, inner = word[going], ends[going], inner[going]
        return masks

    def cheapest(self, sizes: np.ndarray, word: np.ndarray, s: np.ndarray, e: np.ndarray, rank: np.ndarray, lacking: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The fold of unigram files, likewise; ``lacking``: (word, place) of the characters that are no piece."""
        cost = np.concatenate([self.costs[rank], np.full(len(lacking[0]), self.unknown_cost)])
        word, s, e = np.concatenate([word, lacking[0]]), np.concatenate([s, lacking[1]]), np.concatenate([e, lacking[1] + 1])
        order = np.argsort(e, kind="stable")
        word, s, e, cost = word[order], s[order], e[order], cost[order]
        widest = int(sizes.max(initial=0))
        ways, back = np.full((len(sizes), widest + 1), np.inf), np.zeros((len(sizes), widest + 1), dtype=np.int64)
        ways[:, 0] = 0.0
        cuts = np.searchsorted(e, np.arange(widest + 2))
        for end in range(1, widest + 1):
            here = slice(cuts[end], cuts[end + 1])
            w, b = word[here], s[here]
            c = ways[w, b] + cost[here]
            order = np.lexsort((b, c, w))
            first = order[_first_of_each(w[order])]
            ways[w[first], end], back[w[first], end] = c[first], b[first]
        one, place = np.int64(1), sizes.copy()
        masks = one << place
        while place.any():
            place = back[np.arange(len(place)), place]
            masks |= one << place
        return masks

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds by word) of words of at most ``pieces.LATTICE_CHARS`` characters."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        parts = [self._encode(words[a:b], sizes[a:b]) for a, b in _batches(sizes)]
        ids = np.concatenate([np.empty(0, dtype=np.int32), *[p[0] for p in parts]])
        return ids, np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, dtype=np.int64), *[p[1] for p in parts]]))])

    def _encode(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        word, place = np.repeat(np.arange(len(words)), sizes), runs(sizes)
        start, length, node = self.edges(codes, sizes[word] - place)
        w, s = word[start], place[start]
        e, rank = s + length, self.ranks[node]
        if self.unigram:
            known = np.zeros(len(codes), dtype=bool)
            known[start[length == 1]] = True
            masks = self.cheapest(sizes, w, s, e, rank, (word[~known], place[~known]))
        else:
            masks = self.merged(sizes, w, s, e, rank)
        one = np.int64(1)
        ends, inner, mask = one << s | one << e, (one << e) - (one << s + 1), masks[w]
        taken = ((mask & ends) == ends) & ((mask & inner) == 0)
        piece = np.full(len(codes), -1, dtype=np.int64)
        piece[start[taken]] = self.ids[node[taken]]
        symbols = np.flatnonzero(masks[word] >> place & one)
        ids, n = piece[symbols], np.ones(len(symbols), dtype=np.int64)
        bare = np.flatnonzero(ids < 0)
        if self.bytes_from is None or not len(bare):
            ids[bare] = self.unknown
        else:
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[symbols[bare]].tolist()]
            n[bare] = [len(r) for r in raw]
            ids = np.repeat(ids, n)
            ids[ids < 0] = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64) + self.bytes_from
        return ids.astype(np.int32), np.bincount(word[symbols], weights=n, minlength=len(words)).astype(np.int64)
