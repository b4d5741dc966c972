"""The merge rules of a word-level BPE vocabulary file, and the test whether a proposed cut of words is right.

A cut of a word into tokens is what merging gives exactly when each token survives
on its own and no merge crosses the border of two neighbours.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import regex

#: Fixed value: the word pattern of the public vocabulary file (\s is Unicode white space there).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SUFFIX = "</w>"
#: Stands for the word-end suffix in the strings of the matcher; no byte is mapped to it.
END = ""
NEVER = np.iinfo(np.int32).max


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where visible, else the next code point from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def plain_words(text: str) -> list[str]:
    """The words of a text, in NFC and lower case; that goes by character, without the final-sigma rule."""
    return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


class MergeRules:
    """Tokens, merges and their ranks, for a file whose word-ending tokens carry a suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        size = max(self.names) + 1
        self.size = size

        # Left and right part and rank of the merge that makes each token; base symbols have none.
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        rank = np.full(size, NEVER, np.int64)
        self.base = {}
        self.shape: dict[int, str] = {}
        shape = self.shape
        for char in self.alphabet.values():
            shape[vocab[char]] = char
            shape[vocab[char + SUFFIX]] = char + END
            self.base[char], self.base[char + END] = vocab[char], vocab[char + SUFFIX]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            left[made], right[made], rank[made] = x, y, r
            shape[made] = shape[x] + shape[y]
            self.pairs[x, y] = (r, made)
        self.made_in_order = [made for _, made in sorted(self.pairs.values())]
        keys = np.array([x * size + y for x, y in self.pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.pairs.values()], np.int64)[order]

        # Edges of the merge trees: row t holds the symbols from the outermost base symbol up to t itself.
        self.left_edge, self.right_edge = self._edges(left, rank), self._edges(right, rank)
        self.lengths = np.zeros(size, np.int64)
        for token, text in shape.items():
            self.lengths[token] = len(text)
        self.stable = self._stable(left, right, rank)

    @staticmethod
    def _edges(child: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: edge symbols from the base up, the rank at which each is consumed, and the start column."""
        levels = [np.arange(len(child))]
        while (down := np.where(levels[-1] >= 0, child[levels[-1]], -1)).max() >= 0:
            levels.append(down)
        symbols = np.stack(levels[::-1], axis=1)
        consumed = np.full(symbols.shape, NEVER, np.int64)
        consumed[:, :-1] = np.where(symbols[:, :-1] >= 0, rank[symbols[:, 1:]], NEVER)
        return symbols, consumed, (symbols < 0).sum(axis=1)

    def _merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = x * self.size + y
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def first_crossing(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
        """Rank of the merge that would first cross the border of each pair of tokens, else NEVER."""
        symbols_l, consumed_l, start_l = self.right_edge
        symbols_r, consumed_r, start_r = self.left_edge
        i, j = start_l[l].copy(), start_r[r].copy()
        found = np.full(len(l), NEVER, np.int64)
        live = np.arange(len(l))
        while len(live):
            a, b = l[live], r[live]
            until_l, until_r = consumed_l[a, i[live]], consumed_r[b, j[live]]
            cross = self._merge_rank(symbols_l[a, i[live]], symbols_r[b, j[live]])
            # Of equal ranks the leftmost place merges first: the left token's own, the border, the right token's own.
            hit = (cross < until_l) & (cross <= until_r) & (cross < NEVER)
            found[live[hit]] = cross[hit]
            done = hit | ((until_l == NEVER) & (until_r == NEVER))
            step_l = until_l <= until_r
            i[live[~done & step_l]] += 1
            j[live[~done & ~step_l]] += 1
            live = live[~done]
        return found

    def _stable(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which tokens encode to themselves: their halves do, and nothing crosses before their own merge."""
        stable = np.ones(self.size, bool)
        made = np.flatnonzero(rank < NEVER)
        whole = self.first_crossing(left[made], right[made]) == rank[made]
        for token, own in sorted(zip(made.tolist(), whole.tolist(), strict=True), key=lambda x: rank[x[0]]):
            stable[token] = own and stable[left[token]] and stable[right[token]]
        return stable

    def exact(self, symbols: list[int]) -> list[int]:
        """Merge in order of (rank, place), with a linked list and a heap."""
        n = len(symbols)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.pairs[p], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in self.pairs]
        heap = [(r, i, made, p) for r, made, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, pair = heapq.heappop(heap)
            j = following[i]
            if j >= n or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = made, -1
            following[i] = k = following[j]
            if k < n:
                before[k] = i
                if (p := (made, symbols[k])) in self.pairs:
                    r, m = self.pairs[p]
                    heapq.heappush(heap, (r, i, m, p))
            if (h := before[i]) >= 0 and (p := (symbols[h], made)) in self.pairs:
                r, m = self.pairs[p]
                heapq.heappush(heap, (r, h, m, p))
        return [s for s in symbols if s >= 0]

    def wrong(self, flat: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
        """Which of some words are cut wrongly into the tokens ``flat``, given the word of each token, in order."""
        bad = np.zeros(words, bool)
        bad[owner[~self.stable[flat]]] = True
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            keys, place = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
            crossed = self.first_crossing(keys // self.size, keys % self.size) < NEVER
            bad[owner[1:][inside][crossed[place]]] = True
        return bad
