"""Whole texts to packed ids with the tokenizers library, one lookup per chunk of text.

The word vocabulary drops white space and never merges across it, nor across a
full stop or comma that ends a word.  A text is cut there, each distinct chunk is
encoded once, and texts are put together from the packed ids of their chunks.
The words of a chunk go through a faster encoder whose cuts are verified; the
library takes what is left.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

from civicforms.llm.merges import END, MergeRules, plain_words

#: Entries of a generation of a cache, and their bytes with all they hold; a bound on memory, not on texts.
CACHE_ENTRIES, CACHE_BYTES = 300_000, 96 << 20
#: Bytes that an entry takes at most beside the signs of its key and value, and a sign of a key.
ENTRY_BYTES, SIGN_BYTES = 200, 4
#: A full stop or comma after another sign: there the two may be one word of the pattern.
#: It begins with the stop, which is rare, so that a search passes over all else quickly.
_CLUSTER = re.compile(r"[.,](?<=[^\w\s][.,]|_[.,])\s")
#: Python calls these white space, the vocabulary's pattern does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def lower_chunks(text: str) -> list[str]:
    """Chunks of a text for a vocabulary that lower-cases, drops white space and never merges across words."""
    if "<|" not in text and not any(map(text.__contains__, _SEPARATORS)):
        low = (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()
        if low.isascii() or unicodedata.is_normalized("NFC", low):
            if not _CLUSTER.search(low):
                low = low.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ")
            return low.split()
    return text.split(" ")


def numbered(place: dict[str, int], chunked: list[list[str]], add: Callable[[list[str]], None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all chunks of some texts, one after another, and of how many chunks each text has.

    ``place`` holds the numbers known so far; ``add`` enters new chunks into it.
    """
    sizes = np.fromiter(map(len, chunked), np.int64, len(chunked))
    flat = list(chain.from_iterable(chunked))
    rows = np.fromiter(map(place.get, flat, repeat(-1)), np.int64, len(flat))
    missing = np.flatnonzero(rows < 0).tolist()
    if missing:
        add(list({flat[k] for k in missing}))
        rows[missing] = [place[flat[k]] for k in missing]
    return rows, sizes


class TwoGenerations(dict):
    """A cache of bounded size: the elder half goes when the younger is full, except what was used again.

    A generation is full by its entries or its bytes, whichever comes first; ``weigh`` gives the bytes of some values.
    Bytes are rather overrated, as if every sign took four.  It is looked at between two slices of texts, so the cache never outgrows its bound by more than one slice.
    """

    def __init__(self, fill: Callable[[list[str]], list], limit: int = CACHE_ENTRIES, most: int = CACHE_BYTES, weigh: Callable[[list], int] = lambda values: sum(map(len, values))) -> None:
        super().__init__()
        self.elder: dict = {}
        self.held = 0
        self.fill, self.limit, self.most, self.weigh = fill, limit, most, weigh

    def _keep(self, chunks: list[str], values: list) -> None:
        self.update(zip(chunks, values, strict=True))
        self.held += SIGN_BYTES * sum(map(len, chunks)) + self.weigh(values) + ENTRY_BYTES * len(chunks)

    def values_of(self, chunked: Iterable[list[str]]) -> list[list]:
        """The values of the chunks of each text.

        Each text is looked up as it comes, while its chunks are at hand; only those without a value are held until they are filled in together.
        """
        if len(self) > self.limit or self.held > self.most:
            self.elder, self.held = dict(self), 0
            self.clear()
        found, places, chunks_there = [], [], []
        for chunks in chunked:
            values = list(map(self.get, chunks))
            found.append(values)
            places.append(at := [k for k, v in enumerate(values) if v is None])
            chunks_there += [chunks[k] for k in at]
        if chunks_there:
            missing = set(chunks_there)
            again = [c for c in missing if c in self.elder]
            self._keep(again, [self.elder[c] for c in again])
            new = [c for c in missing if c not in self]
            self._keep(new, self.fill(new))
            filled = map(self.__getitem__, chunks_there)
            for values, at in zip(found, places, strict=True):
                for k in at:
                    values[k] = next(filled)
        return found


class WordEncoder:
    """Packed ids of words: cut by a byte-level encoder with the same merges, verified, else left open.

    Each word gets a closing sign that stands for the vocabulary's word end.  That
    encoder merges by the resulting token alone, so a cut that the merge rules would not give is found and refused.
    """

    def __init__(self, path: str, dtype: np.dtype) -> None:
        import tiktoken

        self.rules, self.dtype = MergeRules(path), dtype
        byte_of = {char: b for b, char in self.rules.alphabet.items()} | {END: 0}
        # Ranks: single bytes, bytes that end a word, then the merges in their order.
        names = [bytes([b]) for b in range(256)] + [bytes([b, 0]) for b in range(1, 256)]
        base = self.rules.base
        ids = [base[self.rules.alphabet[b]] for b in range(256)] + [base[self.rules.alphabet[b] + END] for b in range(1, 256)]
        known = set(names)
        for made in self.rules.made_in_order:
            name = bytes(byte_of[c] for c in self.rules.shape[made])
            if name not in known:
                known.add(name)
                names.append(name)
                ids.append(made)
        self.ids = np.array(ids, np.int64)
        self.ends = np.array([n[-1] == 0 for n in names])
        ranks = {n: r for r, n in enumerate(names)}
        self.encoder = tiktoken.Encoding(f"words-{zlib.crc32(path.encode())}", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> list[bytes | None]:
        ranks = self.encoder.encode_to_numpy("\0".join(words) + "\0", disallowed_special=())
        tokens, ends = self.ids[ranks], np.flatnonzero(self.ends[ranks]) + 1
        if len(ends) != len(words):
            return [None] * len(words)
        starts = np.concatenate([[0], ends[:-1]])
        bad = self.rules.wrong(tokens, np.repeat(np.arange(len(words)), ends - starts), len(words))
        packed, size = tokens.astype(self.dtype).tobytes(), self.dtype.itemsize
        return [None if b else packed[x:y] for x, y, b in zip((starts * size).tolist(), (ends * size).tolist(), bad.tolist(), strict=True)]


class ChunkEncoder:
    """Packed ids of whole texts, for a vocabulary whose word-ending tokens carry a suffix."""

    def __init__(self, path: str, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype(dtype)
        self.words = WordEncoder(path, self.dtype)
        self.cache = TwoGenerations(self._fill)

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words whose cut is verified."""
        done: dict[str, bytes] = {}
        for start in range(0, len(words), 4096):
            part = words[start : start + 4096]
            done.update((w, ids) for w, ids in zip(part, self.words.encode(part), strict=True) if ids is not None)
        return done

    def _fill(self, chunks: list[str]) -> list[bytes]:
        done = self._words([c for c in chunks if c.isascii() and c.isalpha() and c.islower()])
        mixed = {c: plain_words(c) for c in chunks if c not in done and "<|" not in c and "\0" not in c}
        known = self._words(list(set(chain.from_iterable(mixed.values())) - done.keys())) | done
        done.update((c, b"".join(ids)) for c, words in mixed.items() if None not in (ids := [known.get(w) for w in words]))
        rest = [c for c in chunks if c not in done]
        for start in range(0, len(rest), 4096):
            part = rest[start : start + 4096]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            done.update((c, np.array(e.ids, self.dtype).tobytes()) for c, e in zip(part, found, strict=True))
        return [done[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed in ``dtype``."""
        return [b"".join(values) for values in self.cache.values_of(map(lower_chunks, texts))]


@lru_cache(maxsize=2)
def chunk_encoder(path: str, dtype: str) -> ChunkEncoder:
    return ChunkEncoder(path, dtype)
