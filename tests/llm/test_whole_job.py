"""Rows and texts that an earlier version lost or could not take."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

from civicforms.llm import exact_dedup, fingerprints, langid, ngram_join, packing

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")

LINE = " ".join(f"w{k}" for k in range(40))
ROWS = [
    (None, "first text of its own"), (None, "second text of its own"), (None, "third  text of its own"), (None, "third text of its own"),
    (1, "same words"), (2, "same  words"), (7, "one text"), (7, "another text"), (7, "another  text"), (8, "another text"),
    (None, "long   copy"), (9, "long copy"), (None, "lo ng   copy"), (3, LINE), (None, LINE + " more"), (3, "unlike the others"), (5, None), (5, " \n"),
]


@pytest.fixture(scope="module")
def odd_ids(spark):
    return spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, source string").repartition(3)


def bare(text):
    return "".join((text or "").split())


def test_exact_dedup_without_unique_ids(odd_ids):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, t or ""))
    want = sorted((None if n else i, bare(t)) for n, i, t in ((min(g)[1], min(g)[2], min(g)[3]) for g in groups.values()) if not n) + sorted(bare(min(g)[3]) for g in groups.values() if min(g)[1])
    kept = exact_dedup.drop_exact_duplicates(odd_ids)
    assert kept.columns == odd_ids.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted((i, bare(t)) for i, t in found if i is not None) + sorted(bare(t) for i, t in found if i is None) == want
    # The row that stays is one of the longest, not a shorter copy under the same identifier.
    assert all(len(t or "") == -min(groups[bare(t)])[0] for _, t in found)
    rows = exact_dedup.exact_groups(odd_ids).collect()
    assert len(rows) == len(ROWS)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text_sha256"], []).append(r)
    for group in by_text.values():
        ids = [r["doc_id"] for r in group if r["kept"]]
        assert set(ids) == {group[0]["keep_id"]}
        assert group[0]["keep_id"] is not None or len(ids) == 1


def test_near_dedup_without_unique_ids(odd_ids):
    found = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(odd_ids).collect()]
    words = sorted(" ".join((t or "").split()) for _, t in found)
    near = {" ".join((t or "").split()) for _, t in ROWS} - {LINE + " more"}
    assert set(words) == near
    # Of each text one row stays; blank ones are linked with nothing.
    assert [w for w in words if w] == sorted(near - {""})
    assert words.count("") == 2
    assert dict((t, i) for i, t in found)[LINE] == 3


def prose(size, seed):
    words = np.random.default_rng(seed)
    out = ""
    while len(out) < size:
        out += "".join(words.choice(list("eeeetaoinshrdlu"), words.integers(2, 9))) + " "
    return out[:size]


@pytest.mark.parametrize("size", [40, 60, 79, 80, 81, 120, 127, 128, 143, 144, 160, 200, 271, 272, 300, 528, 600, 1039, 1040, 2100, 5000])
def test_edits_stay_alike_at_every_length(size):
    for seed in range(20):
        text = prose(size, seed)
        changed = fingerprints.edited(text, prose(size, 1000 + seed))
        own, new, other = fingerprints.fingerprints([t.encode() for t in (text, changed, prose(size, 2000 + seed))])
        # Three quarters are unchanged.
        assert fingerprints.likeness(own, new) > 0.4
        assert fingerprints.likeness(own, other) < 0.3


@pytest.mark.parametrize(("size", "least"), [(120, 0.5), (127, 0.5), (500, 0.5), (511, 0.5), *((n, 0.4) for n in (70, 78, 79, 143, 271, 527, 1039, 2063))])
def test_texts_on_either_side_of_a_border_are_alike(size, least):
    # From 79 bytes on, at each doubling, runs get twice as long.
    for seed in range(20):
        longer = prose(size + 20, seed)
        a, b = fingerprints.fingerprints([longer[:size].encode(), longer.encode()])
        assert fingerprints.likeness(a, b) > least


def slow_features(text):
    """The windows chosen, from entropies counted one window at a time."""
    size = fingerprints.WINDOW
    if len(text) < size:
        return [text] if text else []
    windows = [text[k : k + size] for k in range(len(text) - size + 1)]
    run = 1
    while run < fingerprints.LONGEST_RUN and len(windows) / run > fingerprints.MOST:
        run *= 2

    def rank(k):
        counts = Counter(windows[k]).values()
        # Sum of c log2 c in fixed point; entropy is log2(size) less its share.
        total = sum(round(c * math.log2(c) * 65536) for c in counts)
        if total >= round((math.log2(size) - fingerprints.LEAST) * size * 65536):
            return (1 << 20) + 1, k
        return (1 << 20) - (abs(total - round((math.log2(size) - fingerprints.TYPICAL) * size * 65536)) >> 12), k

    ranks = [rank(k) for k in range(len(windows))]
    votes = Counter(min(ranks[k : k + run]) for k in range(len(windows) - run + 1))
    chosen = sorted((k, r) for (r, k), n in votes.items() if n >= max(1, run // 4))
    plain = [k for k, r in chosen if r <= 1 << 20]
    return [windows[k] for k in (plain or [k for k, _ in chosen])]


def slow_hash(window):
    if len(window) < fingerprints.WINDOW:
        return xxhash.xxh3_64_intdigest(window)
    h, mask = 0x243F6A8885A308D3, (1 << 64) - 1
    for k in range(0, len(window), 8):
        h = ((h ^ int.from_bytes(window[k : k + 8], "little")) * 0x9E3779B97F4A7C15) & mask
        h ^= h >> 32
    return h


def test_fingerprints_are_those_of_a_slow_version():
    texts = [prose(n, n).encode() for n in (5, 15, 16, 17, 40, 79, 80, 200, 700, 3000, 9000)]
    texts += [b"", b"a" * 50, b"a" * 300 + b"some other words follow here", b"ab" * 2000, "日本語 text ß".encode() * 9, b"\x00" * 100]
    digests = fingerprints.fingerprints(texts)
    for text, digest in zip(texts, digests, strict=True):
        wanted = [slow_hash(w) for w in slow_features(text)]
        assert int.from_bytes(digest[:4], "little") == len(wanted)
        filters = [set() for _ in range(max(1, round(len(wanted) / fingerprints.PER_FILTER + 1e-9)) if wanted else 0)]
        for k, h in enumerate(wanted):
            filters[min(k // fingerprints.PER_FILTER, len(filters) - 1)] |= {h >> (11 * j) & (fingerprints.FILTER_BITS - 1) for j in range(fingerprints.HASHES)}
        bits = np.unpackbits(np.frombuffer(digest[4:], np.uint8), bitorder="little").reshape(-1, fingerprints.FILTER_BITS)
        assert [set(np.flatnonzero(row).tolist()) for row in bits] == filters

    def likeness(a, b):
        """Bits in common beyond chance, best match for each filter of the shorter chain."""
        chains = []
        for d in (a, b):
            count = int.from_bytes(d[:4], "little")
            bits = [int.from_bytes(d[k : k + fingerprints.FILTER_BITS // 8], "little") for k in range(4, len(d), fingerprints.FILTER_BITS // 8)]
            chains.append([(f, fingerprints.PER_FILTER if k < len(bits) - 1 else count - k * fingerprints.PER_FILTER) for k, f in enumerate(bits)])
        short, long = sorted(chains, key=len)
        if a == b:
            return 1.0
        if not short:
            return 0.0
        total = 0.0
        for f, n in short:
            best = 0.0
            for g, _ in long:
                chance = f.bit_count() * g.bit_count() / fingerprints.FILTER_BITS
                best = max(best, ((f & g).bit_count() - chance) / max(min(f.bit_count(), g.bit_count()) - chance, 1e-9))
            total += n * min(1.0, best)
        return total / sum(n for _, n in short)

    for a in digests:
        for b in digests:
            assert abs(fingerprints.likeness(a, b) - likeness(a, b)) < 1e-9


def test_long_texts_in_blocks():
    # Longer than a block of entropies and than a slice of texts.
    long = prose(300_000, 1).encode()
    alone = fingerprints.window_sums(np.frombuffer(long, np.uint8))
    middle = np.frombuffer(long, np.uint8)[131_000:131_200]
    assert (fingerprints.window_sums(middle) == alone[131_000 : 131_200 - fingerprints.WINDOW + 1]).all()
    together = fingerprints.fingerprints([b"x y", long, long[:1000]])
    assert together == [fingerprints.fingerprints([t])[0] for t in (b"x y", long, long[:1000])]


def test_packing_takes_long_white_space(spark):
    texts = ["a" + " " * 2_000_000 + "b", " \n" * 1_000_000, "x <|endoftext|>" + "\n" * 150_000 + " y", "z" * 150_000, "w " * 60_000]
    tokenizer = Tokenizer.from_file(BYTE)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [packing.token_ids(BYTE, t).tolist() for t in texts] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = {}
    for p in packing.pack(df, BYTE, 1).collect():
        packed[p["doc_id"]] = packed.get(p["doc_id"], 0) + p["length"]
    assert packed == {k: len(ids) + 1 for k, ids in enumerate(want)}


def test_language_id_takes_any_number_of_words(spark):
    en, fr = "the house of the river and the green tree with stones", "la maison de la rivière et des arbres verts avec pierres"
    model = langid.fit(spark.createDataFrame([(k, en if k % 2 else fr, "en" if k % 2 else "fr") for k in range(40)], "doc_id long, text string, lang string"), WORD)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[k // 26**p % 26] for p in range(5)) for k in range(1_500_000)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, en), (2, "12")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in langid.predict(df, model, WORD).collect()}
    assert (got[1]["lang_pred"], got[2]["lang_pred"]) == ("en", "und")
    assert got[0]["lang_pred"] in model.langs
    cache = langid.ChunkScores(langid.pieces(WORD), model.probs, limit=10)
    for part in (words[:40], words[:70_000], words[20:60]):
        assert np.allclose(next(cache.of([" ".join(part)])), langid.word_scores(langid.pieces(WORD), model.probs, part).sum(axis=0))


def test_sketch_never_refuses_a_link():
    draw = np.random.default_rng(5)
    for size in (1, 7, 100, 3000):
        a = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
        for differ in (0, 1, size // 9, size):
            b = np.unique(np.concatenate([a[differ:], draw.integers(0, 1 << 63, differ, dtype=np.uint64)]))
            apart = int(np.bitwise_count((ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_runs_merge_in_rounds(spark, bits):
    # More runs than two rounds of the widest merge can hold, hot and rare texts, missing and extreme identifiers.
    rows = [(k if k % 7 else None, "hot text" if k % 3 else f"text {k % 40}" + " " * (k % 5)) for k in range(900)]
    rows += [(-(1 << 63), "hot  text"), ((1 << 63) - 1, "hot  text"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(300)
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t), i is None, i or 0))
    got = exact_dedup.exact_groups(df, bits=bits).collect()
    assert len(got) == len(rows)
    want = {hashlib.sha256(t.encode()).hexdigest(): (None if min(g)[1] else min(g)[2], len(g)) for t, g in groups.items()}
    assert {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in got} == want
    for r in got:
        assert r["kept"] == (r["doc_id"] == r["keep_id"]) or r["keep_id"] is None
