"""Operators of the llm subpackage on a small fixture with every odd case, against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from civicforms.llm import bpe, chat, chunks, components, exact_dedup, fingerprints, langid, lm_score, ngram_join, packing, registry, token_output, toxicity
from civicforms.storage import Workspace

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
LONG = " ".join(f"word{k % 700} and{k % 13}" for k in range(9000))
NEAR = " ".join(f"tok{k}" for k in range(100))
TEXTS = [
    None, "", "  \n\t ", "A", "Ana are mere. Ana are mere, da!", "Ana are mere.  Ana are\nmere, da!", "éa ́b Σας <|endoftext|> x  y\x1cz", LONG, NEAR, NEAR + " extra", NEAR.upper(),
    "aaaa aaaaa aaaaaaaaaaaaaaaaaaaaa", "you idiot fool", "日本語 😀😀 text", "one two three four", "one two three four", " lead and trail ", "...,,, !!? a.,b ,. ., x",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "fr", None][k % 3], "src0", None, "x", 1.5, "mark") for k, t in enumerate(TEXTS)]
    rows += [(3, "A", None, None, 1, None, None, None), (900, "tail", "en", "s", 4, "y", 0.0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token string, score double, set_id string").repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bpe_is_the_library(docs, plain):
    tokenizer = Tokenizer.from_file(WORD)
    want = [(i, e.ids) for (i, t), e in zip(plain, tokenizer.encode_batch([t for _, t in plain], add_special_tokens=False), strict=True)]
    got = rows_of(bpe.round_trip(docs, WORD))
    assert got == sorted([(i, len(x), " ".join(map(str, x)), tokenizer.decode(x, skip_special_tokens=False)) for i, x in want], key=str)
    encoded = bpe.encode(docs, WORD)
    assert sorted((r["doc_id"], r["ids"]) for r in encoded.collect()) == sorted(want)
    assert sorted(map(tuple, bpe.decode(encoded, WORD).collect())) == sorted((i, tokenizer.decode(x, skip_special_tokens=False)) for i, x in want)


LIBRARY, OWN, PACKED = Tokenizer.from_file(WORD), bpe.encoder(WORD), chunks.chunk_encoder(WORD, "<u2")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdehnorstéÄΣİ 's.,!'<|>/\n\t  019́\x1c日😀", max_size=60))
def test_bpe_on_any_text(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == want
    assert [i for c in chunks.lower_chunks(text) for i in OWN.encode(c)] == want
    assert np.frombuffer(PACKED.encode([text])[0], "<u2").tolist() == want


def test_packing_covers_every_id_once(docs, plain):
    tokenizer = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, t in plain:
        want[i, tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 1])] += 1
    pieces = packing.pack(docs, BYTE, 1, window=64, windows=4).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for (i, ids), times in want.items():
        cover = np.zeros(len(ids), int)
        for p in by_doc[i]:
            if p["doc_tokens"] == len(ids):
                part = ids[p["start"] : p["start"] + p["length"]]
                assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]
                cover[p["start"] : p["start"] + p["length"]] += 1
        assert (cover == times).all()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0


def test_token_files(docs, plain, spark):
    tokenizer = Tokenizer.from_file(WORD)
    got = sorted((tuple(r) for r in token_output.read_blocks(token_output.write_blocks(docs, WORD, 2, Workspace(spark, "t"), block_ids=500)).collect()), key=lambda r: r[1])
    start, want = 0, []
    for i, t in plain:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=300))
def test_elias_fano(steps):
    values = np.cumsum(steps)
    code = token_output.EliasFano.build(values)
    again, size = token_output.EliasFano.frombytes(memoryview(code.tobytes()), len(values), code.low_bits, int(values[-1]))
    assert size == len(code.tobytes())
    # Two bits and the low bits a value, besides the select samples.
    assert 8 * (len(code.low) + len(code.high)) <= len(values) * (2 + max(0, math.log2(max(1, values[-1]) / len(values)))) + len(values) + 24
    assert again.values().tolist() == values.tolist() == [again.select(i) for i in range(len(values))]


def test_token_blocks_with_any_identifiers():
    lowest, highest = -(1 << 63), (1 << 63) - 1
    for numbers in ([None, None, lowest, -5, -5, 0, highest], [None], [7], [lowest, highest], list(range(-300, 300))):
        parts = [np.arange(k % 5 + 1, dtype="<u2").tobytes() for k in range(len(numbers))]
        block = token_output.Block(token_output.pack_block(numbers, parts, 2, 9))
        assert [block.doc_id(k) for k in range(len(block))] == numbers
        assert [block.tokens(k).tobytes() for k in range(len(block))] == parts
        assert block.before == 9


def test_exact_dedup(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert rows_of(exact_dedup.exact_groups(docs)) == sorted(con.execute(exact_dedup.ORACLE).fetchall(), key=str)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert len({"".join(t.split()) for t in texts}) == len(texts)


def brute_components(rows, n=5):
    sets = []
    for i, t in rows:
        w = t.encode().lower().split()
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    group = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for x, (_, a) in enumerate(sets):
            for y, (_, b) in enumerate(sets):
                if x != y and a and b and 100 * len(a & b) >= 80 * len(a | b) and group[x] != group[y]:
                    group[x] = group[y] = min(group[x], group[y])
                    changed = True
    least = {}
    for g, (i, _) in zip(group, sets, strict=True):
        least[g] = min(i, least.get(g, i))
    return sorted(((i, len(s), least[g] if s else i) for g, (i, s) in zip(group, sets, strict=True)), key=str)


def test_ngram_join(spark, docs, plain):
    assert rows_of(ngram_join.components(docs)) == brute_components(plain)
    # A chain of near copies, which only links through its members, and a passage that unlike texts share.
    base = [f"b{k}" for k in range(60)]
    chain = [(k, " ".join(base[:s] + [f"x{j}" for j in range(s)] + base[s:])) for k, s in enumerate([0, 0, 1, 2, 3, 4])]
    chain = [(k, " ".join([f"n{j}" for j in range(k)] + base[k:])) for k in range(12)]
    chain += [(100 + k, " ".join(base[:30] + [f"u{k}_{j}" for j in range(200)])) for k in range(20)] + [(500, "")]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert rows_of(ngram_join.components(df)) == brute_components(chain)
    assert ngram_join.keep_one(df).count() == len({c for _, _, c in brute_components(chain)})


def test_connected(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 30)]
    found = components.connected(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "cc"), "t")
    assert sorted(map(tuple, found.collect())) == [(k, 1) for k in range(2, 41)] + [(101, 100), (102, 100)]


def test_fingerprints(docs, plain, spark):
    rows = fingerprints.compare_with_edits(docs, Workspace(spark, "f")).collect()
    want = []
    for k, (i, t) in enumerate(plain):
        following = plain[(k + 1) % len(plain)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + following[:q]
        a, b, c = (fingerprints.fingerprints([x.encode()])[0] for x in (t, e, following))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), bytes(a), bytes(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], bytes(r["fingerprint"]), bytes(r["edited_fingerprint"]), r["near_edited"], r["near_next"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    empty, text = fingerprints.fingerprints([b"", LONG.encode()])
    assert fingerprints.likeness(empty, empty) == fingerprints.likeness(text, text) == 1.0
    assert fingerprints.likeness(empty, text) == 0.0


def test_window_entropy():
    data = np.random.default_rng(1).integers(97, 105, 500).astype(np.uint8)
    sums = fingerprints.window_sums(data) / 65536
    for k in (0, 7, 436, 484):
        counts = Counter(data[k : k + fingerprints.WINDOW].tolist())
        assert abs(sums[k] - sum(c * math.log2(c) for c in counts.values())) < 0.01


def test_language_model_is_the_sum_over_segmentations():
    table = langid.pieces(WORD)
    probs = np.vstack([np.random.default_rng(2).random((len(table), 2)) * 1e-3, np.full((1, 2), langid.FLOOR)])
    number = {t: k for k, t in enumerate(table.texts)}

    def total(word, lang):
        if not word:
            return 1.0
        out = 0.0
        for k in range(1, len(word) + 1):
            p = probs[number[word[:k]], lang] if word[:k] in number else langid.FLOOR if k == 1 else 0.0
            out += p * total(word[k:], lang)
        return out

    words = ["mere", "a", "zażółć", "thtion", "qqqq", "internationally", "recommendations"]
    got = langid.word_scores(table, probs, words)
    assert np.allclose(got, [[math.log(total(w, k)) for k in range(2)] for w in words])
    # Words of any length, across the border between the two ways and across stretches.
    assert np.allclose(got, [langid._long_score(table, probs, w) for w in words])
    long = "recommendationsinternationally" * 3
    assert np.allclose(langid.word_scores(table, probs, [long, long[:32], long[:33]]), [slow(table, probs, number, w) for w in (long, long[:32], long[:33])])
    huge = long * 300
    assert np.allclose(langid.word_scores(table, probs, [huge])[0], slow(table, probs, number, huge))


def slow(table, probs, number, word):
    """The forward algorithm in logarithms, letter by letter, over every piece of the vocabulary."""
    out, longest = [], max(map(len, number))
    for lang in range(probs.shape[1]):
        logs = [0.0]
        for end in range(1, len(word) + 1):
            ways = [logs[end - 1] + math.log(probs[number.get(word[end - 1], -1), lang])]
            ways += [logs[k] + math.log(probs[number[word[k:end]], lang]) for k in range(max(0, end - longest), end - 1) if word[k:end] in number]
            logs.append(max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)))
        out.append(logs[-1])
    return out


def test_piece_counts_are_posteriors_over_segmentations():
    table = langid.pieces(WORD)
    probs = np.vstack([np.random.default_rng(3).random((len(table), 2)) * 1e-3, np.full((1, 2), langid.FLOOR)])
    number = {t: k for k, t in enumerate(table.texts)}
    words, lang, counts = ["themere", "onto", "ß日x", "onto"], np.array([0, 1, 0, 0]), np.array([2.0, 3.0, 1.0, 5.0])

    def cuts_of(word):
        if not word:
            return [[]]
        return [[word[:k], *rest] for k in range(1, len(word) + 1) if k == 1 or word[:k] in number for rest in cuts_of(word[k:])]

    want = np.zeros((len(table), 2))
    for word, own, times in zip(words, lang, counts, strict=True):
        ways = [(cut, math.prod(probs[number.get(p, -1), own] for p in cut)) for cut in cuts_of(word)]
        for cut, chance in ways:
            for piece in cut:
                if piece in number:
                    want[number[piece], own] += times * chance / sum(c for _, c in ways)
    assert np.allclose(langid.expected_counts(table, probs, words, lang, counts), want)


def test_piece_counts_of_long_words_are_those_of_short_ones(monkeypatch):
    table = langid.pieces(WORD)
    probs = np.vstack([np.random.default_rng(4).random((len(table), 2)) * 1e-3, np.full((1, 2), langid.FLOOR)])
    words, lang, counts = ["themereonto", "ß日xhouse", "a", "日", "riverandthestones"], np.array([0, 1, 0, 1, 1]), np.array([2.0, 3.0, 1.0, 4.0, 1.0])
    want = langid.expected_counts(table, probs, words, lang, counts)
    for stretch in (langid.STRETCH, 3):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        monkeypatch.setattr(langid, "SHORT", 0)
        assert np.allclose(langid.expected_counts(table, probs, words, lang, counts), want, atol=1e-12)
        assert np.allclose(langid.word_scores(table, probs, words), [slow(table, probs, {t: k for k, t in enumerate(table.texts)}, w) for w in words])
    # Every letter that is a piece lies in one piece of each segmentation, however long the word.
    monkeypatch.undo()
    word = "".join(np.random.default_rng(5).choice(list("aeinrst"), 40_000))
    uses = langid._long_counts(table, probs[:, 0], word)
    assert abs(sum(len(table.texts[k]) * uses[k] for k in np.flatnonzero(uses)) - len(word)) < 1e-3


def test_language_id(spark):
    en, fr = "the house of the river and the green tree with stones", "la maison de la rivière et des arbres verts avec pierres"
    rows = [(k, en if k % 2 else fr, "en" if k % 2 else "fr", k) for k in range(40)] + [(90, None, "en", 1), (91, "12 .. 3", None, 1), (92, "the tree", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    got = {r["doc_id"]: (r["p"], r["s"]) for r in langid.predict(df, langid.fit(df, WORD), WORD, keep=("doc_id", "score"), out=("p", "s")).collect()}
    assert all(got[k][0] == ("en" if k % 2 else "fr") for k in range(40))
    assert got[90] == got[91] == ("und", 0.0)
    assert got[92][0] == "en"
    nothing = langid.predict(df, langid.fit(df.where("false"), WORD), WORD).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_toxicity(spark):
    rows = [(k, "calm words about the weather today" + (" you idiot" if k % 4 == 0 else ""), k % 4 == 0) for k in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == y for i, _, y in rows)
    assert got[900] == got[901]
    none = toxicity.score(df, toxicity.fit(df, labels.where("false"))).collect()
    assert {r["score"] for r in none} == {0.5}


def test_toxicity_features_are_those_of_a_loop():
    mask = (1 << 64) - 1
    place = lambda h: (((h ^ (h >> 29)) * int(toxicity._PAIR)) & mask) >> (64 - toxicity.BITS)
    texts = ["", "You are a b c", "you, you! you?", "don't--stop stopping 3rd", "ÎN Română și", LONG[:3000], "x" * 40]
    weights = np.random.default_rng(7).integers(0, 2, 1 << toxicity.BITS).astype(np.float32)
    for table, kept in ((toxicity.WordTable(), None), (toxicity.WordTable(weights), weights)):
        text, found = table.features(texts + texts)
        for k, t in enumerate(texts + texts):
            words = [w for chunk in t.lower().split() for w in toxicity._WORD.findall(chunk)]
            h = [xxhash.xxh3_64_intdigest(w) for w in words]
            want = {place(x) for x in h}
            want |= {place((a * int(toxicity._PAIR) + b) & mask) for a, b in zip(h, h[1:], strict=False)}
            want |= {place((a * int(toxicity._SKIP) + b) & mask) for a, b in zip(h, h[2:], strict=False)}
            assert found[text == k].tolist() == sorted(p for p in want if kept is None or kept[p])


def test_ftrl_is_the_update_by_coordinates():
    draw = np.random.default_rng(8)
    model, z, n = toxicity.Ftrl(bits=5), [0.0] * 33, [0.0] * 33

    def weight(i):
        l1 = 0 if i == 32 else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(400):
        places, label = np.unique(draw.integers(0, 32, draw.integers(0, 9))), int(draw.integers(0, 2))
        model.learn(places, label)
        own = [*places.tolist(), 32]
        w = [weight(i) for i in own]
        g = 1 / (1 + math.exp(-sum(w))) - label
        for i, x in zip(own, w, strict=True):
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
            z[i] += g - sigma * x
            n[i] += g * g
    assert np.allclose(model.z, z)
    assert np.allclose(model.weights(np.arange(33)), [weight(i) for i in range(33)])


def brute_lm(rows, held):
    """Scores by dictionaries and recursion over shorter and shorter histories."""
    words = [(i, [*t.encode().lower().split(), None]) for i, t in rows]
    counts = Counter()
    for i, w in words:
        if not held[i]:
            line = ["<s>", *w]
            for n in (1, 2, 3):
                counts.update(tuple(line[k : k + n]) for k in range(n == 1, len(line) - n + 1))
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    counts["<s>",] = counts[None,]

    def p(history, x):
        if not history:
            return (counts[x,] + 0.1) / (n + 0.1 * (v + 1))
        c, keep = counts[history], (lm_score.KEEP_2, lm_score.KEEP_3)[len(history) - 1]
        if c < (1, lm_score.LEAST_SEEN)[len(history) - 1]:
            return p(history[1:], x)
        b = 1 / (1 + keep * math.log1p(c))
        return (1 - b) * counts[*history, x] / c + b * p(history[1:], x)

    out = []
    for i, w in words:
        line = ["<s>", *w]
        score = sum(math.log10(p(tuple(line[max(0, k - 2) : k]), line[k])) for k in range(1, len(line)))
        out.append((i, held[i], len(w), sum(counts[x,] > 0 for x in w), n, sum(math.log10(p((), x)) for x in w), score))
    return sorted(out, key=str)


def test_lm_score(docs, plain):
    from civicforms.llm.common import id_hash

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in plain}
    for got, want in zip(rows_of(lm_score.score(docs, id_hash() % 10 == 0, buckets=3)), brute_lm(plain, held), strict=True):
        assert got[:5] == want[:5]
        assert np.allclose(got[5:], want[5:])


def test_lm_backs_off_at_every_depth(spark, monkeypatch):
    # Held out: known triple, known pair alone, known word alone, unknown word, a history seen once, a long text over many segments and stretches.
    line = "the cat sat on the mat and the cat sat down"
    rows = [(1, line), (2, line + " again"), (3, "once seen pair here"), (10, "the cat sat"), (11, "a mat and sat"), (12, "on down"), (13, "zebra the zebra"), (14, "once seen pair"), (15, None), (16, "")]
    rows += [(20 + k, " ".join([line, "the cat", "dog"][(k * j) % 3] for j in range(400))) for k in range(6)]
    monkeypatch.setattr(lm_score, "STRETCH_TOKENS", 500)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = {i: 10 <= i < 20 or i == 25 for i, _ in rows}
    want = brute_lm([(i, t or "") for i, t in rows], held)
    for got, w in zip(rows_of(lm_score.score(df, df["doc_id"].between(10, 19) | (df["doc_id"] == 25), buckets=5, segment=7)), want, strict=True):
        assert got[:5] == w[:5]
        assert np.allclose(got[5:], w[5:])
    # Untrained: every word has the unknown share.
    assert {round(r["score"], 9) + 0.0 for r in lm_score.score(df, df["doc_id"] > 0).collect()} == {0.0}


def test_chat(spark):
    rows = [(1, 0, "system", "Be brief <|im_end|>"), (1, 1, "user", None), (1, 2, "assistant", "a <\\| b <|im_start|>x"), (2, 0, "ass%\nistant", "r"), (2, 0, "ass%\nistant", "r"), (None, None, None, "t"), (3, 0, "assistant", "w " * 3000)]
    rows += [(4, k, ["user", "assistant"][k % 2], f"turn {k} " * (k * 7 % 60)) for k in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, budget=300, history_tokens=40).persist()
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert windows.where("conv_id = 4").count() > 3
    assert windows.where("conv_id = 4 AND window > 0 AND n_context > 0").count() > 0
    assert all(r["text"].startswith("<|im_start|>system") for r in windows.where("conv_id = 1").collect())


def test_empty_tables(spark, docs):
    none = docs.where("false")
    space = Workspace(spark, "empty")
    for df in (
        bpe.round_trip(none, WORD), packing.pack(none, BYTE, 1), token_output.read_blocks(token_output.write_blocks(none, WORD, 2, space)), exact_dedup.exact_groups(none),
        ngram_join.components(none), fingerprints.compare_with_edits(none, Workspace(spark, "empty")), lm_score.score(none, none["doc_id"] < 0),
        langid.predict(none, langid.fit(none, WORD), WORD), toxicity.score(none, toxicity.fit(none, none.selectExpr("doc_id", "1 AS toxic"))),
        exact_dedup.drop_exact_duplicates(none), ngram_join.keep_one(none), bpe.encode(none, WORD, keep=("doc_id", "text")),
        chat.read_back(chat.format_windows(none.selectExpr("doc_id AS conv_id", "doc_id AS turn", "text AS role", "text"))),
    ):
        assert df.count() == 0


def test_oracles(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        found = registry.queries()[name](spark, sf).toPandas()
        wanted = con.execute(sql).df()[list(found.columns)]
        assert sorted(map(str, found.itertuples(index=False, name=None))) == sorted(map(str, wanted.itertuples(index=False, name=None)))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS score", "'x' AS lang_pred")
    columns, left = docs.columns, docs.count()
    space = Workspace(spark, "pipeline-test")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = space.write(stage(spark, docs, sf), f"{k}-{name}")
        assert docs.columns == columns
        assert 0 < docs.count() <= left
        left = docs.count()
    texts = [r["text"] for r in docs.collect()]
    assert len({"".join(t.split()) for t in texts}) == len(texts)
    assert all(i == c for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()]))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p["doc_id"] for p in packed} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_decisions_are_those_of_its_models(spark, sf, tmp_path):
    """Each stage's rows against a loop over all of its own input, with odd rows added."""
    import corpus_pipeline

    odd = [(None, "Nur ein kurzer Satz über das Wetter und die Stadt."), (None, "A short sentence about the weather and the town."), (5_000_001, None), (5_000_002, " \n"), (5_000_003, "12 .. 3"), (5_000_004, "x" * 30)]
    odd += [(5_000_005, "one text under a repeated identifier"), (5_000_005, "another text under a repeated identifier"), (5_000_005, "another  text under a repeated identifier")]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(i, t, None, "odd", None) for i, t in odd], docs.schema)
    docs = Workspace(spark, "decisions").write(docs.unionByName(more).selectExpr("*", "'x' AS lang_pred", "0.5 AS score"), "docs")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    model = langid.fit(langid.trainable(docs), WORD)
    table, words = langid.pieces(WORD), {}
    want = []
    for i, t in rows:
        own = langid.letter_words((t or "").lower())
        words.update((w, langid.word_scores(table, model.probs, [w])[0]) for w in own if w not in words)
        if own:
            total = np.log(model.prior) + sum(words[w] for w in own)
            if 1 / np.exp(total - total.max()).sum() >= corpus_pipeline.LANGUAGE_POSTERIOR:
                want.append((i, t))
    left = corpus_pipeline.language_id_stage(spark, docs, sf)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(want, key=str)

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    places, weights, bias = toxicity.fit(docs, toxicity.trainable(labels))
    weight = dict(zip(places.tolist(), weights.tolist(), strict=True))
    want = []
    for i, t in rows:
        _, found = toxicity.WordTable().features([t or ""])
        if 1 / (1 + math.exp(-bias - sum(weight.get(p, 0.0) for p in found.tolist()))) < toxicity.THRESHOLD:
            want.append((i, t))
    left = corpus_pipeline.toxicity_stage(spark, docs, sf)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(want, key=str)
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
