"""Bounds on memory, clashing names, and joins in which nothing can link."""

import random
import re
import sys

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from civicforms.llm import bpe, chunks, langid, ngram_join, toxicity
from civicforms.llm.common import fewest_hashes

WORD = P.path("word_bpe_49k.json")


def test_cache_is_bounded_by_bytes_and_forgets_nothing_it_needs():
    made = []

    def fill(new):
        made.extend(new)
        return [c.encode() * 3 for c in new]

    cache = chunks.TwoGenerations(fill, most=200_000)
    texts = [[f"{k % 90:03}" + "漢" * 400, "short", f"{k:05}"] for k in range(2000)]
    weight = lambda d: sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items())
    most = 0
    for chunked in texts:
        assert list(cache.values_of([chunked]))[0] == [c.encode() * 3 for c in chunked]
        most = max(most, weight(cache) + weight(cache.elder))
    assert most < 2 * 200_000 + 10_000
    assert len(made) > len({c for t in texts for c in t})  # some had to be made again: it was emptied
    assert made.count("short") == 1  # what is used again and again stays


def test_known_chunks_are_looked_up_once():
    class Counted(chunks.TwoGenerations):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    cache = Counted(lambda new: [c.encode() for c in new])
    known = [f"w{k}" for k in range(1000)]
    cache.values_of([known])
    Counted.asked = 0
    texts = [known, [], ["new", *known, "new"], ["other", "w3"]]
    assert [list(v) for v in cache.values_of(iter(texts))] == [[c.encode() for c in t] for t in texts]
    # Two new chunks at three places; the 2,001 places of known ones have their values from the first look.
    assert Counted.asked <= 3


def test_quick_searches_find_what_the_plain_ones_do():
    rng = random.Random(5)
    plain, separators = re.compile(r"(?:[^\w\s]|_)[.,]\s"), re.compile("[\x1c-\x1f]")
    signs = "ab_é.,.,!- \n\x1c\x1f\u0301\u2009"
    texts = ["".join(rng.choices(signs, k=rng.randrange(7))) for _ in range(20_000)]
    assert all(bool(plain.search(t)) == bool(chunks._CLUSTER.search(t)) for t in texts)
    assert all(bool(separators.search(t)) == any(c in t for c in chunks._SEPARATORS) for t in texts)


def test_long_chunks_through_the_word_cache(monkeypatch):
    bpe._round_trip_cache.cache_clear()
    monkeypatch.setattr(chunks.TwoGenerations.__init__, "__defaults__", (chunks.CACHE_ENTRIES, 1 << 20, chunks.TwoGenerations.__init__.__defaults__[2]))
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 400))) for _ in range(400)] * 2
    library = Tokenizer.from_file(WORD)
    want = [" ".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]
    for start in range(0, len(texts), 50):
        assert [r[1] for r in bpe._round_trips(WORD, texts[start : start + 50])] == want[start : start + 50]
    cache = bpe._round_trip_cache(WORD)
    assert 0 < cache.held < (2 << 20) and cache.elder
    bpe._round_trip_cache.cache_clear()


@pytest.mark.parametrize("column", ["n_tokens", "ids_text", "decoded"])
def test_columns_called_as_results_are_refused(spark, column):
    docs = spark.createDataFrame([(1, "a b", "x")], f"doc_id long, text string, {column} string")
    with pytest.raises(ValueError, match=column):
        bpe.round_trip(docs, WORD, keep=("doc_id", column))
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(docs.withColumnRenamed(column, "ids"), WORD, keep=("doc_id", "ids"))
    with pytest.raises(ValueError, match="decoded"):
        bpe.decode(docs.selectExpr("doc_id", "array(1) AS ids", "'x' AS decoded"), WORD, keep=("decoded",))


def test_join_in_which_nothing_can_link(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(k))) for k in range(12)] + [(None, None), (50, "")], "doc_id long, text string").repartition(3)
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs).collect()}
    assert rows == {(k, max(min(k, 1), k - 4), k) for k in range(12)} | {(None, 0, None), (50, 0, 50)}
    assert ngram_join.keep_one(docs).count() == 14
    assert ngram_join.components(docs.where("false")).collect() == []


def test_samples_never_exceed_their_bound(spark):
    rows = spark.range(0, 3000, 1, 7).selectExpr("nullif(id % 2500, 17) AS doc_id")
    for most in (0, 1, 40, 2999, 3000):
        found = [r["doc_id"] for r in fewest_hashes(rows, most, "x").collect()]
        assert max(0, most - 2) <= len(found) <= most  # of an identifier's two rows none or both
    first, more = ({r["doc_id"] for r in fewest_hashes(rows, n, "x").collect()} for n in (40, 80))
    assert first < more
    same = spark.range(50).selectExpr("id * 0 AS doc_id")
    assert fewest_hashes(same, 10, "x").count() == 0
    assert fewest_hashes(rows.where("false"), 5, "x").count() == 0


def test_models_refuse_clashing_names_and_a_dirty_language_column(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{'x' * 50} house", f"l{k}", "a") for k in range(4)], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs, WORD)
    assert len(model.langs) == 4
    with pytest.raises(ValueError, match="score"):
        langid.predict(docs, model, WORD, keep=("doc_id", "score"))
    with pytest.raises(ValueError, match="score"):
        toxicity.score(docs, (np.zeros(0, int), np.zeros(0), 0.0), keep=("score",))
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    with pytest.raises(ValueError, match="distinct values of lang"):
        langid.fit(docs, WORD)


def test_word_table_is_emptied_between_slices(monkeypatch):
    texts = [f"word{k} other{k % 3} same {'long' * 9}" for k in range(60)]
    want = [toxicity.WordTable().features([t])[1].tolist() for t in texts]
    for limits in ((10, 1 << 30), (1 << 30, 100)):
        monkeypatch.setattr(toxicity, "CACHE_CHUNKS", limits[0])
        monkeypatch.setattr(toxicity, "CACHE_LETTERS", limits[1])
        table = toxicity.WordTable()
        for t, places in zip(texts, want, strict=True):
            assert table.features([t])[1].tolist() == places
            assert len(table.row) <= 14
    assert toxicity.WordTable().features(["", "!"])[0].tolist() == []
