"""Filter audit, license scan and vector codes: odd rows against brute force, and against SQL on a small table."""

import hashlib
import itertools
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from civicforms.llm import ball_codes, filter_audit, license_scan
from civicforms.llm.license_scan import Template

WIDE = " ".join(f"Word{k}" for k in range(60))
FLAT = " ".join(["same"] * 60)
DOCS = [
    (1, "short $ text", "a"), (2, WIDE, "a"), (3, FLAT, "a"), (4, FLAT, None), (5, WIDE, ""), (5, WIDE, "b"), (6, None, "b"), (7, "", "a"), (None, FLAT, "a"), (None, "only here", None),
    (8, "ALL CAPS " * 40, "b"), (9, "ALL CAPS " * 40, "b"), (9, "ALL CAPS " * 40, "b"), (2, WIDE, "a"), (10, "\x0bé\x85ü\t" * 70, "a"), (0, FLAT + " %", "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, None, 1), (3, 1, 0), (5, 0, 0), (8, 1, None), (9, 1, 1), (9, 1, 1), (None, 1, 1), (77, 1, 1), (6, 1, 0)]


@pytest.fixture(scope="module")
def audited(spark):
    docs = spark.createDataFrame([(*r, 5, 1) for r in DOCS], "doc_id long, text string, source string, mask int, good int").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").repartition(2)
    return docs, labels


def fails(i, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    first = min((j for j, t, _ in DOCS if j is not None and (t or "") == text), default=None)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first is not None and i > first,
    }


def test_filter_audit_against_a_loop(audited):
    told = lambda i, c: i is not None and any(r[0] == i and r[c] == 1 for r in LABELS)
    want = Counter()
    for part in {s or "" for _, _, s in DOCS}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(5):
                want[part, order, step + 1] = np.zeros(6, int)
    for i, text, source in DOCS:
        failing = fails(i, text or "")
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                here = failing[f] and not gone
                want[source or "", order, step] += np.array([
                    not failing[f] and not gone, here, failing[f] and gone, failing[f] and sum(failing.values()) == 1, here and told(i, 1), here and told(i, 2),
                ])
                gone |= failing[f]
    shares = Counter()
    for (part, order, step), counts in want.items():
        shares[part, order[step - 1]] += counts[1]
    found = filter_audit.audit(*audited).collect()
    assert len(found) == len(want) == 4 * 600
    for r in found:
        key = r["part"], r["filter_order"], r["step"]
        assert [r[c] for c in filter_audit.COUNTS] == want[key].tolist(), key
        assert r["shapley"] == shares[r["part"], r["filter_order"][r["step"] - 1]]


def test_empty_tables(spark, audited):
    docs, labels = audited
    assert filter_audit.audit(docs.where("false"), labels).collect() == []
    assert filter_audit.audit(docs, labels.where("false")).agg({"good_lost": "sum"}).first()[0] == 0
    assert license_scan.scan(docs.where("false")).collect() == []
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = ball_codes.quantize(vectors)
    assert ball_codes.with_label_error(coded).collect() == [] and books.size == 0


FILLER = ["stone", "river", "cloud", "the", "of", "license", "by", "public"]
NOTICE = list(license_scan.NOTICES)[0].split()


def license_texts():
    rng = np.random.default_rng(5)
    filler = lambda n: [FILLER[k] for k in rng.integers(0, len(FILLER), n)]
    texts = [None, "", " .,;\n", "CC BY cc-by Cc.By", "cc", "by cc", "ALL rights\nreserved all rights all rights reserved", "GNU General Public License, version 3", "éa général public license ß cc\x80by",
             "general public licence", "Licensed under CC BY-NC 4.0.", "Released under the MIT License."]
    for share in (1.0, 0.9, 0.8, 0.75, 0.5):
        for before in (0, 3, 31, 64, 1000):
            held = [w for w in NOTICE if rng.random() < share]
            texts.append(" ".join(filler(before) + held + filler(20)))
    texts.append(" ".join(filler(40_000) + ["all", "rights", "reserved"] + filler(7) + NOTICE))
    texts += [" ".join([*filler(n), "all", "rights", "reserved"]) for n in range(10)]
    return texts


def brute_force(text, templates, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, base, labels, best = [], set(), set(), 0.0
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        starts += at
        if at:
            base.add(label)
            labels.add(label)
            best = 1.0
    for t in templates:
        s = 1
        while s < len(t.words):
            s *= 2
        wanted = set(t.words)
        for b in range(0, len(words), s):
            share = len(wanted & set(words[b : b + 2 * s])) / len(wanted)
            if share >= t.threshold - 1e-9:
                labels.add(t.label)
                best = max(best, share)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best


@pytest.mark.parametrize("templates", [license_scan.TEMPLATES, [Template("x", ("river", "stone", "river"), 0.5), Template("y", tuple(NOTICE), 0.3), Template("z", ("the",), 1.0), Template("none", (), 0.8)]])
def test_license_scan_against_every_block(spark, templates):
    texts = license_texts()
    rows = spark.createDataFrame([(k % 30, t, "note") for k, t in enumerate(texts)], "doc_id long, text string, license string").repartition(3)
    found = license_scan.scan(rows, templates, keep=("doc_id", "license"))
    assert found.columns[:2] == ["doc_id", "license"]
    want = sorted(((k % 30, "note", *brute_force(t, [x for x in templates if x.words], license_scan.PHRASES)) for k, t in enumerate(texts)), key=repr)
    assert sorted(map(tuple, found.collect()), key=repr) == want


def test_license_scan_in_stretches_and_clashes(spark, monkeypatch):
    text = license_texts()[-11]
    whole = license_scan.places(text, {b"all": 0, b"reserved": 1})
    split = license_scan._stretches
    monkeypatch.setattr(license_scan, "_stretches", lambda t: split(t, 50))
    pieces = license_scan.places(text, {b"all": 0, b"reserved": 1})
    assert whole[0] == pieces[0] and all((a == b).all() for a, b in zip(whole[1:], pieces[1:], strict=True))
    with pytest.raises(ValueError, match="labels"):
        license_scan.scan(spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, labels string"), keep=("doc_id", "labels"))


def test_prefix_filter_loses_nothing_whatever_the_order():
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(12)]
    for _ in range(200):
        templates = [Template(f"t{k}", tuple(rng.choice(words, rng.integers(1, 9))), float(rng.choice([0.3, 0.5, 0.8, 1.0]))) for k in range(4)]
        matcher = license_scan.Matcher(templates, {w: int(rng.integers(0, 5)) for w in words})
        text = [*rng.choice([*words, "x", "y"], rng.integers(0, 60))]
        n, at, which = license_scan.places(" ".join(text), matcher.rank)
        want = set()
        for k, t in enumerate(templates):
            s = license_scan.stride(t)
            for b in range(math.ceil(len(text) / s)):
                shared = len(set(t.words) & set(text[b * s : b * s + 2 * s]))
                if shared >= license_scan.least_shared(t):
                    want.add((k, b, shared))
        assert set(matcher.blocks(n, at, which)) == want


def plain_codes(rows, parts, entries, rounds):
    """Lloyd's rounds by comparing every part with every entry, in whole numbers."""
    usable = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    usable = [(i, [math.floor(float(np.float32(x)) * 1024) for x in v], label) for i, v, label in usable if len(v) == len(rows[0][1])]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(usable[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in usable]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        codes = [[min((far(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        if k == rounds:
            break
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes, strict=True) if code[p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(r[0], [d[1] for d in code], sum(d[0] for d in code), r[2]) for r, code in zip(usable, codes, strict=True)]
    return out, books


def vector_rows(n, width, step, seed):
    rng = np.random.default_rng(seed)
    rows = [(k * 3, [float(x) for x in np.round(rng.normal(size=width) / step) * step], [0, 1, None][k % 3]) for k in range(n)]
    rows += [(1, rows[0][1], 0), (1, rows[5][1], None), (1, rows[5][1], None), (None, rows[7][1], 1)]
    odd = [(2, None, 0), (4, [], 0), (5, [1.0] * (width - 1) + [None], 0), (6, [float("nan")] * width, 0), (7, [float("-inf")] * width, None), (8, [1.0] * (width + 4), 1)]
    return rows + odd


@pytest.mark.parametrize(("n", "width", "entries", "step"), [(60, 8, 16, 0.5), (120, 4, 40, 0.002), (10, 16, 256, 0.25)])
def test_ball_codes_against_all_distances(spark, n, width, entries, step):
    rows = vector_rows(n, width, step, n)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    coded, books = ball_codes.quantize(table, entries=entries)
    want, plain = plain_codes(rows, 4, entries, 4)
    assert books.tolist() == plain
    assert sorted(map(repr, ((r["vec_id"], list(r["code"]), r["error"], r["label"]) for r in coded.collect()))) == sorted(map(repr, want))
    sums = Counter()
    for _, _, error, label in want:
        sums[label] += error
    assert {(r["label"], r["label_error"]) for r in ball_codes.with_label_error(coded).collect()} == set(sums.items())


def test_balls_assign_like_all_distances():
    rng = np.random.default_rng(1)
    for size in (3, 40, 1 << 25):
        before = rng.integers(-size, size, (50, 3))
        before[7] = before[3]
        x = rng.integers(-size, size, (400, 3))
        own, _ = ball_codes.Balls(before, None).assign(x, None)
        entries = np.where(rng.random((50, 1)) < 0.3, before + rng.integers(-max(1, size // 10), max(2, size // 10), (50, 3)), before)
        far = ((x[:, None, :].astype(object) - entries[None]) ** 2).sum(axis=2)
        code, away = ball_codes.Balls(entries, before).assign(x, own)
        assert code.tolist() == [min(range(50), key=lambda j: (row[j], j)) for row in far]
        assert away.tolist() == [min(row) for row in far]


def test_books_digest():
    books = np.array([[[1, -2], [3, 4]]])
    assert ball_codes.books_digest(books) == hashlib.sha256(b"1,-2,3,4").hexdigest()


@pytest.mark.parametrize("module", [filter_audit, license_scan, ball_codes])
def test_sql_says_the_same(spark, sf, module):
    query = next(v for k, v in vars(module).items() if re.match(r"op\d+_", k))
    found = query(spark, sf)
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(module.ORACLE)
    assert sorted(want.columns) == sorted(found.columns)
    assert sorted(map(repr, (tuple(r) for r in found.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
