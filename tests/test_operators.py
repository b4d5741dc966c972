"""Order-dependent operators against plain loops, streams against batches, sources and sinks round trip."""

import json
from collections import Counter

from pyspark.sql import Observation
from pyspark.sql import functions as F

from civicforms.functions import text as t
from civicforms.functions import urls
from civicforms.operators import catalog, html, layout, linkage, raster, validation, votes
from civicforms.plans.views import view
from civicforms.sources import readers, sinks
from civicforms.streaming.votes import incremental_ingest


def by_page(rows):
    pages = {}
    for r in rows:
        pages.setdefault((r["doc_id"], r["page"]), []).append(r)
    return pages


def test_greedy_match(spark, sf):
    pairs = layout.iou_pairs(view(spark, sf, "v_truth"), view(spark, sf, "v_detected")).persist()
    wanted = set()
    for page, rows in by_page(pairs.collect()).items():
        used_g, used_d = set(), set()
        for r in sorted(rows, key=lambda r: (r["iou"], r["gi"], r["di"]), reverse=True):
            if r["gi"] not in used_g and r["di"] not in used_d:
                used_g.add(r["gi"])
                used_d.add(r["di"])
                wanted.add((*page, r["gi"], r["di"]))
    assert {(r["doc_id"], r["page"], r["gi"], r["di"]) for r in layout.greedy_match(pairs).collect()} == wanted
    assert wanted


def test_dedupe_overlap(spark, sf):
    boxes = view(spark, sf, "v_detected").withColumns({c: F.col(c).cast("double") for c in ("x", "y", "w", "h")}).persist()

    def ratio(a, b):
        w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
        h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
        return max(w, 0) * max(h, 0) / min(a["w"] * a["h"], b["w"] * b["h"])

    wanted = []
    for page, rows in by_page(boxes.collect()).items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r["confidence"], r["pos"], r["h"], r["w"], r["x"], r["y"])):
            if all(ratio(r, k) <= 0.5 for k in kept):
                kept.append(r)
        wanted += [(*page, r["pos"]) for r in kept]
    found = [(r["doc_id"], r["page"], r["pos"]) for r in layout.dedupe_overlap(boxes).collect()]
    assert sorted(found) == sorted(wanted)


def test_cluster_rows(spark):
    ys = [0, 2, 3, 4, 6, 7, 50, 53, 54]
    df = spark.createDataFrame([(1, 0, i, float(y)) for i, y in enumerate(ys)], "doc_id long, page int, pos int, y double")
    anchors, wanted = [], []
    for y in ys:
        hit = next((a for a in anchors if abs(a - y) <= 3), None)
        if hit is None:
            anchors.append(y)
            hit = y
        wanted.append(float(hit))
    assert [r["band"] for r in layout.cluster_rows_by_y(df).orderBy("pos").collect()] == wanted


def test_digit_row_replaces_its_checkboxes(spark):
    boxes = [(1, 0, k, "rect", "", 20 * k, 100, 12, 12) for k in range(13)] + [(1, 0, 50, "rect", "", 400, 300, 10, 10), (1, 0, 60, "text", "........", 0, 500, 40, 10)]
    found = layout.detect_fields(spark.createDataFrame(boxes, "doc_id long, page int, pos int, kind string, text string, x long, y long, w long, h long")).collect()
    assert sorted((r["context"], r["x"], r["w"]) for r in found) == [("digit_boxes", 0.0, 252.0), ("dot_sequence", 0.0, 40.0), ("small_square", 400.0, 10.0)]


def test_running_counters_end_at_counts(spark, sf):
    rows = view(spark, sf, "v_votes")
    last = votes.vote_transitions(rows).groupBy("template_id").agg(F.sum("d_up").alias("up"), F.sum("d_down").alias("down"))
    assert sorted(last.collect()) == sorted(votes.vote_counts(rows).select("template_id", "up", "down").collect())


def test_scalars(spark):
    df = spark.createDataFrame([("sect.firstName_b", "Form_a_12", "bundle-3/a/b_9", "tel: 0721\nE-mail : a@b\ntel: 1/2", " https://x/a%20b%2Fc+d ")], "f string, s string, k string, c string, u string")
    r = df.select(
        t.prettify_field_name("f").alias("pretty"), t.doc_id_from_stem("s").alias("id"), t.template_name_from_stem("s").alias("name"), *[c.alias(n) for n, c in zip(("bundle", "stem"), t.split_progress_key("k"), strict=True)],
        t.contact_block("c").alias("contact"), t.normalize_url("u").alias("url"), urls.absolute_url(F.lit("/a"), "https://h").alias("abs"), t.organization_from_path(F.lit("a/b/c.pdf")).alias("org"),
        linkage.next_free_name(F.lit("n"), F.array(F.lit("n"), F.lit("n_2"))).alias("free"), t.to_iso_string(F.lit("1700000000")).alias("iso"), t.normalize_comment(F.lit("  ")).alias("comment"),
        t.phone_href(F.lit("07 21/08")).alias("phone"), t.match_pattern(F.lit("data nasterii"))["id"].alias("kind"), t.clean_label_ocr(F.lit("1. 2) Nume :")).alias("label"),
    ).first()
    assert r.asDict() == {
        "pretty": "First Name B", "id": "12", "name": "Form a", "bundle": "bundle-3", "stem": "a/b_9", "contact": {"e-mail": "a@b", "tel": "1/2"}, "url": "https://x/a b%2Fc+d", "abs": "https://h/a",
        "org": "b", "free": "n_3", "iso": "2023-11-14T22:13:20.000Z", "comment": None, "phone": "0721", "kind": "date", "label": "Nume",
    }


PAGE = """<h1 class="page-title"> A&amp;B </h1><div class="csslabelsmall">Taxe</div><div class="csslabellarge"><p>10 lei</p>x<br>y</div><div class="csslabelsmall">Altceva</div>
<table class="proc-viz-documenteintrare"><tbody><tr class="tabel-header"><td>h</td></tr><tr><td>1</td><td>Cerere</td><td>d</td><td><span class="glyphicon-ok"></span></td><td></td><td>pdf</td><td><a href="/f.pdf">f</a></td></tr></tbody></table>"""


def test_procedure_page(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", '<div class="cssPanelEroare">gone</div>'), (3, "u", None)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in html.parse_procedures(pages, "https://h").collect()}
    assert rows[1]["title"] == "A&B"
    assert rows[1]["fields"] == {"taxe": "10 lei\nx\ny"}
    assert [d.asDict() for d in rows[1]["documents"]] == [{"nr": "1", "name": "Cerere", "description": "d", "required": True, "e_signature": False, "type": "pdf", "download_url": "https://h/f.pdf"}]
    assert [rows[k]["status"] for k in (1, 2, 3)] == ["ok", "missing", "ok"]
    assert html.flatten(html.parse_procedures(pages, "https://h"), "documents").count() == 1


def test_page_nested_to_any_depth():
    deep = 5_000
    page = "<div>" * deep + '<h1 class="page-title">in<b>ner</b></h1><p>x</p>' + "</i>" * deep + "</div>" * deep + '<div class="csslabelsmall">after</div><div class="csslabellarge">' + "<p>" * deep + "y<br>z</div>"
    found = html.parse_page(page)
    assert (found["title"], found["labels"], found["field_values"], found["paragraphs"]) == ("inner", ["after"], ["y\nz"], deep + 1)


def test_running_counters_against_a_loop(spark):
    rows = [(k % 7 % 3, k, f"2024-01-01 0{k * 7 % 5}:{k % 60:02d}:00", (k * k) % 3 - 1, (k * 5) % 3 - 1) for k in range(200)] + [(None, 900, None, 1, 0), (0, 901, None, 1, 1), (0, 902, None, -1, 1)]
    df = spark.createDataFrame(rows, "template_id int, event_id int, t string, d_up int, d_down int").withColumn("ts", F.col("t").cast("timestamp"))
    sums, wanted = {}, {}
    for template, event, _, up, down in sorted(rows, key=lambda r: (r[2] or "", r[1])):
        a, b = sums.get(template, (0, 0))
        sums[template] = a + up, b + down
        wanted[event] = max(a + up, 0), max(b + down, 0)
    found = votes.running_counters(df)
    assert found.columns == [*df.columns, "up", "down"]
    assert {r["event_id"]: (r["up"], r["down"]) for r in found.collect()} == wanted


def test_detection_metrics(spark, sf):
    truth, found = view(spark, sf, "v_truth"), view(spark, sf, "v_detected")
    matches = layout.greedy_match(layout.iou_pairs(truth, found)).persist()
    count = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    n_true, n_found, hits = count(truth), count(found), count(matches)
    rows = layout.detection_metrics(truth, found, matches).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(n_true | n_found)
    for r in rows:
        k = r["doc_id"]
        assert (r["tp"], r["fp"], r["fn"]) == (hits[k], n_found[k] - hits[k], n_true[k] - hits[k])
        precision, recall = hits[k] / max(n_found[k], 1), hits[k] / max(n_true[k], 1)
        f1 = 2 * precision * recall / (precision + recall) if hits[k] else 0.0
        assert all(abs(a - b) < 1e-12 for a, b in zip((r["precision"], r["recall"], r["f1"]), (precision, recall, f1), strict=True))


def test_dedupe_near(spark):
    rows = [(k % 3, k % 2, k, ("text", "checkbox")[k % 5 == 0], float(k * 37 % 60), float(k * 53 % 40), (k * 17 % 10) / 10) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id int, page int, pos int, type string, x double, y double, confidence double")
    wanted = []
    for page, boxes in by_page(df.collect()).items():
        kept = []
        for b in sorted(boxes, key=lambda r: r["pos"]):
            at = next((i for i, k in enumerate(kept) if k["type"] == b["type"] and abs(k["x"] - b["x"]) < 10 and abs(k["y"] - b["y"]) < 10), None)
            if at is None:
                kept.append(b)
            elif b["confidence"] > kept[at]["confidence"]:
                kept[at] = b
        wanted += [(*page, k["pos"]) for k in kept]
    assert sorted((r["doc_id"], r["page"], r["pos"]) for r in layout.dedupe_near(df).collect()) == sorted(wanted)


def test_nearest_label_px(spark):
    fields = [(k % 2, 0, k, 100 + k * 41 % 300, k * 29 % 200, 60, 12) for k in range(40)]
    texts = [(k % 2, 0, 100 + k, ("Nume", "....", "Adresa mea", "12")[k % 4], k * 67 % 380, k * 31 % 210, 30 + k % 40, 10) for k in range(60)]
    shape = "doc_id int, page int, pos int, {}x int, y int, w int, h int"
    df, labels = spark.createDataFrame(fields, shape.format("")), spark.createDataFrame(texts, shape.format("text string, "))
    readable = {r["text"] for r in labels.where(~t.is_placeholder_ocr("text") & t.is_readable_ocr("text")).collect()}
    wanted = {}
    for d, _, pos, x, y, w, h in fields:
        left, above = [], []
        for e, _, place, text, lx, ly, lw, lh in texts:
            if e == d and text in readable:
                gap, up = x - (lx + lw), y - (ly + lh)
                if abs((ly + lh / 2) - (y + h / 2)) <= 22 and -20 <= gap <= 600:
                    left.append((gap, place, text))
                if 0 <= up <= 70 and lx + lw >= x - 30 and lx <= x + w + 30:
                    above.append((up, place, text))
        wanted[pos] = min(left or above, default=(0, 0, None))[2]
    assert {r["pos"]: r["label"] for r in layout.nearest_label_px(df, labels).collect()} == wanted
    assert len(set(wanted.values())) > 1


def test_sources_and_sinks(spark, sf, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"entries": [{"id": "1"}, {"id": "2"}]}))
    (tmp_path / "n.json").write_text(json.dumps([{"id": "3"}]))
    (tmp_path / "k.json").write_text(json.dumps({"a": {"v": 1}, "b": {"v": 2}}))
    folder = tmp_path / "files" / "bundle-7"
    folder.mkdir(parents=True)
    (folder / "A.PDF").write_text("x")
    (folder / "a.fields.json").write_text(json.dumps({"source": "s", "avgConfidence": 0.5, "fields": [{"type": "text"}]}))
    (folder / "b.fields.json").write_text("{broken")
    assert [r["id"] for r in readers.scan_manifest(spark, f"{tmp_path}/m.json", "id: string").orderBy("ordinal").collect()] == ["1", "2"]
    assert [r["id"] for r in readers.scan_manifest(spark, f"{tmp_path}/n.json", "id: string").collect()] == ["3"]
    assert sorted((r["key"], r["v"]) for r in readers.scan_keyed_map(spark, f"{tmp_path}/k.json", "v: int").collect()) == [("a", 1), ("b", 2)]
    files = readers.scan_files_by_suffix(spark, f"{tmp_path}/files", ".pdf")
    assert [r["bundle"] for r in readers.scan_bundles(files).collect()] == [7]
    assert sorted((r["stem"], r["n_fields"]) for r in readers.scan_detector_outputs(spark, f"{tmp_path}/files").collect()) == [("a", 1), ("b", 0)]
    wanted, counts = spark.createDataFrame([("bundle-7", "a"), ("bundle-7", "b"), ("bundle-9", "c"), (None, "d")], "bundle string, stem string"), Observation()
    outputs = readers.scan_detector_outputs(spark, f"{tmp_path}/files", wanted, counts).collect()
    assert sorted((r["stem"], r["n_fields"], r["status"]) for r in outputs) == [("a", 1, "read"), ("b", 0, "broken"), ("c", 0, "missing"), ("d", 0, "missing")]
    assert counts.get == {"read": 1, "broken": 1, "missing": 2}

    slim = view(spark, sf, "v_templates")
    metrics = sinks.sink_slim_catalog(slim, f"{tmp_path}/catalog").first()
    assert metrics["count"] == slim.count() == readers.scan_catalog(spark, f"{tmp_path}/catalog").count()
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string")
    merged = sinks.keyed_merge(target, spark.createDataFrame([(2, "c"), (3, "d")], "k int, p string"), "k")
    assert sorted(map(tuple, merged.collect())) == [(1, "a", "x"), (2, "c", "y"), (3, "d", None)]


def test_incremental_ingest(spark, tmp_path):
    schema = "id int, v string"
    incoming, root = f"{tmp_path}/in", f"{tmp_path}/out"
    problem = F.when(F.col("v").isNull(), "no value")
    for batch in ([(1, "a"), (2, None), (1, "a")], [(1, "again"), (3, "c")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(incoming)
        rows, dead = incremental_ingest(spark.readStream.schema(schema).parquet(incoming), root, "id", problem)
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (3, "c")]
    assert [r["reason"] for r in dead.collect()] == ["no value"]


def test_detect_fields_with_signed_boxes(spark):
    """A loop over each page: dots, underscores, squares, underlines and digit rows in this order, then near ones once."""
    texts = ["....", "_____", "....____", "Nume", "a...."]
    rows = [(k % 2, 0, k, "text", texts[k % 5], k * 37 % 200, k * 11 % 90, (0, 40)[k % 2], 10) for k in range(40)]
    rows += [(k % 2, 0, 100 + k, "rect", None, k * 29 % 260, k * 17 % 90, (-1, 1)[k % 2] * (9 + k % 4), (-1, 1)[k % 3 == 0] * (9 + k % 3)) for k in range(60)]
    rows += [(1, 0, 300 + k, "rect", None, 10 + 14 * k, 120 + k % 3, 12, (-1, 1)[k % 2] * 12) for k in range(14)]
    rows += [(k % 2, 0, 400 + k, "rect", None, k * 31 % 200, k * 13 % 90, (-1, 1)[k % 2] * (40 + k), (-1, 1)[k % 3 == 0]) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, page int, pos int, kind string, text string, x int, y int, w int, h int")
    wanted = []
    for doc in (0, 1):
        page = [r for r in rows if r[0] == doc]
        drawn = [r for r in page if r[3] == "rect"]
        top = lambda r: r[6] + min(r[8], 0)
        fields = []
        for sign, worth in ((".", 0.95), ("_", 0.93)):
            for r in page:
                n = r[4].count(sign) if r[4] else 0
                if n >= 4 and n / len(r[4]) > 0.5 and not (sign == "_" and r[4].count(".") >= 4 and r[4].count(".") / len(r[4]) > 0.5):
                    fields.append((r[2], "text", r[5], r[6] - 2, r[7] or len(r[4]) * r[8] * 0.5, r[8] + 4, worth))
        for r in drawn:
            w, h = abs(r[7]), abs(r[8])
            if 5 <= w <= 15 and 5 <= h <= 15 and abs(w - h) <= 2:
                fields.append((r[2], "checkbox", r[5], top(r), w, h, 0.90))
        for r in drawn:
            if abs(r[8]) <= 2 and abs(r[7]) >= 30 and not any(abs(f[3] - top(r)) < 15 and abs(f[2] - r[5]) < 20 for f in fields):
                fields.append((r[2], "text", r[5], top(r), abs(r[7]), 14, 0.85))
        groups = []
        for r in sorted((r for r in drawn if 8 < abs(r[7]) < 25 and 8 < abs(r[8]) < 25), key=lambda r: r[6]):
            for g in groups:
                if abs(g[0][6] - r[6]) <= 3:
                    g.append(r)
                    break
            else:
                groups.append([r])
        for g in groups:
            if len(g) >= 13:
                g.sort(key=lambda r: r[5])
                first, end = g[0], g[-1][5] + abs(g[-1][7])
                fields = [f for f in fields if not (f[1] == "checkbox" and abs(f[3] - top(first)) < 5 and first[5] - 5 <= f[2] <= end + 5)]
                fields.append((min(r[2] for r in g), "text", first[5], top(first), end - first[5], abs(first[8]), 0.92))
        kept = []
        for f in fields:
            at = next((i for i, k in enumerate(kept) if k[1] == f[1] and abs(k[2] - f[2]) < 10 and abs(k[3] - f[3]) < 10), None)
            if at is None:
                kept.append(f)
            elif f[6] > kept[at][6]:
                kept[at] = f
        wanted += [(doc, *f) for f in kept]
    found = [(r["doc_id"], r["pos"], r["type"], r["x"], r["y"], r["w"], r["h"], r["confidence"]) for r in layout.detect_fields(df).collect()]
    assert sorted(found) == sorted(wanted)
    assert {"digit_boxes", "underline_rect", "small_square", "dot_sequence"} <= {r["context"] for r in layout.detect_fields(df).collect()}


def test_huge_boxes_meet_others_without_very_many_cells(spark):
    shape = "doc_id int, page int, pos int, x double, y double, w double, h double"
    truth = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 1e10, 1e10), (1, 0, 2, 5.0, 5.0, 10.0, 10.0), (1, 0, 3, -50.0, 0.0, 2000.0, 40.0)], shape)
    found = spark.createDataFrame([(1, 0, 7, 0.0, 0.0, 9e9, 1e10), (1, 0, 8, 5.0, 5.0, 10.0, 9.0), (1, 0, 9, 0.0, 0.0, 1950.0, 40.0), (2, 0, 1, 0.0, 0.0, 1e10, 1e10)], shape)
    assert sorted((r["gi"], r["di"]) for r in layout.iou_pairs(truth, found).collect()) == [(1, 7), (2, 8), (3, 9)]


def test_contours_become_shapes(spark):
    rows = [(1, 0, 1, 10, 10, 300, 3), (1, 0, 2, 12, 11, 302, 4), (1, 0, 3, 10, 10, 59, 3), (1, 0, 4, 10, 50, 60, 5), (1, 0, 5, 90, 90, 20, 22), (1, 0, 6, 95, 90, 20, 22), (1, 0, 7, 90, 90, 20, 30), (1, 0, 8, 90, 200, 60, 4)]
    shapes = raster.shapes_of_contours(spark.createDataFrame(rows, "doc_id int, page int, pos int, x int, y int, w int, h int"))
    assert sorted((r["pos"], r["kind"], round(r["conf"], 6)) for r in shapes.collect()) == [(1, "underline", 0.95), (5, "checkbox", 0.8), (8, "underline", 0.7)]


def test_points_there_and_back(spark):
    row = spark.range(1).select(*[F.lit(v).alias(c) for c, v in zip("xywh", (10.0, 20.0, 30.0, 5.0), strict=True)])
    up = row.select(*[c.alias(k) for k, c in layout.px_to_pt(*map(F.col, "xywh"), F.lit(1.0), F.lit(None).cast("double")).items()])
    assert tuple(up.first()) == (10.0, 841.89 - 25, 30.0, 5.0)
    back = up.select(*[c.alias(k) for k, c in layout.pt_from_top(*map(F.col, "xywh"), F.lit(None).cast("double")).items()])
    assert [round(x, 9) for x in back.first()] == [10.0, 20.0, 30.0, 5.0]


LINKS = {
    "a/b": "https://forms.example/dir/a/b", "/a/../b/./c": "https://forms.example/b/c", "../../x": "https://forms.example/x", "?q=1": "https://forms.example/dir/page.html?q=1",
    "#f": "https://forms.example/dir/page.html?z=1#f", "": None, "  /x y ": "https://forms.example/x%20y", "//CDN.Example:443/p": "https://cdn.example/p", "http://H:80/": "http://h/",
    "https:foo": "https://forms.example/dir/foo", "https:///h/x": "https://h/x", "mailto:a@b": "mailto:a@b", "a\\b": "https://forms.example/dir/a/b", "/ă/%2e%2E/ț": "https://forms.example/%C8%9B",
    "//bad host/": None, "//": None, "http://h:99999/": None, "/a/..": "https://forms.example/", "/a/.": "https://forms.example/a/", "x?y z'#\"": "https://forms.example/dir/x?y%20z%27#%22",
    "http://u:p@h/": "http://u:p@h/", "/😀": "https://forms.example/%F0%9F%98%80", "http://h:0/": "http://h:0/", "a/./b/../../..": "https://forms.example/", "\tx\n": "https://forms.example/dir/x",
    "HTTP://ex.ro": "http://ex.ro/", "ftp://h:21/a?#": "ftp://h/a?#", "data:text/x,y z": "data:text/x,y z", "http://h:8a/": None, "http://[::1]:8080/": "http://[::1]:8080/",
}


def test_links_by_the_standard(spark):
    df = spark.createDataFrame([(k,) for k in LINKS] + [(None,)], "href string")
    found = {r["href"]: r["u"] for r in df.select("href", urls.absolute_url("href", "https://forms.example/dir/page.html?z=1").alias("u")).collect()}
    assert found == LINKS | {None: None}


def test_names_of_a_batch_are_those_of_a_loop(spark):
    files = [(k, f"d{k % 3}", ("f", "g", "g_2", "h_99", "long", "g_2_3")[k * k % 6], 1000 - k) for k in range(160)] + [(200 + k, "big", "many", k) for k in range(130)]
    there = [("d0", "f"), ("d0", "f_3"), ("d1", "g_2"), ("d1", "g_3"), ("d2", "other"), ("big", "many_50"), ("big", "many")]
    taken, wanted = {}, {}
    for folder, name in there:
        taken.setdefault(folder, set()).add(name)
    for k, folder, base, _ in sorted(files, key=lambda f: f[3]):
        tries = [base] + [f"{base}_{n}" for n in range(2, 100)]
        wanted[k] = next((t for t in tries if t not in taken.setdefault(folder, set())), f"{base}_99")
        taken[folder].add(wanted[k])
    df, existing = spark.createDataFrame(files, "id int, folder string, base string, ordinal int"), spark.createDataFrame(there, "folder string, name string")
    assert {r["id"]: r["name"] for r in linkage.free_names(df, existing).collect()} == wanted
    assert sum(n == "many_99" for n in wanted.values()) > 30


def test_places_of_items_in_large_nodes(spark):
    names = ["șa", "sa", "ță", "ta", "Ana", "ana", "", "zu", "ăi"]
    rows = [(k, "Cluj" if k % 3 else None, "big" if k % 10 else f"n{k % 4}", names[k % 9] if k % 13 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, county_bucket string, organization string, name string")
    found = catalog.item_places(df, F.col("organization"), F.col("name"), F.col("id")).collect()
    order = spark.createDataFrame([(n,) for n in names], "n string").orderBy(F.collate("n", "ro"), "n").collect()
    rank = {r["n"]: k for k, r in enumerate(order)}
    assert [r["n"] for r in order] == ["", "ana", "Ana", "ăi", "sa", "șa", "ta", "ță", "zu"]
    groups = {}
    for k, c, o, n in rows:
        groups.setdefault((c, o), []).append((rank[n or ""], k))
    wanted = {k: place for g in groups.values() for place, (_, k) in enumerate(sorted(g), 1)}
    assert {r["item"]: r["place"] for r in found} == wanted


def test_replaced_templates(spark):
    rows = spark.createDataFrame([("a", 3), ("b", None), ("c", None), ("d", 2)], "id string, version int")
    found = validation.replaced_templates(rows, spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "template_id string, name string"))
    assert sorted(map(tuple, found.collect())) == [("a", 4), ("b", 2), ("c", 1), ("d", 2)]


def test_names_of_fields_stay_unique(spark):
    """Labels as names, numbered from their second use; a clash takes the page, further ones their place too."""
    labels = ["Nume", "Nume", "Nume 2", "Nume", None, "#", "Adresa", "Nume 2", "Nume 2"]
    df = spark.createDataFrame([(d, k % 2, k, n) for d in (1, 2) for k, n in enumerate(labels)], "doc_id int, page int, pos int, label string")
    rows = layout.assign_field_names(df).collect()
    for d in (1, 2):
        used, names = {}, {}
        mine = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: (r["page"], r["pos"]))
        for r in mine:
            base = {"Nume": "nume", "Nume 2": "nume_2", "Adresa": "adresa"}.get(r["label"], "field")
            used[base] = used.get(base, 0) + 1
            name = base if used[base] == 1 else f"{base}_{used[base]}"
            names[name] = names.get(name, 0) + 1
            wanted = name if names[name] == 1 else f"{name}_p{r['page']}" if names[name] == 2 else f"{name}_p{r['page']}_{r['pos']}"
            assert r["field_name"] == wanted
        assert len({r["field_name"] for r in mine}) == len(labels)


def test_orders_of_votes(spark):
    counts = spark.createDataFrame([(1, 5, 5), (2, 0, 9), (3, 9, 1), (4, 3, 0), (5, 1, 1)], "template_id int, up int, down int")
    assert [r["template_id"] for r in votes.most_downvoted(counts, 4).collect()] == [2, 1, 3, 5]
    assert [r["template_id"] for r in votes.worst_ratio(counts, 3).collect()] == [2, 1, 3]
    assert [r["template_id"] for r in votes.worst_ratio(counts).collect()] == [2, 1, 5, 3]
    rows = [(1, d, (1, -1)[d % 2], f"c{d}" if d != 3 else None, f"2024-01-0{1 + d}", d) for d in range(5)] + [(1, 0, -1, "late", "2024-02-01", 9), (2, 0, -1, "other", "2024-03-01", 10)]
    live = spark.createDataFrame(rows, "template_id int, device_id int, value int, comment string, t string, event_id int").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r["device_id"] for r in votes.votes_for_template(live, 1).collect()] == [0, 4, 3, 2, 1]
    assert sorted(r["comment"] for r in votes.downvote_comments(live).collect()) == ["c1", "late", "other"]


def test_filters_that_pass_all_or_one(spark):
    rows = spark.createDataFrame([(1, "Cluj"), (2, "Arad"), (3, None)], "id int, county_bucket string")
    assert catalog.filter_county(rows, "__all__").count() == 3
    assert [r["id"] for r in catalog.filter_county(rows, "Arad").collect()] == [2]
    files = spark.createDataFrame([(f"/x/bundle-{n}/a{n}.pdf",) for n in (10, 2, 33)] + [("/x/other/b.pdf",)], "path string")
    assert [r["bundle"] for r in readers.scan_bundles(files).collect()] == [2, 10, 33]
    assert [r["path"] for r in readers.scan_bundles(files, 10).collect()] == ["/x/bundle-10/a10.pdf"]


def test_shapes_near_one_another_count_once(spark):
    rows = [(1, 0, k, ("cell", "checkbox")[k % 2], k * 7 % 30, k * 3 % 20, 20 + k % 5, 10 + k % 3) for k in range(60)]
    kept = []
    for r in rows:
        if not any(k[3] == r[3] and all(abs(k[i] - r[i]) < 4 for i in (4, 5, 6, 7)) for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "doc_id int, page int, pos int, kind string, x int, y int, w int, h int").repartition(3)
    assert sorted(r["pos"] for r in layout.dedupe_shapes(df).collect()) == sorted(r[2] for r in kept)


def test_rows_of_one_place_give_one_answer_in_any_order(spark):
    """An order by place leaves such rows open; the answer must not follow the order in which they arrive."""
    shape = "doc_id long, page int, pos long, text string, x long, y long, w long, h long, conf double"
    fields = spark.createDataFrame([(1, 0, 1, "", 100, 0, 10, 10, 0.0)], shape)
    texts = [(1, 0, 5, t, 50, 0, 40, 10, c) for t, c in (("Telefon", 0.6), ("Adresa", 0.6), ("Adresa", 0.5), ("Nume", 0.6))]
    boxes = [(1, 0, k, "rect", None, 20 * k, 0, 10, 10) for k in range(1, 13)]
    tied = [(1, 0, p, "rect", None, x, 0, w, h) for p, x in ((0, 0), (13, 260)) for w, h in ((12, -9), (9, 12), (9, 11), (-12, 9), (12, 9))]
    found = []
    for step in (1, -1):
        one = lambda rows, shape: spark.createDataFrame(rows[::step], shape).coalesce(1)
        labels = one(texts, shape)
        rows = [layout.nearest_label_left(fields, labels), layout.nearest_label_above(fields, labels), layout.nearest_label_px(fields, labels)]
        rows.append(layout.digit_box_rows(one(boxes + tied, "doc_id long, page int, pos long, kind string, text string, x long, y long, w long, h long")))
        found.append([[tuple(r) for r in df.collect()] for df in rows])
    assert found[0] == found[1]
    assert found[0][0][0][3] == "Adresa" and found[0][3][0][6:8] == (272, 11)
