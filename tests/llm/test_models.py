"""Trained operators, pages, vectors and the pipeline: held-out accuracy, round trips, brute force, odd rows."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowloom.llm import html, language, neighbours, q_language, q_quality, q_toxicity, quality, toxicity, warc
from rowloom.llm.common import auc
from tests.llm import brute


def held_out(spark, sf, rows, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    pairs = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


@pytest.mark.parametrize("query,label,least", [(q_quality.op6_quality_classifier, "quality", 0.95), (q_toxicity.op3_toxicity, "toxic", 0.8)])
def test_held_out_scores(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)
    score, y = held_out(spark, sf, rows, label)
    assert auc(score, y) > least


ODD = [(1, None), (2, ""), (3, "word " * 20_000), (3, "word " * 20_000), (None, "été"), (4, "\x00\t")]


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, None), (3, 1, 0), (None, 1, 1), (2, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    none = docs.where("false")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(docs, labels, label=label)
        rows = module.score(docs, model).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
        assert all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
        assert module.score(none, module.fit(none, labels, label=label)).collect() == []
        blank = module.fit(docs, labels.where("false"), label=label)
        assert {r.score for r in module.score(docs, blank).collect()} == {0.5}


def test_toxicity_against_one_window_at_a_time():
    import zstandard

    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdeé ") for _ in range(60)) for _ in range(300)]
    own = toxicity.trained([" ".join(rng.choice(["vequor", "lostran", "grumpf"]) for _ in range(8)) for _ in range(200)], 400, 16)
    shared = toxicity.trained(plain, 2_000, 32)
    model = toxicity.CompressionModel(own + shared, b" " * len(own) + shared, 3.0)
    texts = ["", "x", "abc vequor lostran", "É" * 100, "dé a" * 100 + " grumpf vequor " + "b" * 300, "Vequor " * 50]
    params = model._compressors() and zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=6, min_match=5, target_length=16,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (model.ordinary, model.toxic)]
    tools = [zstandard.ZstdCompressor(compression_params=params, dict_data=d) for d in held]
    want = []
    for text in texts:
        data = "".join(c.lower() if c.isascii() else c for c in text).encode()
        gains, start = [], 0
        while data:
            part = shared[-toxicity.PRIMER:] + data[start : start + toxicity.WINDOW] + b" " * toxicity.PAD
            gains.append(len(tools[0].compress(part)) - len(tools[1].compress(part)))
            if start + toxicity.WINDOW >= len(data):
                break
            start += toxicity.WINDOW - toxicity.OVERLAP
        over = [g for g in gains if g >= 3]
        want.append([max([0, *gains]), np.log1p(len(over)), len(over) / max(len(gains), 1), np.log1p(sum(over)), np.log1p(len(gains)) * (max([0, *gains]) > 0)])
    got = model.features(pa.array(texts))
    assert np.allclose(got, want) and got[2, 0] > 3 and got[5, 0] > 3 and not got[0].any()


def test_toxic_dictionary_is_trained_on_what_tells(spark):
    rng = random.Random(6)
    plain = ["sun", "rain", "wind", "snow", "cloud", "storm", "frost", "light"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            for bad in ("grumpfig", "veqoulant"):
                words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    # copies and one long text don't make a word tell
    rows += [(1000 + i, "sun copied rain", 1) for i in range(50)] + [(2000, "oncelong snow " * 500, 1)]
    model = toxicity.dictionaries(spark.createDataFrame(rows, "_id long, text string, _y int"))
    assert b"grumpfig" in model.toxic and b"veqoulant" in model.toxic
    own = model.toxic[: -len(model.ordinary.lstrip(b" "))]
    assert b"copied" not in own and b"oncelong" not in own
    assert b"grumpfig" not in model.ordinary and len(model.toxic) == len(model.ordinary)


@pytest.mark.parametrize("max_rows", [1_000, 100, 40])
def test_toxicity_keeps_the_class_ratio_of_all_labels(spark, max_rows):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["sun", "rain", "wind", "snow"]) for _ in range(12)), int(i % 10 == 0)) for i in range(1_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.drop("toxic"), table.drop("text"), max_rows=max_rows)
    scores = [r.score for r in toxicity.score(table.drop("toxic"), model).collect()]
    assert abs(np.mean(scores) - 0.1) < 0.06


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit_additive(x[:3000], y[:3000], rounds=30)
    assert (0, 1) in model.pairs
    assert auc(model.score(x[3000:]), y[3000:]) > 0.95


def test_features_do_not_depend_on_slices(monkeypatch):
    texts = pa.array(["one two two", None, "", "UP! up | 9", "é " * 50, "x"])
    whole = quality.features(texts)
    monkeypatch.setattr(quality.words, "SLICE_BYTES", 4)
    alone = np.concatenate([quality.features(texts.slice(i, 1)) for i in range(len(texts))])
    assert np.allclose(whole, alone) and not whole[1].any() and not whole[2].any()


def test_compression_windows_cover_each_text():
    offsets = np.array([0, 0, 5, 500, 500, 500 + toxicity.WINDOW])
    row, starts, sizes = toxicity.windows(offsets)
    for r in range(5):
        covered = {b for s, n in zip(starts[row == r], sizes[row == r]) for b in range(s, s + n)}
        assert covered == set(range(offsets[r], offsets[r + 1]))


PROSE = "The cat was in the house and it was good for the people that came with us to see it all. " * 4


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain the text of it and that is all there is for us", "plain the text of it and that is all there is for us"),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>A&amp;B&nbsp;\n c<br>d</p>"
     "<script>var t='</p>';</script><!-- <p>no</p> --><p>&eacute;&#233;</p></article><footer>&copy; me</footer>", "Head\n\nA&B c d\n\néé"),
    (f"<div class='content'><h2>Title</h2><p>{PROSE}</p><p>Short one.</p></div><div id=comments><p>{PROSE}</p></div><p>Copyright</p>", f"Title\n\n{PROSE.strip()}\n\nShort one."),
    (f"<main><p>{PROSE}<aside><p>{PROSE}</p></aside><div class='cookie-notice'>We use cookies</div><form><p>Name</p></form><ul class=share><li>Tweet</ul><p>End", f"{PROSE.strip()}\n\nEnd"),
    ("<article><p>x<section class='comments'><p>nice!</section><p>y</article", "x\n\ny"),
    ("<article><p>a <b>bold</b> word, 1 < 2 & 3 > 2</p><p class='ad'", "a bold word, 1 < 2 & 3 > 2"),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_extraction_of_odd_rows(spark):
    rows = [(1, "u", "<article>a</article>", "n"), (1, "u", "<article>a</article>", "n"), (None, None, None, "n"), (2, "v", "<p>" * 50_000, "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = Counter(tuple(r) for r in html.extract(pages).collect())
    assert out == Counter({(1, "u", "a", 1): 2, (None, None, "", 0): 1, (2, "v", "", 0): 1})
    assert html.extract(pages.where("false")).collect() == []


def test_archives_round_trip(spark, tmp_path):
    long = "é" * 2_000_000
    rows = [(1, "http://a/x\r\ny", "WARC/1.1\r\n\r\nWARC-Type: request\r\n\r\n" * 5, 0), (2, None, None, 0), (3, "u", "s" * 99, 0), (4, "u", "s" * 99, 0),
            (5, "u", "l" * 100, 0), (6, "u", "l" * 100, 0), (6, "u", "l" * 100, 0), (5, "u", "l" * 100, 0), (7, "u", long, 0), (8, "u", long, 0), (None, "u", "n" * 200, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id int")
    out = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    want: Counter = Counter()
    for key, _, text, _ in rows:
        raw = (text or "").encode()
        first = min((k for k, _, t, _ in rows if t == text and k is not None), default=None) if len(raw) >= 100 else key
        want[key, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == key else "revisit", None if first == key else first] += 1
    assert out == want
    path = str(tmp_path / "w")
    warc.write(pages.where("page_id in (1, 5, 6)"), path)
    captures = warc.assemble(warc.read(spark, path)).collect()
    assert all(c.request is not None and c.metadata is not None for c in captures)
    by = {c.metadata.fields["page-id"]: c for c in captures}
    assert bytes(by["1"].response.payload).decode() == rows[0][2] and by["1"].target_uri == "http://a/x%0D%0Ay"
    files = [p for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz")]
    records = [h for p in files for h, _ in warc.parse(io.BufferedReader(gzip.open(p)))]
    assert len(records) == 3 * len(captures) and {h["warc-type"] for h in records} == {"request", "response", "revisit", "metadata"}
    assert warc.round_trip(pages.where("false")).collect() == []


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:700] = x[0]
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0] * 15 + [None]), (2400, [1.0] * 3), (None, [1.0] * 16), (100, rows[100][1])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = neighbours.search(table).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 100))
    found = 0
    for q, near in by.items():
        near.sort()
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(1500), d))[:10]
        assert [n[0] for n in near] == list(range(1, 11))
        assert np.allclose([n[2] for n in near], d[[n[1] for n in near]])
        found += len(set(order) & {n[1] for n in near})
        if d[order[-1]] == 0:
            assert [n[1] for n in near] == order.tolist()
    assert found >= 0.9 * 150
    few = neighbours.search(table.where("vec_id < 4")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (0, 3)]
    assert neighbours.search(table.where("false")).collect() == []


def test_languages(spark, sf):
    rows = q_language.op2_language_id(spark, sf).withColumn("path", F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1)).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert np.mean([r.lang == r.path for r in rows]) > 0.95 and all(0 < r.score <= 1 for r in rows)


def test_language_evidence(spark):
    docs = spark.createDataFrame([("en", "the house of the people and their friends " * 9), ("de", "das haus der leute und ihre freunde " * 9), (None, "x"), ("en", None)], "lang string, text string")
    body = "<article><p>das haus der leute und ihre freunde</article>"
    rows = [(i, f"http://h.de/{i}", f"<html lang=de>{body}", 1) for i in range(9)] + [
        (20, "http://h.de/x", "<html lang='de'>", 1), (21, "http://h.de/y", None, 1), (22, None, None, 1), (23, "http://o.uk/", "<html lang=en><article>the house of the people</article>", 1),
        (None, "", body, 1), (23, "http://o.uk/", "<html lang=en><article>the house of the people</article>", 1),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = language.identify(pages, docs).collect()
    assert len(got) == len(rows)
    said = {r.page_id: r for r in got}
    assert said[20].lang == said[21].lang == said[3].lang == said[None].lang == "de" and said[23].lang == "en"
    assert said[20].score > said[22].score and said[21].text_lang is None
    assert {r.lang for r in language.identify(pages, docs.where("false")).collect()} == {None}
    assert language.identify(pages.where("false"), docs).collect() == []


def test_every_language_is_identified(spark):
    rng = random.Random(1)
    names = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefghi"]
    prose = {lang: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(40)) for lang in names}
    # the last language of the alphabet has the fewest documents
    docs = spark.createDataFrame([(lang, prose[lang]) for lang in names for _ in range(1 + (lang != names[-1]))], "lang string, text string").coalesce(1)
    assert len(names) > language.HELD_LANGUAGES
    found, table = language.likelihoods(docs)
    assert found == names and table.shape == (len(names), language.BUCKETS)
    for k, lang in enumerate(names):
        data = np.frombuffer(prose[lang].encode(), np.uint8)
        _, bucket = language.trigrams(data, np.array([0, len(data)]))
        assert int(np.argmax(table[:, bucket].sum(1))) == k


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    score = {r.doc_id: r.predicted for r in q_quality.op6_quality_classifier(spark, sf).collect()}
    state, stages = docs, dict(corpus_pipeline.STAGES)
    kept = {i: r.text for i, r in rows.items() if score[i] == 1}
    state = stages["quality classifier"](spark, state, sf)
    assert {r.doc_id for r in state.collect()} == set(kept) and state.columns == columns
    groups = brute.components(list(kept.items()), corpus_pipeline.NEAR_PERCENT)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    state = corpus_pipeline.settle(stages["MinHash near-dedup"](spark, state, sf), "t")
    assert {r.doc_id for r in state.collect()} == set(kept) and state.columns == columns
    flags = brute.long_runs(list(kept.items()), corpus_pipeline.REPEAT_BYTES, corpus_pipeline.REPEAT_WORDS)
    state = corpus_pipeline.settle(stages["suffix-array dedup"](spark, state, sf), "t")
    after = {r.doc_id: r for r in state.collect()}
    for (i, text), gone in zip(list(kept.items()), flags):
        raw = text.encode()
        # a span that begins or ends inside a character leaves it whole
        assert after[i].text.encode() == bytes(b for b, f in zip(raw, gone) if not f) or any(gone) and len(after[i].text.encode()) - (len(raw) - sum(gone)) < 8
        assert after[i].n_chars == (rows[i].n_chars if not any(gone) else len(after[i].text))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    state = corpus_pipeline.settle(stages["benchmark decontamination"](spark, state, sf), "t")
    clean = {r.doc_id: r.text for r in state.collect()}
    for i, r in after.items():
        n, inside, _ = brute.hits(r.text, items)
        assert (i in clean) == (len(inside) <= 0.5 * n)
        if i in clean:
            words = brute.ALNUM.findall(r.text.translate(brute.LOWER))
            assert brute.ALNUM.findall(clean[i].translate(brute.LOWER)) == [w for k, w in enumerate(words) if k not in inside]
    assert state.columns == columns
    mixed = stages["mixing sources to target weights"](spark, state, sf).collect()
    sizes: Counter = Counter()
    for i, text in clean.items():
        sizes[rows[i].source] += len(brute.SPACED.findall(text))
    want = brute.targets(dict(sizes))
    taken: Counter = Counter()
    for r in mixed:
        taken[r.source] += r.taken
    assert all(taken[s] == round(want[s]) for s in sizes)
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, mixed))


def test_pipeline_joins_documents_of_similarity_80(spark, sf):
    own = [f"w{k}" for k in range(54)]
    # 45 of 55 shingles in common: 0.818
    pair = [(-2, " ".join(own)), (-1, " ".join(own[:27] + ["x"] + own[28:]))]
    assert brute.components(pair, 85) == {-2: -2, -1: -1}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(pair, "doc_id long, text string"))
    groups = brute.components([tuple(r) for r in docs.collect()], 80)
    kept = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in groups.items() if i == c)
    assert groups[-1] == -2


def test_pipeline_keeps_different_texts_under_one_id(spark, sf):
    """By (id, text); rows without an id go where a row with an id has their words."""
    rows = [(5, "a b c d e f g h", "x"), (5, "z b c d e f g y", "x"), (1, "a b c d e f g h", "x"), (None, "a b c d e f g h", "x"),
            (None, "only here, without an id", "x"), (None, "only here, without an id", "x"), (7, None, "x"), (7, "", "x"), (7, "", "x"), (8, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    kept = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, docs, sf)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    # a null text is an empty one
    assert [g for g in got if g[0] != 7] == sorted([(5, "z b c d e f g y"), (1, "a b c d e f g h"), (None, "only here, without an id"), (8, " ")], key=repr)
    assert len([g for g in got if g[0] == 7]) == 1


def test_pipeline_removes_passages_of_over_50_words(spark, sf):
    rng = random.Random(6)

    def prose(n, low=2, high=8):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(low, high))) for _ in range(n))

    long, short = prose(51, 4, 5), prose(45, 7, 8)
    rows = [(i, f"{prose(60)} {x} {prose(60)}", "kept", "kept", 1) for i, x in enumerate([long, long, short, short, prose(90)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc string, _tag string, n_chars long")
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["suffix-array dedup"](spark, docs, sf).collect()}
    assert all(long not in got[i].text and len(got[i].text.split()) in (119, 120) for i in (0, 1))
    assert all(got[i].text == rows[i][1] for i in (2, 3, 4))
    assert all((r._doc, r._tag) == ("kept", "kept") for r in got.values())
    mended = dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, docs.withColumnRenamed("_doc", "_found"), sf)
    assert {r._found for r in mended.collect()} == {"kept"}
