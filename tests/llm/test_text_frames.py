"""The text operators on frames: odd rows, and the registered queries against SQL or brute force."""

import hashlib
import html.parser
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from keystrata.llm import common, decontaminate, html_text, langid, lbl_lm, licenses, neardup, quality_crf, queries, spm, suffix_dedup, token_hist

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LONG = "lorem ipsum dolor " * 20_000
#: Null ids and texts, empty and very long texts, equal rows, equal ids, and columns whose names operators use themselves.
ODD = [
    (1, "alpha beta gamma " * 30, "x"),
    (1, "alpha beta gamma " * 30, "x"),
    (1, "another text under the same id", None),
    (2, None, "x"),
    (3, "", None),
    (4, " \n\t ", "y"),
    (5, LONG, "y"),
    (None, "no id here", "z"),
    (None, None, None),
    (6, "alpha beta gamma " * 30, "x"),
    (7, "é日本 😀", "x"),
]
CLASHING = "rid", "rk", "nid", "_text", "n", "label", "kept", "score", "ids", "spans", "gone"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string").repartition(3)
    return df.withColumns({c: F.lit(f"{c}!") for c in CLASHING})


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def words(text, lower=True):
    data = (text or "").encode()
    return (data.translate(LOWER) if lower else data).split()


def removed(rows, length=100):
    """Per key the bytes left, the number gone and of runs; rows: (key in order, text)."""
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            g = data[p : p + length]
            if g in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(g)
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((key, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


def classes(rows, width=3, percent=85):
    """Component of every document by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    rows = quality_crf.quality(odd, labels).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r.doc_id in (2, 3, 4):
            assert (r.n_words, r.base_failed, r.kept, r.n_lines) == (0, True, False, 0)
    assert quality_crf.quality(odd.limit(0), labels).count() == 0
    assert quality_crf.quality(odd, labels.limit(0)).count() == len(ODD)


def test_quality_query(spark, docs):
    texts = {i: t for i, t, _ in docs}
    for r in queries.op1_quality_crf(spark, SF).collect():
        t = texts[r.doc_id]
        w = words(t, lower=False)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        repeat = {j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(repeat))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_kept_by_all_labellings(spark, docs):
    """Of every labelling of a document's lines the best one, by trying all; its content's share decides."""
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    f = quality_crf.fit_lines(quality_crf.training_sample(d, labels, "doc_id", "text", "quality", quality_crf.MAX_LABELLED))
    texts, tried = {i: t for i, t, _ in docs}, 0
    for r in queries.op1_quality_crf(spark, SF).collect():
        places, rows = quality_crf.lines_of(texts[r.doc_id])
        assert [i for i, x in enumerate(texts[r.doc_id].split("\n")) if x.strip()] == places
        if not 0 < len(rows) <= 10:
            continue
        emit = quality_crf.features(rows) @ f.weights
        value = lambda y, e=emit: f.first[y[0]] + sum(e[i][k] for i, k in enumerate(y)) + sum(f.move[a, b] for a, b in itertools.pairwise(y))
        best = max(itertools.product((1, 0), repeat=len(rows)), key=value)
        size = [sum(map(len, texts[r.doc_id].split("\n")[p].split())) for p in places]
        share = sum(s for s, k in zip(size, best, strict=True) if k) / sum(size)
        assert r.kept == (not r.base_failed and share >= quality_crf.CONTENT_SHARE)
        assert r.content_lines == [p for p, k in zip(places, best, strict=True) if k]
        tried += 1
    assert tried > 50


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = quality_crf.quality(d, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality > 0) for r in known) > 0.95 * len(known)


def test_removal_of_odd_rows(spark, odd):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == len(ODD)
    by = {(r.doc_id, r.rk): r for r in rows}
    assert by[1, 0].n_removed < 700
    assert by[6, 0].n_removed == by[6, 0].n_bytes == 510
    assert by[1, 1].n_removed == 510
    assert by[2, 0].kept is None
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "hot"), [(48 << 20, 4096), (3000, 4096), (48 << 20, 2), (3000, 2), (3000, 7)])
def test_removal_by_brute_force(spark, block, hot):
    rng = random.Random(block)
    base = "".join(rng.choice("abcdefgh ") for _ in range(500))
    rows = []
    for i in range(80):
        k = rng.randint(0, 250)
        pick = rng.choice([base[k : k + rng.randint(80, 250)], "ab" * 90, "x" * 130, "é" * 70, ""])
        rows.append((i, f"{i} " * rng.randint(0, 9) + pick + rng.choice(["", f" {i}", pick])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, block_bytes=block, hot=hot).collect())
    assert got == removed(rows)


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    kept = [r for r in rows if r.component_id == 1]
    assert sorted((r.doc_id, r.kept) for r in kept) == [(1, False), (1, False), (1, True), (6, False)] or sorted((r.doc_id, r.kept) for r in kept) == [(1, False), (1, True), (1, True), (6, False)]
    assert {r.doc_id for r in rows if r.n_shingles == 0} == {2, 3, 4, None}
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_in_a_hot_group(spark, monkeypatch):
    """Copies of one text with a few words changed, of which most pairs are not similar enough, and exact copies."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(i, rows[i % 7][1]) for i in range(150, 250)] + [(i, f"only {i}") for i in range(250, 260)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80), (2, 60)):
        found = neardup.near_duplicates(df, threshold=percent, width=width)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == classes(rows, width, percent)
    # The same where every class, bucket and component with more than three rows counts as hot.
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "FEW", 0)
    found = neardup.near_duplicates(df)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == classes(rows)


def test_decontamination_of_odd_rows(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(1, "beta gamma alpha"), (2, None), (None, "no id"), (3, ""), (1, "beta gamma alpha"), (4, "日本")], "item_id long, text string")
    rows = decontaminate.find_contamination(odd, bench).collect()
    assert len(rows) == len(ODD)
    hit = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows if r.n_hit}
    assert hit[6] == (90, 87, ["1"])
    assert 7 not in hit
    assert hit[None] == (3, 2, [])
    monkeypatch.setattr(decontaminate, "SCAN_BYTES", 1)
    for bound in (1, 20):  # several automata, for every batch and for all at once
        small = decontaminate.find_contamination(odd, bench, automaton_bytes=bound).collect()
        assert sorted(map(repr, small)) == sorted(map(repr, rows))
        monkeypatch.undo()
    assert decontaminate.find_contamination(odd, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_contamination(odd.limit(0), bench).count() == 0


def test_pages_of_odd_rows(spark):
    body = "<article><p>{0}</p></article><div class=x><p>Footer of every page</p></div>"
    bare = "<body><p>{0}</p><div><p>Same on all pages</p></div></body>"
    rows = [(i, "http://a.b/x", body.format(i)) for i in range(12)] + [(i, "http://c.d/x", bare.format(i)) for i in range(20, 32)]
    rows += [(50, None, None), (51, "", ""), (None, "http://c.d/y", "<p>alone"), (20, "http://c.d/x", bare.format(20)), (60, "http://e.f/", bare.format("x"))]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[3].text == "3"
    assert (by[25].text, by[25].n_deleted) == ("25", 1)
    assert by[60].text == "x\nSame on all pages"
    assert (by[50].text, by[51].text, by[None].text) == ("", "", "alone")
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_pages(spark):
    """A page of a megabyte keeps all its paragraphs; deletion by recurrence decides what stays of the others."""
    big = "<body><article>" + "".join(f"<p>Paragraph {i} &amp; more</p>" for i in range(30_000)) + "</article></body>"
    box = "<article><p>The text of page {0} is this</p><div><p>Read our paper</p></div></article>"
    rows = [(0, "http://a.b/", big)] + [(i, "http://a.b/", box.format(i)) for i in range(1, 15)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert got[0].text == "\n".join(f"Paragraph {i} & more" for i in range(30_000))
    assert (got[3].text, got[3].n_deleted) == ("The text of page 3 is this", 1)
    joined = {r.page_id: r for r in html_text.main_text(df, marks_sent=0).collect()}
    assert joined == got
    off = {r.page_id: r for r in html_text.main_text(df, many_pages=1000).collect()}
    assert (off[3].text, off[3].n_deleted) == ("The text of page 3 is this\nRead our paper", 0)


class Article(html.parser.HTMLParser):
    """Blocks of the article elements of a page, in another way: events of the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.blocks, self.now = 0, 0, [], ""
        self.feed(page)
        self.close()

    def flush(self):
        text = " ".join(self.now.split())
        self.blocks += [text] if text else []
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in html_text.NEVER
        if tag in html_text.BLOCKS:
            self.flush()
        self.now += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.flush()
        self.depth -= tag == "article"
        self.skip -= tag in html_text.NEVER

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.now += data


def test_page_query_by_another_parser(spark):
    pages = {i: h for i, h in duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()}
    rows = queries.op4_main_text(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = Article(pages[r.page_id]).blocks
        got = r.text.split("\n") if r.text else []
        assert r.n_chars == len(r.text)
        assert len(want) - len(got) == r.n_deleted
        assert got == want if not r.n_deleted else set(got) <= set(want)


def test_copies_of_a_page_count_once(spark):
    page = "<body><p>What it says</p><p>And more of it</p></body>"
    rows = [(i, "http://a.b/x", page) for i in range(30)]
    assert html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("text").distinct().collect()[0].text == "What it says\nAnd more of it"


def test_templates_inside_articles(spark):
    """A neutrally named box that recurs inside articles goes; recurring headings, cells and near-copied articles stay."""
    page = "<main><div class=x><article><h2>Sources</h2><p>Text of its own {0}</p><table><tr><td>yes</td><td>{0}</td></tr></table><div class=q><p>Write to us <b>now</b></p><ul><li>Send</li></ul></div></article></div><div><p>Seen elsewhere</p></div></main>"
    copy = "<article><p>The first long paragraph of it</p><p>The second long paragraph</p><p>The third one is long</p><p>Seen {0}</p></article>"
    rows = [(i, "http://a.b/x", page.format(i)) for i in range(12)] + [(i, "http://c.d/x", copy.format(i)) for i in range(20, 40)]
    rows += [(60, "http://e.f/x", page.format(60))]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[3].text, got[3].n_deleted) == ("Sources\nText of its own 3\nyes\n3", 3)
    assert got[25].text == "The first long paragraph of it\nThe second long paragraph\nThe third one is long\nSeen 25"
    assert got[60].text.endswith("Write to us now\nSend\nSeen elsewhere")


def test_sentencepiece_of_odd_rows(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = spm.encode_decode(odd.select("doc_id", "text", F.col("text").alias("own")), MODEL, keep=("own",)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = sp.encode(r.own or "")
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ",".join(map(str, ids)), sp.decode(ids))
    assert spm.encode_decode(odd.limit(0), MODEL).count() == 0


def test_sentencepiece_query(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op5_sentencepiece(spark, SF).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {i: (len(ids := sp.encode(t or "")), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t, _ in docs}
    assert got == want


def test_licenses_of_odd_rows(odd):
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.n_base == 0 for r in rows)
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def test_license_query(spark, docs):
    phrases = [[b"cc", b"by"], [b"general", b"public", b"license"], [b"all", b"rights", b"reserved"]]
    names = ["cc-by", "gpl", "reserved"]
    texts = {i: t for i, t, _ in docs}
    for r in queries.op6_licenses(spark, SF).collect():
        w = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (texts[r.doc_id] or "").encode().translate(LOWER))
        at = [(k, n) for p, n in zip(phrases, names, strict=True) for k in range(len(w)) if w[k : k + len(p)] == p]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({n for _, n in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_labels_by_brute_force(spark, docs):
    """Labels and score of documents and of made-up notices, word by word and token by token."""
    made = ["SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0+\nx", "// spdx-license-identifier: BSD-3-Clause WITH Some-exception */\nunder the MIT license", "Copyright (c) A. All rights reserved. Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: AND\nlicence"]
    texts = dict(enumerate(made, 10**6)) | {i: t for i, t, _ in docs}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    weights = {"base": 0.8, "phrase": 0.9, "notice": 0.3}
    for r in licenses.scan_licenses(df).collect():
        text = texts[r.doc_id] or ""
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate({c: c + 32 for c in range(65, 91)}))
        line = " " + " ".join(w) + " "
        labels, kinds = set(), set()
        for kind, phrases in (("base", licenses.BASE), ("phrase", licenses.PHRASES), ("notice", dict.fromkeys(licenses.NOTICES))):
            for p, label in phrases.items():
                if f" {p} " in line:
                    kinds.add(kind)
                    labels |= {label} - {None}
        tagged = False
        for m in re.finditer(r"(?i)spdx-license-identifier[ \t]*:[ \t]*([^\n*]*)", text):
            tokens = re.findall(r"[A-Za-z0-9][A-Za-z0-9.:/-]*\+?", m[1])
            named = [t.lower() for t, before in zip(tokens, ["", *tokens], strict=False) if t.lower() not in licenses.PRIORITY and before.lower() != "with"]
            tagged |= bool(named)
            labels |= set(named)
        doubt = 0.05 if tagged else 1.0
        for kind in kinds:
            doubt *= 1 - weights[kind]
        assert r.labels == ",".join(sorted(labels))
        assert abs(r.score - (1 - doubt)) < 1e-6


def test_languages_of_odd_rows(spark, odd):
    model = langid.learn(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(ODD)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"}
    nothing = langid.learn(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_languages_that_are_alike(spark):
    """Of two languages learned from one text the one that sorts first is told, with the whole of it."""
    model = langid.learn(spark.createDataFrame([("aa", "one two three four"), ("zz", "one two three four")], "lang string, text string"))
    got = langid.identify(spark.createDataFrame([(1, "one three"), (1, "one three")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("aa", 1.0)] * 2


def test_language_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op7_language_mixture(spark, sf).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) > 0.98 * len(held)


def test_histogram(spark, odd, docs):
    h = spark.createDataFrame([(0, 2), (3, 1), (10, 4), (5000, 1)], "n_tokens long, n_docs long")
    sums = token_hist.suffix_sums(h, block=4)
    lengths = [0, 0, 3, 10, 10, 10, 10, 5000]
    for r in sums.collect():
        assert r.docs_over == sum(x > r.n_tokens for x in lengths)
        assert r.tokens_within == sum(x for x in lengths if x <= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
        assert r.quantile == sum(x <= r.n_tokens for x in lengths) / 8
    for r in token_hist.answer_limits(sums, [0, 2, 5, 10_000]).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in lengths)
    assert {r.share: r.n_tokens for r in token_hist.quantile_lengths(sums, [0.25, 0.5, 1.0]).collect()} == {0.25: 0, 0.5: 10, 1.0: 5000}
    assert token_hist.suffix_sums(h.limit(0)).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counts = token_hist.token_counts(odd, path, public_tokenizers.PATTERN)
    assert counts.count() == len(ODD)
    enc = token_hist.encoding(path, open(path, "rb").read(), public_tokenizers.PATTERN)  # noqa: SIM115
    assert isinstance(enc, tiktoken.Encoding)
    want = Counter(len(enc.encode_ordinary(t or "")) for _, t, _ in docs)
    assert {r.n_tokens: r.n_docs for r in queries.op9_token_histogram(spark, SF).collect()} == want


OPERATORS = {
    "quality": lambda spark, d, keep: quality_crf.quality(d, spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int"), keep=keep),
    "decontaminate": lambda spark, d, keep: decontaminate.find_contamination(d, spark.createDataFrame([(1, "beta gamma alpha")], "item_id long, text string"), keep=keep),
    "sentencepiece": lambda spark, d, keep: spm.encode_decode(d, MODEL, keep=keep),
    "licenses": lambda spark, d, keep: licenses.scan_licenses(d, keep=keep),
    "languages": lambda spark, d, keep: langid.identify(d, langid.learn(d), keep=keep),
    "counts": lambda spark, d, keep: token_hist.token_counts(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep),
    "scores": lambda spark, d, keep: lbl_lm.score(d, d, keep=keep),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_kept_columns_of_clashing_names(spark, odd, name):
    """Kept columns named like results, like helpers and like the id all come back, under names of their own."""
    own = [c for c in OPERATORS[name](spark, odd, ()).columns if c != "doc_id"]
    d = odd.select("doc_id", "text", "lang", F.lit("mine").alias(own[0]), F.lit("too").alias(f"{own[0]}_in"), F.lit("t").alias("_text"), F.lit("k").alias("_k0"), F.lit("r").alias("rid"), F.lit("d").alias("a.b`c"))
    out = OPERATORS[name](spark, d, (own[0], f"{own[0]}_in", "_text", "_k0", "rid", "a.b`c", "doc_id"))
    assert out.columns == ["doc_id", f"{own[0]}_in", f"{own[0]}_in_in", "_text", "_k0", "rid", "a.b`c", *own]
    rows = out.collect()
    assert len(rows) == len(ODD)
    assert all(tuple(r[1:7]) == ("mine", "too", "t", "k", "r", "d") for r in rows)


def test_numbers_of_rows_in_bulk(spark):
    """Ids that are null, or equal, for most rows: numbers follow the texts, whatever the tasks."""
    rng = random.Random(4)
    rows = [(None if i % 3 else i % 2, rng.choice([None, "", "the ", "the same beginning of them all "]) and rng.choice("abc") * rng.randint(0, 3) + f"{rng.randint(0, 40)}") for i in range(500)]
    rows = [(i, t if rng.random() > 0.1 else None) for i, t in rows]
    got = common.numbered(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    by = {}
    for i, t in rows:
        by.setdefault(common.NO_ID if i is None else i, []).append(t)
    want = sorted((i, k, t) for i, texts in by.items() for k, t in enumerate(sorted(texts, key=lambda x: (x is not None, x or ""))) if t is not None)
    assert sorted((r.rid, r.rk, r.text) for r in got if r.text is not None) == want
    assert len({(r.rid, r.rk) for r in got}) == len(rows)


def test_rows_of_one_task_are_dealt_anew(spark):
    one = spark.range(1000).coalesce(1)
    assert common.evened(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in common.evened(one).collect()) == list(range(1000))
    for spread in (spark.range(0, 1000, 1, 7), spark.range(3).coalesce(1), spark.range(0).coalesce(1)):
        assert common.evened(spread) is spread


def test_slices_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": ["aaaa", None, "bb", "c" * 50, "", "dd", "ee"]})
    parts = list(common.slices(batch, 5, "t"))
    assert [p.column("k").to_pylist() for p in parts] == [[0, 1], [2], [3], [4, 5, 6]]
    assert list(common.slices(batch.slice(0, 0), 5, "t")) == []


def test_names_beside():
    assert common.names_beside(["id", "n", "n_in"], ["n"]) == ["id", "n_in", "n_in_in"]


def test_bulk_null_ids(spark):
    rows = [(None if i % 3 else i, f"text {i % 50} " + "of many words " * 20) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    near = neardup.near_duplicates(d).collect()
    assert len(near) == 300
    assert sum(r.kept for r in near) == 50
    assert Counter(r.component_id for r in near if r.component_id is not None).total() == 300
    left = suffix_dedup.remove_repeats(d).collect()
    assert len(left) == 300
    assert len({(r.doc_id, r.rk) for r in left}) == 300
    assert lbl_lm.score(d, d).count() == 300


def test_pipeline_works_every_document_out_once(spark, tmp_path, monkeypatch):
    """Each stage's own pass over its rows runs once, whatever the later ones do with what it returns."""
    seen = spark.sparkContext.accumulator(0)
    plain = quality_crf.lines_of

    def counted(text):
        seen.add(1)
        return plain(text)

    monkeypatch.setattr(quality_crf, "lines_of", counted)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    n_labelled = seen.value
    out.count()
    assert 0 < n_labelled <= 1500 + docs.count()
    assert seen.value == n_labelled


def test_scores_are_those_of_the_model(spark, monkeypatch):
    """Every token's probability from the model's numbers, summed up over all symbols for each pair of contexts."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "cc", "dd", "eee", f"r{rng.randint(0, 30)}x"]) for _ in range(rng.randint(0, 20))) for _ in range(120)]
    training = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = [*texts[:40], "a a never seen r1x", "", "zz"]
    monkeypatch.setattr(lbl_lm, "NAMED", 0)
    got = {r.doc_id: r for r in lbl_lm.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), training, vocabulary=6).collect()}
    c = Counter(w for t in texts for w in [*t.encode().split(), lbl_lm.END])
    order = sorted((w for w in c if w != lbl_lm.END), key=lambda w: (-c[w], w))
    symbols = lbl_lm.Symbols([b"", lbl_lm.END, *order[:4]], lbl_lm.class_count(len(c)))
    tokens, types = np.zeros(len(symbols)), np.zeros(len(symbols))
    for w, n in c.items():
        tokens[symbols[w]] += n
        types[symbols[w]] += w != lbl_lm.END
    unigram = (tokens + 1) / (tokens + 1).sum()
    m = lbl_lm.train(training, symbols, unigram, sum(c.values()), ["doc_id", "text"])
    is_class = symbols.is_class()
    for i, t in enumerate(asked):
        before, total = [lbl_lm.END_ID, lbl_lm.END_ID], 0.0
        for w in [*t.encode().split(), lbl_lm.END]:
            s = symbols[w]
            value = (m.a1[before[-1]] + m.a2[before[-2]]).astype(float) @ m.r.T.astype(float) + m.b
            total += (value[s] - np.logaddexp.reduce(value)) / math.log(10)
            if is_class[s]:
                total += math.log10((c[w] + 1) / (tokens[s] + types[s] + 1))
            before.append(s)
        assert abs(got[i].score - total) < 1e-4 * abs(total) + 1e-4


def test_scores_do_not_follow_the_tasks(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a, b = ({r.doc_id: r.score for r in lbl_lm.score(df.repartition(n), df.repartition(n), vocabulary=64).collect()} for n in (4, 16))
    assert a.keys() == b.keys()
    assert all(abs(a[i] - b[i]) <= 1e-9 * abs(a[i]) for i in a)


def test_scores_of_held_out_documents_beat_the_base(spark):
    """By a twentieth of a decimal logarithm a token at least."""
    sf = "/root/testdata/sf0.01"
    rows = [r for r in queries.op10_language_model(spark, sf).collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.05


@pytest.mark.parametrize("frequent", [150_000, 3])
def test_scores_by_brute_force(spark, docs, frequent):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r.doc_id: r for r in lbl_lm.score(df, df.filter(~held), vocabulary=64, frequent=frequent).collect()}
    tokens = {i: [*words(t), b"\n"] for i, t, _ in docs}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert abs(got[i].base_score - base) < 1e-6 * abs(base)
        assert math.isfinite(got[i].score)
        assert got[i].score < 0


def test_scores_tell_rare_words_apart(spark):
    """Words outside the model's own, of equal count: the one whose ending follows in training is likelier."""
    i = F.col("id").cast("string")
    training = spark.range(0, 60_000, 1, 1).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("x k"), i, F.lit("aaa"))).otherwise(F.concat(F.lit("y k"), i, F.lit("bbb"))).alias("text"))
    asked = spark.createDataFrame([(1, "x naaa"), (2, "x nbbb"), (3, "y nbbb"), (4, "y naaa")], "doc_id long, text string")
    got = {r.doc_id: r for r in lbl_lm.score(asked, training, vocabulary=4).collect()}
    assert len({round(r.base_score, 6) for r in got.values()}) == 1
    assert got[1].score > got[2].score + 0.1
    assert got[3].score > got[4].score + 0.1


def test_scores_of_odd_rows(odd):
    rows = lbl_lm.score(odd.select("doc_id", "text"), odd.select("text")).collect()
    assert len(rows) == len(ODD)
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (2, 3, 4))
    nothing = lbl_lm.score(odd.select("doc_id", "text"), odd.select("text").limit(0)).collect()
    assert all(r.train_tokens == 0 and r.score == r.base_score for r in nothing)
    assert lbl_lm.score(odd.select("doc_id", "text").limit(0), odd.select("text")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_pipeline_by_brute_force(spark, docs):
    kept = {r.doc_id for r in queries.op1_quality_crf(spark, SF).filter("kept").collect()}
    rows = [(i, t) for i, t, _ in docs if i in kept]
    comp = classes(rows, 5, 80)
    rows = [(i, t) for i, t in rows if comp[i][1] == i]
    seen, left = set(), []
    for i, t in sorted(rows):
        data = t.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        left.append((i, bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")))
    bench = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    norm = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.encode().translate(LOWER))
    windows = {tuple(w[k : k + min(13, len(w))]) for _, t in bench if (w := norm(t)) for k in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {}
    for i, t in left:
        w = norm(t)
        hit = {j for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want[i] = hashlib.sha256(",".join(map(str, sp.encode(t))).encode()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_handle_odd_rows(spark, odd, tmp_path):
    d = odd.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for rows in (d, d.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, rows, SF)
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert i == 0 or out.count() <= rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()


def test_all_queries_are_registered():
    names = list(entry.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert "pipeline" in names
