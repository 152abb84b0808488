"""The text operators' parts without Spark, against brute force."""

import itertools
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import decontaminate, html_text, langid, lbl_lm, licenses, neardup, quality_crf, spm, suffix_dedup

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def merges():
    return spm.Merges(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=" \n\t▁aeinrstABé中😀\x00.,'-1230​", max_size=60))
def test_sentencepiece_equals_the_library(merges, library, text):
    ids = library.encode(text)
    assert merges.encode(text) == ids
    assert [i for w in spm.parts(text) for i in merges.encode_word(w)] == ids
    assert merges.decode(ids) == library.decode(ids)


def test_sentencepiece_long_word(merges, library):
    text = "".join(random.Random(1).choice("aeinrst") for _ in range(3000))
    assert merges.encode(text) == library.encode(text)


def test_agenda_is_score_ordered(merges):
    assert merges.encode_word("") == []
    assert merges.encode_words(["", " a", " the"]) == [[], merges.encode_word(" a"), merges.encode_word(" the")]


def brute_removal(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = text.encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            g = data[p : p + length]
            if g in seen:
                gone[p : p + length] = [True] * length
            seen.add(g)
        out[i] = bytes(b for b, g in zip(data, gone, strict=True) if not g)
    return out


def test_windows_of_equal_text_have_equal_triggers():
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 123, 500, dtype=np.uint8).tobytes()
    texts = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() + shared + rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in (3, 70)]
    which, start, count, lead, trig, _ = suffix_dedup.parse(texts)
    found = {}
    for w, s, c, t in zip(which, start, count, trig, strict=True):
        for k in range(c):
            found.setdefault(texts[w][s + k : s + k + 100], set()).add(int(t))
    assert all(len(x) == 1 for x in found.values())
    assert (lead >= count - 1).all()
    assert (lead <= 68).all()
    assert sum(count) == sum(len(t) - 99 for t in texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=7), min_size=1, max_size=40))
def test_sorted_words(words):
    cells = np.zeros((len(words), 8), dtype=np.uint8)
    for row, w in zip(cells, words, strict=True):
        row[: len(w)] = list(w)
    order, common = suffix_dedup.sorted_words(cells)
    full = [bytes(cells[i]) for i in order]
    assert full == sorted(full)
    for a, b, n in zip(full, full[1:], common[1:], strict=False):
        assert a[:n] == b[:n]
        assert n == 8 or a[n] != b[n]


def phrases_of(texts, length, trigger):
    data = b"".join(texts)
    size = np.array([len(t) for t in texts])
    first = np.cumsum(size) - size
    begin, count, lead, *_ = suffix_dedup.phrases(np.frombuffer(data, dtype=np.uint8), first, first + size, length, trigger)
    return data, begin, count, lead


@pytest.mark.parametrize("alphabet", ["ab", "a\0", "abcdef"])
def test_corpus_order_is_that_of_the_bytes(alphabet):
    """Every window stands once; windows of one trigger place have ranks equal just where their bytes are, and those of
    one left word are in the order of their bytes."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(10, 40))).encode() for _ in range(60)]
    data, begin, count, lead = phrases_of(texts + texts[:9], 10, 4)
    d = suffix_dedup.Dictionary(np.frombuffer(data, dtype=np.uint8), begin, count, lead, 10, 4)
    seen, of_bytes = [], {}
    for place, (some, inner, rank) in enumerate(d.windows()):
        windows = [data[b : b + 10] for b in begin[some] + inner]
        seen += zip(some.tolist(), inner.tolist(), strict=True)
        assert len({*zip(windows, rank.tolist(), strict=True)}) == len(set(windows)) == len(set(rank.tolist()))
        for w in windows:
            assert of_bytes.setdefault(w, place) == place
        by_left = {}
        for w, r in zip(windows, rank.tolist(), strict=True):
            by_left.setdefault(r // (d.n + 1), []).append((r, w))
        assert all([w for _, w in sorted(x)] == sorted(w for _, w in x) for x in by_left.values())
    assert sorted(seen) == [(i, k) for i, c in enumerate(count) for k in range(c)]


def test_repeated_windows():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 60))).encode() for _ in range(80)]
    data, begin, count, lead = phrases_of(texts + texts[:3], 12, 5)
    which, inner = suffix_dedup.repeated(suffix_dedup.Dictionary(np.frombuffer(data, dtype=np.uint8), begin, count, lead, 12, 5))
    seen, want = set(), set()
    for i, (b, c) in enumerate(zip(begin.tolist(), count.tolist(), strict=True)):
        for k in range(c):
            w = data[b + k : b + k + 12]
            if w in seen:
                want.add((i, k))
            seen.add(w)
    assert {*zip(which.tolist(), inner.tolist(), strict=True)} == want
    assert len(which) == len(want)


def test_intervals_cover_all_places():
    for length, trigger in ((100, 32), (10, 4), (5, 5), (6, 5)):
        parts = suffix_dedup.intervals(length, trigger)
        assert [d for a, b in parts for d in range(a, b + 1)] == list(range(length - trigger + 1))
    assert len(suffix_dedup.intervals(100, 32)) == 13


def test_cut_out():
    assert suffix_dedup.cut_out(b"abcdefghij", [(1, 2), (3, 4)], 3) == (b"aghij", [(1, 6)])
    assert suffix_dedup.cut_out(b"abc", [], 3) == (b"abc", [])


def test_shingles():
    sets = neardup.shingle_sets([None, "", " \n", "A b", "a B", "a b c d", "a b c d a b c", "x"])
    assert [len(s) for s in sets] == [0, 0, 0, 1, 1, 2, 4, 1]
    assert sets[3].tolist() == sets[4].tolist() != sets[7].tolist()
    assert set(sets[5].tolist()) <= set(sets[6].tolist())


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.concatenate((a[:800], np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))))
    s = neardup.signatures([a, np.sort(b)])
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15


def test_pruning_keeps_what_is_similar():
    bounds = neardup.least_matches()
    rng = np.random.default_rng(2)
    n = 20_000
    same = rng.random((n, neardup.ROWS * neardup.BANDS)) < 0.85
    left = np.zeros((n, same.shape[1]), dtype=np.uint8)
    kept, _ = neardup.surviving(left, (~same).astype(np.uint8), np.arange(n), np.arange(n), bounds)
    assert len(kept) > 0.999 * n
    kept, _ = neardup.surviving(left, (rng.random(same.shape) > 0.4).astype(np.uint8), np.arange(n), np.arange(n), bounds)
    assert len(kept) < 0.01 * n


def test_windows_of_items():
    w = decontaminate.windows([("1", "a b"), ("2", None), ("3", "A, b!"), (None, "c"), ("4", " ".join(map(str, range(14))))])
    assert w[" a b "] == (2, ["1", "3"])
    assert w[" c "] == (1, [])
    assert sum(1 for k in w if k.count(" ") == 14) == 2


def test_hits_and_original_offsets():
    a = decontaminate.automaton(decontaminate.windows([("1", "Dé f"), ("2", "f x")]))
    text = "a, DÉ! dé F-X."
    n, ranges, items = decontaminate.scan(text, a)
    assert (n, items) == (5, {"1", "2"})
    spans = decontaminate.original_spans(text, decontaminate.merged(ranges))
    assert [text[s["start"] : s["end"]] for s in spans] == ["dé F-X"]
    assert decontaminate.scan(None, a) == (0, [], set())
    assert decontaminate.scan("a", None) == (1, [], set())


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header>Site</header><nav><ul><li>Home<li>About</ul></nav><div class="ad">buy</div><!-- gone -->
<article><h1>Head &amp; tail</h1><p>One  two
three<p>Four <b>fi</b>ve<br>six &#233;<aside>side</aside><div class="comments"><p>hi</p></div><form>f</form></article>
<div id="sidebar">s</div><footer>&copy;</footer></body></html>"""


def test_page():
    blocks, marks = html_text.examine(PAGE, "h")
    assert [t for t, _ in blocks] == ["Head & tail", "One two three", "Four five six é"]
    assert marks
    assert all(not m for _, m in blocks)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><form><article><p>a</p></article><input></form></body>", ["a"]),
        ("<body><form id=f><div><p>the text of it all</p></div><button>go</button></form></body>", ["the text of it all"]),
        ('<body><div class="page with-sidebar"><div class="post"><p>a text</p></div><div class="sidebar">s</div></div></body>', ["a text"]),
        ('<article><p>a</p><p class="market-share">b</p><p class="notice">c</p><div class="notice">d</div><p class="advert">e</p></article>', ["a", "b", "c"]),
        ('<body><div class="sidebar-left"><p>the only text of this page</p></div><nav>n</nav></body>', ["the only text of this page"]),
        ('<body><div class="comments"><p>many long comments of readers</p></div><p>a</p></body>', ["a"]),
        ('<body><div class="no-comments"><p>a</p></div></body>', ["a"]),
        ('<article><p>a</p><form><p>b</p></form></article>', ["a"]),
        ('<body><form role="search"><input>s</form><p>more text than in the form</p></body>', ["more text than in the form"]),
    ],
)
def test_what_names_of_elements_say(page, want):
    assert [t for t, _ in html_text.examine(page, "h")[0]] == want


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "</p></p>", "a<b", "<p " + "x" * 5000, "<div>" * 3000 + "x"])
def test_broken_pages(page):
    blocks, _ = html_text.examine(page, "h")
    assert all(t.strip() for t, _ in blocks)


def test_page_without_article():
    blocks, _ = html_text.examine("<body><div class='menu'>m</div><p>a&nbsp;b</p>text<p>c", "h")
    assert [t for t, _ in blocks] == ["a b", "text", "c"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT", ({"mit"}, True)),
        ("MIT OR GPL-2.0", ({"mit", "gpl-2.0"}, True)),
        ("MIT AND GPL-2.0", ({"mit", "gpl-2.0"}, False)),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR (MIT AND Apache-2.0)", ({"gpl-2.0", "mit", "apache-2.0"}, True)),
        ("(GPL-2.0 OR MIT) AND GPL-3.0", ({"gpl-2.0", "mit", "gpl-3.0"}, False)),
        ("MIT This file is", ({"mit"}, True)),
        ("DocumentRef-a:LicenseRef-b AND MIT.", ({"documentref-a:licenseref-b", "mit"}, False)),
        ("MIT/X11 OR GPL-2.0+ */", ({"mit/x11", "gpl-2.0+"}, False)),
    ],
)
def test_license_expressions(text, want):
    assert licenses.evaluate(licenses.postfix(text)) == want


def test_bad_expressions():
    for text in ("", "AND MIT", "( MIT"):
        assert licenses.postfix(text) is None
    assert licenses.postfix("MIT OR") == ["mit"]


def test_license_scan():
    n, n_base, first, last, base, labels, expressions, permissive, score = licenses.examine("x CC-BY and cc by nc.\nSPDX-License-Identifier: Apache-2.0 OR MIT\nall RIGHTS reserved")
    assert (n, n_base, first, last, base) == (18, 3, 1, 15, "cc-by,reserved")
    assert labels == "apache-2.0,cc-by,cc-by-nc,mit,reserved"
    assert (expressions, permissive) == (["apache-2.0 mit or"], True)
    assert 0.9 < score < 1
    assert licenses.examine(None) == (0, 0, None, None, "", "", [], None, 0.0)
    assert licenses.examine("plain prose")[-1] == 0


def test_long_license_expressions():
    names = [f"lic-{i:03}" for i in range(200)]
    _, _, _, _, _, labels, expressions, permissive, _ = licenses.examine("SPDX-License-Identifier: MIT AND " + " AND ".join(names) + "\nProse MIT")
    assert labels == ",".join([*names, "mit"])
    assert (expressions[0].count("and"), permissive) == (200, False)
    *_, expressions, permissive, _ = licenses.examine("SPDX-License-Identifier: MIT AND (" + " OR ".join(names) + " OR MIT)")
    assert (len(expressions[0].split()), permissive) == (403, True)


def brute_base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeat = {j for i in range(len(words) - 2) if windows[words[i], words[i + 1], words[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é　\xa0\x0b\n\t#|", max_size=80))
def test_base_measures(text):
    assert quality_crf.base_measures(text) == brute_base(text)


    import itertools

    rng = np.random.default_rng(4)
    f = quality_crf.Field(move=rng.normal(size=(2, 2)), first=rng.normal(size=2))
    for n in range(1, 8):
        emit = rng.normal(size=(n, 2)).tolist()

        def value(y, emit=emit):
            return f.first[y[0]] + sum(emit[i][k] for i, k in enumerate(y)) + sum(f.move[a, b] for a, b in itertools.pairwise(y))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(f.viterbi(emit)) == best
    assert f.viterbi([]) == []


def test_long_labelled_documents_are_fitted_whole():
    """Lines of a document of a thousand lines teach the field, the last ones too."""
    good = "\n".join("This is a sentence of plain words, and it ends as one." for _ in range(400))
    bad = "\n".join("Short text here, and it is fine." for _ in range(300)) + "\n" + "\n".join("## >> $$ click $$ << ##" for _ in range(700))
    f = quality_crf.fit_lines([(good, 1), (bad, 0)])
    _, rows = quality_crf.lines_of("## >> $$ click $$ << ##\nThis is a sentence of plain words, and it ends as one.")
    lean = quality_crf.features(rows) @ (f.weights[:, 1] - f.weights[:, 0])
    assert lean[0] < 0 < lean[1]


def test_field_gradient():
    rng = np.random.default_rng(5)
    n = quality_crf.N_FEATURES
    x, y, mask = rng.normal(size=(2, 4, n)), rng.integers(0, 2, (2, 4)), np.array([[True] * 4, [True, True, False, False]])
    f = quality_crf.Field(rng.normal(size=(n, 2)) * 0.1, rng.normal(size=(2, 2)), rng.normal(size=2))
    value, g_w, g_m, g_f = f.gradient(x, y, mask)
    assert value < 0
    for array, grad, at in ((f.weights, g_w, (3, 1)), (f.move, g_m, (0, 1)), (f.first, g_f, (1,))):
        array[at] += 1e-5
        up = f.gradient(x, y, mask)[0]
        array[at] -= 2e-5
        down = f.gradient(x, y, mask)[0]
        array[at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-4


def test_field_tells_boilerplate():
    good = "The quick brown fox jumps over the lazy dog, and then it rests.\nIt was a fine day for everyone there."
    bad = "Home | About | Contact | Terms\n*** $$$ ### $$$ ***\nClick || here ||"
    field = quality_crf.fit_lines([(good, 1), (bad, 0)] * 20)
    for text, want in ((good, 1), (bad, 0)):
        _, rows = quality_crf.lines_of(text)
        assert set(field.viterbi((quality_crf.features(rows) @ field.weights).tolist())) == {want}
    assert not quality_crf.fit_lines([(good, 1)]).weights.any()


def test_mixture_proportions():
    rng = random.Random(7)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    x, y = (lambda n: " ".join(word("abcde") for _ in range(n))), (lambda n: " ".join(word("vwxyz") for _ in range(n)))
    rows = []
    for lang, make in (("xx", x), ("yy", y)):
        bucket, _, _ = langid.grams([make(2000)])
        counts = np.bincount(bucket, minlength=langid.BUCKETS)
        rows += [(lang, int(i), int(counts[i])) for i in np.flatnonzero(counts)]
    m = langid.LanguageModel.of_counts(rows)
    a, b, c, d, e = m.mixtures([x(50), x(60) + " " + y(20), None, "123 !", y(1)])
    assert list(a) == ["xx"]
    assert abs(b["xx"] - 0.75) < 0.03
    assert abs(b["yy"] - 0.25) < 0.03
    assert c is None
    assert d is None
    assert list(e) == ["yy"]
    assert langid.LanguageModel.of_counts([]).mixtures(["abc"]) == [None]


def test_set_of_languages_by_trying_all():
    """Greedy steps from the best language reach the best of all sets."""
    rng = np.random.default_rng(3)
    m = langid.LanguageModel(["a", "b", "c", "d"], np.zeros((1, 4), dtype=np.float32))
    like, starts = [], []
    for i in range(60):
        starts.append(len(like))
        own = rng.choice(4, size=rng.integers(1, 5), replace=False)
        for _ in range(int(rng.integers(1, 60))):
            row = rng.normal(-9, 2, 4)
            row[rng.choice(own)] += 8
            like.append(row)
    like, starts = np.array(like), np.array(starts)
    got = m.infer(like, starts)
    ends = np.append(starts[1:], len(like))
    for (s, e), mix_ in zip(zip(starts, ends, strict=True), got, strict=True):
        p = np.exp(like[s:e])
        best = -np.inf
        for k in range(1, 5):
            for c in itertools.combinations(range(4), k):
                x = np.full(k, 1 / k)
                for _ in range(300):
                    j = p[:, c] * x
                    x = (j / j.sum(axis=1, keepdims=True)).mean(axis=0)
                best = max(best, np.log(p[:, c] @ x).sum() - langid.PENALTY * (k - 1) * np.log(e - s + 1))
        chosen = ["abcd".index(x) for x in mix_]
        x = np.array(list(mix_.values()))
        assert np.log(p[:, chosen] @ x).sum() - langid.PENALTY * (len(chosen) - 1) * np.log(e - s + 1) > best - 0.05


def test_mixture_of_more_than_three_languages():
    rng = random.Random(8)
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst"]
    make = lambda x, n: " ".join("".join(rng.choice(x) for _ in range(6)) for _ in range(n))
    rows = []
    for x in letters:
        counts = np.bincount(langid.grams([make(x, 2000)])[0], minlength=langid.BUCKETS)
        rows += [(x, int(i), int(counts[i])) for i in np.flatnonzero(counts)]
    m = langid.LanguageModel.of_counts(rows)
    all_five = " ".join(make(x, n) for x, n in zip(letters, (50, 40, 40, 40, 30), strict=True))
    four = " ".join(make(x, 25) for x in letters[:4])
    a, b, c, d = m.mixtures([make("abcd", 30), all_five, four, make("ijkl", 9)])
    assert (list(a), list(d)) == (["abcd"], ["ijkl"])
    assert (set(b), set(c)) == (set(letters), set(letters[:4]))
    assert abs(b["abcd"] - 0.25) < 0.02
    assert all(abs(x - 0.25) < 0.02 for x in c.values())


def test_model_is_normalised():
    rng = np.random.default_rng(8)
    m = lbl_lm.Model(*(rng.normal(size=(40, 5)).astype(np.float32) for _ in range(3)), rng.normal(size=40).astype(np.float32))
    first, second, log_z = m.tables()
    p = np.exp(first[:, None, :] + second[None, :, :] - log_z[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)
    assert np.allclose(m.log_z(), log_z, atol=1e-4)
    w, v, u = (rng.integers(0, 40, 99) for _ in range(3))
    assert np.allclose(m.scores(w, v, u), first[v, w] + second[u, w], atol=1e-4)


def test_symbols_grow_with_the_words():
    sizes = [lbl_lm.class_count(n) for n in (0, 10**3, 10**6, 10**9)]
    assert sizes == [1, 40, 400, 4000]
    s = pickle.loads(pickle.dumps(lbl_lm.Symbols([b"", lbl_lm.END, b"a"], 5)))
    assert (s[lbl_lm.END], s[b"a"], len(s), s.is_class().tolist()) == (1, 2, 7, [True, False, False, True, True, True, True])
    assert {s[b"%d" % i] for i in range(500)} == {0, 3, 4, 5, 6}
    assert s[b"xxabc"] == s["yabc".encode()]


def test_contexts():
    v, u = lbl_lm.contexts(np.array([5, 6, 1, 1, 7, 1]), np.array([0, 3, 4]))
    assert v.tolist() == [1, 5, 6, 1, 1, 7]
    assert u.tolist() == [1, 1, 5, 1, 1, 1]


def test_noise_contrast_learns():
    rng = np.random.default_rng(9)
    n = 60_000
    ids = rng.integers(2, 12, n)
    ids[1::2] = ids[0::2] % 10 + 2  # every second word follows from the one before
    unigram = (np.bincount(ids, minlength=12) + 1) / (n + 12)
    t = lbl_lm.Trainer(lbl_lm.Model.start(unigram), unigram, 1)
    v, u = lbl_lm.contexts(ids, np.array([0]))
    for i in range(0, n, 500):
        t.step(ids[i : i + 500], v[i : i + 500], u[i : i + 500])
    first, second, z = t.m.tables()
    fitted = (first[v, ids] + second[u, ids] - z[v, u])[-5000:].mean()
    assert fitted > np.log(unigram[ids])[-5000:].mean() + 0.2


def test_tokens():
    assert lbl_lm.tokens_of(None) == [lbl_lm.END]
    assert lbl_lm.tokens_of("A b\x0bÉ") == [b"a", b"b", "É".encode(), lbl_lm.END]
    assert zlib.crc32(b"5") % 7 in range(7)
    assert math.isfinite(lbl_lm.RATE)


