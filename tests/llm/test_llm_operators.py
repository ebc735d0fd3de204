"""Each operator against brute force on small tables, and the cases every operator must define."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptmatrix.llm import components, exact_search, gbt, html_text, language_model, mixing, nbsvm, near_dup, pieces, quality_rules, session, substring_dedup, toxicity
from promptmatrix.llm import textkit as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASH = ("score", "kept", "size", "taken", "ids", "key", "t", "id", "label", "y", "rep", "class_id", "target", "n_words", "shared")


def clash() -> dict:
    return {c: F.lit(7) for c in CLASH}


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lexicon(rng: random.Random, n: int = 400) -> list[str]:
    return ["".join(rng.choice("abcdefgéßñ.") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random texts with exact and near copies, shared passages, repeats, runs, empty and null texts."""
    rng = random.Random(seed)
    lex = lexicon(rng)
    passage = [rng.choice(lex) for _ in range(60)]
    texts: list[str | None] = []
    for i in range(n):
        body = [rng.choice(lex) for _ in range(rng.choice([1, 3, 20, 60, 150]))]
        if i % 7 == 0:
            body[len(body) // 2 : len(body) // 2] = passage
        texts.append(" ".join(w + ("\n" if rng.random() < 0.1 else "") for w in body))
    base = [rng.choice(lex) for _ in range(120)]
    for i in range(12):
        near = list(base)
        for _ in range(i % 5):
            near[rng.randrange(len(near))] = "edit%d" % rng.randrange(99)
        texts.append(" ".join(near))
    texts += [texts[3], texts[3], "the " * 90, "a b " * 50, None, "", "  \n\t ", "one", "x y z", "very long " + " ".join(rng.choice(lex) for _ in range(5000))]
    return [(i, t, "en", f"s{i % 3}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_words_and_hashes():
    texts = [t for _, t, *_ in corpus()]
    for limit in (1, 200, 1 << 20):
        found: list[list[str]] = []
        names: dict[int, str] = {}
        for c in tk.chunks(pa.array(texts, pa.string()), limit):
            w = tk.find_words(c)
            raw = c.data.tobytes()
            spelled = [raw[a:b].decode() for a, b in zip(w.start, w.end, strict=True)]
            for h, s in zip(tk.word_hashes(c.data, w.start, w.end).tolist(), spelled, strict=True):
                assert names.setdefault(h, s) == s
            found += [spelled[a:b] for a, b in zip(w.cut[:-1], w.cut[1:], strict=True)]
        assert found == [words(t) for t in texts]
        assert len(set(names.values())) == len(names)


def test_hashes_tell_balanced_words_apart():
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    texts = [a, b, a[:1024], b[:1024], "x" * 700_000, "x" * 700_001, "x" * 699_999 + "y"]
    c = next(tk.chunks(pa.array([" ".join(texts)]), 1 << 30))
    w = tk.find_words(c)
    assert len(set(tk.word_hashes(c.data, w.start, w.end).tolist())) == len(texts)
    alone = [tk.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t)]))[0] for t in texts]
    assert alone == tk.word_hashes(c.data, w.start, w.end).tolist()


def base_counts(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[(w[i], w[i + 1], w[i + 2])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_rules(docs, labels, none):
    forest = quality_rules.fit(docs, labels)
    rows = quality_rules.apply(docs.withColumns(clash()), forest).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        expected = base_counts(texts[r.doc_id])
        assert tuple(r[c] for c in quality_rules.BASE) == expected
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.apply(none, quality_rules.fit(none, labels)).count() == 0


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.5 * x[:, 1] + 0.2 * rng.standard_normal(3000) > 0.8).astype(float)
    forest = gbt.fit(x, y, np.array([1, -1, 0]))
    probe = np.tile(rng.random((50, 1, 3)), (1, 200, 1))
    for f, sign in ((0, 1), (1, -1)):
        line = probe.copy()
        line[:, :, f] = np.linspace(0, 1, 200)
        score = forest.margin(line.reshape(-1, 3)).reshape(50, 200)
        assert (np.diff(score, axis=1) * sign >= -1e-12).all()
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.8


def same_classes(got: dict[int, int], rows: list[tuple[int, str | None]]) -> None:
    bags = {}
    for i, t in rows:
        w = words(t)
        bags[i] = Counter(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    up = {i: i for i in bags}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if a < b and bags[a] and bags[b]:
                both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
                if both >= 0.8 * either:
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    assert got == {i: root(i) for i in ids}


def test_near_duplicates(docs, none):
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs.withColumns(clash())).collect()}
    same_classes(got, [(r.doc_id, r.text) for r in docs.collect()])
    assert near_dup.classes(docs).count() == docs.count()
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert near_dup.classes(none).count() == 0


def test_near_duplicates_of_one_id_and_of_none(spark):
    rng = random.Random(8)
    lex = lexicon(rng)
    texts = [" ".join(rng.choice(lex) for _ in range(60)) for _ in range(5)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1] + " end"), (3, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[3] + " end"), (4, ""), (4, ""), (None, ""), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "exact": F.lit(2), "doc": F.lit(3), "rep": F.lit(4)})
    got = Counter((r.doc_id, r.class_id) for r in near_dup.classes(df).collect())
    assert got == {(1, 1): 3, (2, 1): 1, (3, 3): 1, (None, 3): 1, (None, None): 5, (4, 4): 2}
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns and kept.select("key", "exact", "doc", "rep").distinct().collect() == [(1, 2, 3, 4)]
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    nameless = [(i, t) for (i, t) in left if i is None and t]
    assert len(nameless) == 1 and nameless[0][1].startswith(texts[3])
    del left[nameless[0]]
    assert left == {(1, texts[0]): 1, (1, texts[1]): 1, (3, texts[2]): 1, (4, ""): 1, (None, ""): 1, (None, None): 2}


def test_hot_buckets_are_compared_in_blocks(spark, monkeypatch):
    """A chain of texts, each near the next only, all in few buckets: no pivot is near all of them."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 3)
    rng = random.Random(6)
    text = ["w%d" % rng.randrange(10**6) for _ in range(100)]
    rows = []
    for i in range(30):
        text = list(text)
        for k in range(2):
            text[(i * 7 + k) % 100] = "n%d" % rng.randrange(10**6)
        rows.append((i, " ".join(text)))
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same_classes({r.doc_id: r.class_id for r in got}, rows)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    rng = random.Random(5)
    lex = lexicon(rng)
    base = [rng.choice(lex) for _ in range(150)]
    rows = []
    for i in range(40):
        near = list(base)
        for _ in range(rng.randrange(8)):
            near[rng.randrange(len(near))] = "e%d" % rng.randrange(999)
        rows.append((i, " ".join(near)))
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same_classes({r.doc_id: r.class_id for r in got}, rows)


def test_signatures_estimate_weighted_overlap():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(40):
        keys = rng.integers(1, 1 << 60, 200).astype(np.uint64)
        a, b = rng.integers(0, 9, 200), rng.integers(0, 9, 200)
        b = np.where(rng.random(200) < 0.6, a, b)
        g, doc, w = np.concatenate([keys[a > 0], keys[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.concatenate([a[a > 0], b[b > 0]])
        sig = near_dup.signatures(*near_dup.weigh(np.repeat(g, w), np.repeat(doc, w)), 2)
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
    <header><a href="/">Site</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies, lots, of them, yes.</div>
    <div class="sidebar"><p>Older posts, many, of them, in a long list of things to read, one, two.</p></div>
    <article><h1>Head &amp; line</h1><p><b>First,   bold<br>text<p>Second&nbsp;para, <a href=x>linked</a>, end.<ul><li>one<li>two</ul>
    <form><input><label>Mail</label></form><div class="ad">Buy, buy, buy.</div><!-- <p>no</p> --><p>5 < 6 &lt;b&gt;</p></article>
    <section id="comments"><p>Great, really, great, post, thanks, a lot, for it.</p></section><footer>&copy; us</footer></body>"""
    assert html_text.main_text(page) == "Head & line First, bold text Second para, linked, end. one two 5 < 6 <b>"
    content = "".join(f"<p>Paragraph {i}, with commas, and enough words to be counted as text.</p>" for i in range(4))
    assert html_text.main_text(f"<div id=menu><a href=1>x</a></div><div><div class=box>{content}</div><div class=related>{content}</div></div>").count("Paragraph") == 4
    assert [html_text.main_text(x) for x in (None, "", "plain & simple", "<p>short", "<div>a<div>b</div>c <b")] == ["", "", "plain & simple", "short", "a b c"]


def test_html_keeps_what_belongs_to_the_article():
    page = """<body><nav><a href=1>Home</a></nav><article class="content no-sidebar"><h1>T</h1><p>First sentence, with words.</p><math>a+b</math><ul><li><a href=1>Ref one</a><li><a href=2>Ref two</a></ul>
    <div class="share-price-table">Price 5</div><p class="legal">Legal words, in the article.</p><div class="ad-box">buy</div><div class="share"><a href=1>Tweet</a></div><ul class="related-links"><li><a href=1>More</a></ul>
    <div class="text sidebar"><p>Inner.</p></div><div class="comments"><p>great</p></div><object>fallback</object></article><p class="legal">All rights, reserved, by us.</p></body>"""
    assert html_text.main_text(page) == "T First sentence, with words. a+b Ref one Ref two Price 5 Legal words, in the article. Inner. fallback"


#: Names of blocks inside an article that are not of the article, and names that are.
GONE = (
    "cookie-notice notice notices footer-notice ad-banner google-ad ad ads adSlot ad_box sponsored sponsor-box promo reader-comments user-comments comment-respond comments commentlist comment-form newsletter-signup "
    "newsletter signup-box subscribe related related-posts social sharing share-bar-social sidebar left-sidebar widget widget-area nav-menu breadcrumb breadcrumbs pagination pager toolbar popup modal overlay cookie-banner "
    "consent gdpr-box alert alert-box banner top-banner login-form register-box recommended recommendations disqus tag-ads skip-links menu submenu advertisement outbrain"
).split()
STAYS = "intro content note no-sidebar has-ads with-comments figure quote share-price-table read-more story text-block chapter legal disclaimer noticeable adventure commentary menu-of-the-day-review notice-period-law banner-history-essay".split()


def test_html_blocks_by_name():
    words = "First words of the block, with a comma."
    for names, stays in ((GONE, False), (STAYS, True)):
        for name in names:
            for attribute in (f'class="{name}"', f"id={name}", f'data-x="1" CLASS=\'{name}\''):
                page = f"<body><article><h1>T</h1><p>Before, and more.</p><div {attribute}><p>{words}</p></div><p>After.</p></article></body>"
                assert (words in html_text.main_text(page)) is stays, (name, attribute)
    assert html_text.main_text('<article><p>A.</p><div id="ad_300x250"><p>Buy now.</p></div><p title="a hidden gem">B.</p><p hidden>C.</p><p data-a="x" hidden="">D.</p><p>See <label>E</label> it.</p><form><label>F</label></form></article>') == "A. B. See E it."


@pytest.mark.parametrize("part", ["<div>x", "<blockquote>x", "<li>x", "</section>x", "<section>x</div>", "<a>x", "<!--x", "&lt;", "<p", "<article><section>x</div></p>"])
def test_html_in_linear_time(part):
    def seconds(n):
        began = time.process_time()
        html_text.main_text("<body><article><blockquote>" + part * n)
        return time.process_time() - began

    assert seconds(20_000) < 2 + 12 * seconds(4_000)


def test_html_rows(spark):
    rows = [(1, "u", "<article><p>Hi, é.</article>", "x"), (1, "u", "<article><p>Hi, é.</article>", "x"), (None, None, None, None), (3, "v", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(html_text.apply(df).collect(), key=str)
    assert [(r.text, r.n_chars) for r in got] == [("Hi, é.", 6), ("Hi, é.", 6), ("", 0), ("", 0)]
    assert html_text.apply(df.limit(0)).count() == 0


def brute_substrings(rows):
    count = Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + o for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for o in range(35)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed, none):
    rng = random.Random(seed)
    rows = [(r[0], r[1]) for r in corpus(seed)]
    runs = [" ".join(["w"] * rng.randint(30, 80) + [rng.choice("abc") for _ in range(rng.randint(0, 40))] + ["ab"] * rng.randint(0, 50)) for _ in range(20)]
    rows += [(1000 + i, t) for i, t in enumerate(runs)] + [(None, "null id " * 30), (None, "other null id " * 20), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash())
    got = sorted((tuple(r) for r in substring_dedup.digests(df).collect()), key=str)
    assert got == brute_substrings(rows)
    assert substring_dedup.digests(none).count() == 0


def test_substring_apply_leaves_clean_texts(docs):
    own = docs.withColumns({"doc": F.lit(-1), "kept": F.lit(-2), "n_removed": F.lit(-3), "judged": F.lit(-4), "key": F.lit(-5)})
    rows = substring_dedup.apply(own).collect()
    assert {tuple(r[c] for c in ("doc", "kept", "n_removed", "judged", "key")) for r in rows} == {(-1, -2, -3, -4, -5)}
    out = {r.doc_id: r for r in rows}
    removed = {i: n for i, _, n, _ in brute_substrings([(r.doc_id, r.text) for r in docs.collect()])}
    for r in docs.collect():
        assert out[r.doc_id].text == r.text if not removed[r.doc_id] else out[r.doc_id].n_chars == len(out[r.doc_id].text)


def marked(rng, n, good, bad):
    """Texts of two kinds: kind 1 has words of ``bad`` among ``good``."""
    return [(i, " ".join(rng.choice(bad) if i % 2 and rng.random() < 0.1 else rng.choice(good) for _ in range(80)), i % 2) for i in range(n)]


def test_classifiers_on_held_out_texts(spark):
    rng = random.Random(3)
    good, bad = lexicon(rng, 300), ["vileword", "horridone", "nastything", "crueltalk"]
    rows = marked(rng, 400, good, bad)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, y int")
    held = session.remainder("doc_id", 5) == 0
    truth = {i: y for i, _, y in rows}
    for module in (nbsvm, toxicity):
        model = module.fit(df, lab, ~held, label="y")
        got = module.apply(df.where(held), model).collect()
        assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.95
        assert all(0 <= r.score <= 1 for r in got)


def test_classifier_edges(spark, docs, labels, none):
    for module, label in ((nbsvm, "quality"), (toxicity, "toxic")):
        model = module.fit(docs, labels, F.lit(True), label=label)
        got = module.apply(docs.withColumns(clash()), model).collect()
        assert len(got) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert module.apply(none, model).count() == 0
        unlabelled = module.fit(docs, labels.limit(0), F.lit(True), label=label)
        assert len({r.score for r in module.apply(docs, unlabelled).collect()}) == 1


def test_toxic_filter_keeps_columns(docs, labels):
    model = toxicity.fit(docs, labels, F.lit(True))
    kept = toxicity.keep_ordinary(docs, model)
    scores = Counter((r.doc_id, r.predicted) for r in toxicity.apply(docs, model).collect())
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for (i, p), n in scores.items() if not p})


def test_pieces_match_the_library(spark, docs, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.load()
    odd = ["Hello  world\nfoo\tbar  ", "  lead", "a   b", " ", "\n", "日本 é😀x\n\n \n", "▁a▁▁b", "a\r\nb c"]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    coded = pieces.encode(df.withColumns(clash()), model)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in coded.collect():
        assert r.ids == library.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids) and r.round_trip
    back = {r.doc_id: r.text for r in pieces.decode(coded, model).collect()}
    assert back == {i: (t or "").replace(pieces.MARK, " ") for i, t in texts.items()}
    assert pieces.encode(none, model).count() == 0


def test_long_runs_of_spaces():
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [" " * 3000 + "x", "a" + " " * 777 + "b" * 3000, "ab" * 5000, " " * 300_000]
    encoder, decoder = pieces.Encoder(pieces.load()), pieces.Decoder(pieces.load())
    for c in tk.chunks(pa.array(texts), 1):
        ids, cut = encoder.block(c)
        assert decoder.block(ids, cut) == [texts[c.first].encode()]
        if c.first < 3:
            assert ids.tolist() == library.encode(texts[c.first])


def test_unigram_walk_is_the_best_segmentation():
    rng = random.Random(2)
    vocabulary = {"▁", *"abcd"} | {"".join(rng.choice("▁abcd") if k == 0 else rng.choice("abcd") for k in range(rng.randint(2, 4))) for _ in range(40)}
    score = {p: -rng.random() * 9 - 0.1 for p in vocabulary}
    model = pieces.Model(score, {p: i for i, p in enumerate(sorted(vocabulary))}, [0] * 256, [p.encode() for p in sorted(vocabulary)], 0, False)
    spell = sorted(vocabulary)

    def best(word):
        top = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            top[end] = max((top[s] + score[word[s:end]] for s in range(end) if word[s:end] in score), default=-math.inf)
        return top[-1]

    batch = sorted({"▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(200)})
    for word, ids in zip(batch, pieces.Encoder(model).words(batch), strict=True):
        assert "".join(spell[i] for i in ids) == word
        assert sum(score[spell[i]] for i in ids) == pytest.approx(best(word))


@pytest.mark.parametrize("head", [5, 1 << 18])
def test_language_model(docs, none, head, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", head)
    learn = session.remainder("doc_id", 7) != 2
    got = language_model.score(docs.withColumns(clash()), learn).collect()
    keep = {r.doc_id for r in docs.where(learn).select("doc_id").collect()}
    low = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    count, ends = Counter(), 0
    for r in docs.collect():
        if r.doc_id in keep:
            count.update(low(r.text))
            ends += 1
    total, distinct = sum(count.values()) + ends, len(count) + 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        w = low(texts[r.doc_id])
        base = sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w) + math.log10((ends + 1) / (total + distinct + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(count[x] > 0 for x in w) + 1, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert language_model.score(none, learn).count() == 0


def test_model_probabilities_add_up(docs):
    counts = language_model.count(docs)
    lex = language_model.lexicon(counts, 20, 300)
    t = language_model.tables(language_model.train(docs, lex, F.lit(True)), lex)
    p = 10.0 ** (t.near[:, None, :] + t.far[None, :, :] + t.bias - t.normal[:, :, None])[:40, :40]
    assert np.allclose(p.sum(2), 1, atol=1e-3)
    place = np.arange(len(lex.inner_freq))
    shape = np.repeat(np.arange(len(lex.inner_cut) - 1), np.diff(lex.inner_cut))
    for x in (0, 3, 21):
        inner = np.bincount(shape, 10.0 ** t.inner_score(place, shape, np.full(len(place), x)))
        assert np.allclose(inner, 1, atol=1e-3)


def test_scores_by_hand(docs, monkeypatch):
    """The score of every document from the model's tables, token by token."""
    monkeypatch.setattr(language_model, "HEAD", 200)
    learn = session.remainder("doc_id", 7) != 2
    kept = {}
    tables = language_model.tables
    monkeypatch.setattr(language_model, "tables", lambda p, lex: kept.setdefault("t", (tables(p, lex), lex))[0])
    got = {(r.doc_id, r.n_tokens): r.score for r in language_model.score(docs, learn, words=20, inner_words=100).collect()}
    t, lex = kept["t"]
    count = {r["name"]: r["c"] for r in language_model.count(docs.where(learn)).collect()}
    ends = lex.inner_cut[1:] - 1
    for r in docs.collect():
        text = (r.text or "").encode()
        _, h, shape = language_model.tokens(next(tk.chunks(pa.array([text.decode()]))))
        out, place, _ = lex.look(h, shape)
        x = y = 0
        score = 0.0
        for name, s, w, i in [*zip(h.view(np.int64).tolist(), shape, out, place, strict=True), (None, 0, 0, 0)]:
            score += float(t.near[x, w] + t.far[y, w] + t.bias[w] - t.normal[x, y])
            if w > 20:
                score += float(t.inner_context[x] @ t.inner[i] + t.inner_bias[i] - t.inner_normal[s, x])
                if i == ends[s]:
                    score += math.log10((count.get(name, 0) + 1) / lex.inner_freq[i])
            x, y = w, x
        assert got[(r.doc_id, len(h) + 1)] == pytest.approx(score, rel=1e-4, abs=1e-3)


@pytest.mark.parametrize("part", range(language_model.SLICES))
def test_model_learns_from_every_slice(docs, part):
    lex = language_model.lexicon(language_model.count(docs))
    null = docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.unionByName(null).where(F.pmod(F.xxhash64(F.lit("slice"), F.col("doc_id"), F.octet_length("text")), F.lit(language_model.SLICES)) == part)
    assert rows.count() and not np.array_equal(language_model.train(rows, lex, F.lit(True)).pack(), language_model.start(lex).pack())


def test_exact_search(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.standard_normal((300, 8)) * 0.3, np.repeat(rng.standard_normal((3, 8)), 20, 0)])
    rows = [(i, [float(np.float32(x)) for x in row], 1) for i, row in enumerate(v)]
    rows += [rows[50], (400, None, 0), (401, [None] * 8, 0), (450, [float("nan")] * 8, 0), (500, [float("inf")] * 8, 0), (None, [0.1] * 8, 0), (550, [0.5] * 3, 0), (600, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit(1)).withColumn("id", F.lit(2))
    whole = [(i, np.floor(256 * np.array(e, float))) for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    expected = []
    for a, (i, q) in enumerate(whole):
        if i % 50 == 0:
            near = sorted((-int(q @ x), j) for b, (j, x) in enumerate(whole) if a != b and len(q) == len(x))[:5]
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    for block in (4096, 64):
        monkeypatch.setattr(exact_search, "DATA_BLOCK", block)
        monkeypatch.setattr(exact_search, "QUERY_BLOCK", 4)
        got = exact_search.top_k(df, F.col("id") % 50 == 0).collect()
        assert sorted(tuple(r) for r in got) == sorted(expected)
    assert exact_search.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("blocks", [1, 8])
def test_clustered_vectors_are_pruned(spark, monkeypatch, blocks):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((24, 16))
    v = centers[rng.integers(0, 24, 6000)] + 0.02 * rng.standard_normal((6000, 16))
    x = np.floor(256 * v)
    q = x[::50]
    best, place, scored = exact_search.search(q, np.arange(0, 6000, 50), np.full(len(q), -np.inf), x, np.arange(6000), np.arange(6000), 5)
    assert scored < 0.3 * len(q) * len(x)
    if blocks > 1:
        monkeypatch.setattr(exact_search, "DATA_BLOCK", 6000 // 24)
        sent = []
        searched = exact_search._searched
        monkeypatch.setattr(exact_search, "_searched", lambda units, *a: sent.append(units.where("NOT asks").count()) or searched(units, *a))
        df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
        got = {(r.query_id, r["rank"]): r.score for r in exact_search.top_k(df, F.col("id") % 50 == 0).collect()}
        assert sent[1] < 0.5 * 6000 * 24  # of all rows to all cells of queries
        score = q @ x.T
        score[np.arange(len(q)), np.arange(0, 6000, 50)] = -np.inf
        top = -np.sort(-score, axis=1)[:, :5]
        assert got == {(50 * i, r + 1): top[i, r] for i in range(len(q)) for r in range(5)}


def test_cover_tree_covers():
    x = np.random.default_rng(2).standard_normal((700, 5))
    tree = exact_search.cover_tree(x)
    assert sorted(tree.order) == list(range(700))
    for i in range(len(tree.begin)):
        rows = tree.order[tree.begin[i] : tree.end[i]]
        assert (np.linalg.norm(x[rows] - x[tree.center[i]], axis=1) <= tree.radius[i] + 1e-6).all()
        if tree.children[i]:
            assert sum(tree.end[c] - tree.begin[c] for c in tree.children[i]) == len(rows)
            centers = x[[tree.center[c] for c in tree.children[i]]]
            apart = np.linalg.norm(centers[:, None] - centers[None], axis=2)[~np.eye(len(centers), dtype=bool)]
            assert (apart >= max(tree.radius[c] for c in tree.children[i]) - 1e-6).all()


def brute_mix(rows):
    size = [len(words(t)) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
            open_.discard(s)
    return size, total, target


def test_mixing(docs, none):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    size, total, target = brute_mix(rows)
    got = mixing.mix(docs.withColumns(clash()).drop("source").withColumn("source", F.expr("if(doc_id % 11 = 0, null, concat('s', doc_id % 3))"))).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter(zip((r[0] for r in rows), size, strict=True))
    source = {r[0]: r[2] for r in rows}
    taken = Counter()
    for r in got:
        assert r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        taken[source[r.doc_id]] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 2 * max(size)
    assert sum(taken.values()) <= 1.5 * sum(total.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0
    assert {r.taken for r in mixing.mix(docs.withColumn("text", F.lit(""))).collect()} == {0}


def test_mix_repeats_rows(docs):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken // r.size if r.size else 0
    own = docs.withColumns({"size": F.lit(-1), "taken": F.lit(-2), "_size": F.lit(-3), "_doc": F.lit(-4), "target": F.lit(-5)})
    out = mixing.repeated(own)
    assert out.columns == own.columns and {tuple(r) for r in out.select("size", "taken", "_size", "_doc", "target").collect()} == {(-1, -2, -3, -4, -5)}
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in taken.items() if n})


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (7, 6)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_do_not_hand_estimates_on(spark):
    """Sizes that the planner expects are not carried from round to round, where joins would square them; null ends and loops are no edges."""
    table = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(None, 3), (4, None), (200, 200)], "a long, b long")
    got = components.components(table)
    assert 0 <= got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 30
    assert {r.id: r.label for r in got.collect()} == dict.fromkeys(range(13), 0)
    assert components.components(table.where("a = 200")).count() == 0


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    rng = random.Random(9)
    lex = lexicon(rng)
    rows = [(i, " ".join(rng.choice(["vileword", "horridone"]) if i % 4 == 0 and rng.random() < 0.1 else rng.choice(lex) for _ in range(90)), "en", f"s{i % 3}", 1) for i in range(200)]
    rows += [(500, rows[1][1], "en", "s1", 1), (501, rows[2][1] + " one more", "en", "s1", 1), (502, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "sentencepiece"]
    clean = corpus_pipeline.drop_toxic(spark, read, str(tmp_path))
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == read.columns and len(kept & set(range(0, 200, 4))) <= 2 and len(kept - set(range(0, 200, 4))) >= 150
    unique = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, read, str(tmp_path)).collect()}
    assert {500, 501}.isdisjoint(unique) and {1, 2, 502} <= unique
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.round_trip for r in out) and {r.doc_id for r in out} <= kept
