"""Trained operators: language, toxicity, main text. Held-out accuracy and plain versions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from docquarry.llm import html_extract, language_id, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, score double"
SYLLABLES = {"aa": ["ka", "to", "mi", "ra", "ne"], "bb": ["sch", "ung", "ber", "ich", "tz"], "cc": ["eau", "oux", "ent", "que", "ai"]}


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def words(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


# -- language -------------------------------------------------------------------------------


def plain_phrases(known, text):
    """Greedy longest matches of a text, already read, in a learned one."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        at, count = at + size, count + 1
    return count


def plain_read(text):
    return " ".join("".join(ch if ch.isalpha() else " " for ch in text.lower()).split())


@pytest.mark.parametrize("seed, few", [(0, 12), (1, 12), (2, 1), (3, 1000)])
def test_parse_score_and_language_equal_plain_ones(seed, few, monkeypatch):
    monkeypatch.setattr(language_id, "_FEW", few)
    rng = random.Random(seed)
    learned = {lang: words(rng, lang, 40) for lang in SYLLABLES}
    model = language_id.learn(learned, 10_000)
    own = language_id.Identifier(model)
    texts = ["".join(rng.choices("katomierschungé ,.1", k=rng.randint(0, 80))) for _ in range(60)] + [words(rng, rng.choice("a b c".split()) * 2, 300), "", None, "² ½", "1 2!", "Ж", "K\u0130é " * 3]
    langs, scores, _ = own.predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        body = plain_read(text or "")
        if not body:
            assert (lang, score) == ("und", 0)
            continue
        cost = {k: plain_phrases(plain_read(t), body) * np.log2(2 + len(plain_read(t))) for k, t in sorted(learned.items())}
        if all(plain_phrases(plain_read(t), body) == len(body) for t in learned.values()):
            cost = dict.fromkeys(sorted(learned), 0.0)
        assert lang == min(cost, key=lambda k: (cost[k], k))
        share = 1 / sum(2.0 ** max(cost[lang] - c, -200) for c in cost.values())
        longer = 1 - min(plain_phrases(plain_read(t), body) for t in learned.values()) / len(body)
        assert score == pytest.approx(1 / 3 + min(1, 3 * longer) * (share - 1 / 3))


def test_unlearned_scripts_have_the_score_of_no_knowledge():
    rng = random.Random(5)
    model = language_id.learn({"big": words(rng, "aa", 900), "apart": words(rng, "bb", 30)}, 10_000)
    texts = ["ことばはちがう ひらがな", "Слово и дело", "漢字 한글", "ж", "katomirane katora", "schungber"]
    langs, scores, _ = language_id.Identifier(model).predict(texts)
    assert langs[:4] == ["apart"] * 4 and scores[:4] == pytest.approx([0.5] * 4)
    assert langs[4:] == ["big", "apart"] and min(scores[4:]) > 0.9


def test_rare_learned_letters_are_told_from_unlearned_ones(monkeypatch):
    monkeypatch.setattr(language_id, "COMMON", 4)
    model = language_id.learn({"x": "abcd abce abcf漢字漢字", "y": "dcba"}, 1000)
    assert len(model.alphabet) == 4 and "漢" in model.rare
    symbols = language_id.read(["漢ж"], model.alphabet, model.rare)[0].tolist()
    assert symbols[0] != symbols[1] == 1 + 4 + language_id.SHARED


def test_many_languages_share_the_tables():
    rng = random.Random(3)
    texts = {f"l{k:03}": words(rng, "aa", 4000) for k in range(40)}
    model = language_id.learn(texts, 60_000)
    cells = sum(2 * len(t) for t in model.texts) * (2 + len(model.alphabet) + language_id.SHARED)
    assert len(model.langs) == 40 and cells <= language_id.CELLS


def language_rows(n=240):
    rng = random.Random(1)
    return [(i, words(rng, lang, rng.randint(5, 60)), lang, "s", 0.5) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_languages(spark):
    rows = [*language_rows(), (900, None, "aa", "s", 0.0), (901, "12 !!", "aa", "s", 0.0), (902, "", None, "s", 0.0), (0, "12", "bb", "s", 0.0), (903, "katomi " * 30_000, None, "s", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {(r.doc_id, r.lang_pred == "und"): r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 for (i, _), r in found.items())
    right = [found[i, False].lang_pred == lang for i, _, lang, _, _ in language_rows() if held(i)]
    assert np.mean(right) > 0.98 and len(right) > 50
    assert all(found[i, True].score == 0 for i in (900, 901, 902, 0)) and found[903, False].lang_pred == "aa"
    kept = language_id.keep_identified(docs, language_id.fit(docs))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4


def test_held_out_rows_are_not_learned(spark):
    rows = language_rows()
    other = [(i, t, "zz" if held(i) else lang, s, x) for i, t, lang, s, x in rows]
    fit = lambda r: language_id.fit(spark.createDataFrame(r, SCHEMA))
    assert fit(rows) == fit(other)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(2, "some text", None, "s", 0.0)], SCHEMA)
    assert [r.lang_pred for r in language_id.identify(docs, language_id.fit(docs)).collect()] == ["und"]
    assert language_id.identify(docs.limit(0), language_id.fit(docs)).count() == 0


def test_a_language_of_long_texts_is_learned(spark):
    learned = next(i for i in range(9) if not held(i))
    docs = spark.createDataFrame([(learned, "some text " * 30_000, "aa", "s", 0.0), (learned + 1, "12", None, "s", 0.0)], SCHEMA)
    assert language_id.fit(docs).langs == ("aa",)
    assert [r.doc_id for r in language_id.keep_identified(docs, language_id.fit(docs)).collect()] == [learned]


def test_noise_goes_and_language_stays(spark):
    rng = random.Random(5)
    rows = [*language_rows(), (2000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1500)), None, "s", 0.0), (2001, "ein kurzer xq", None, "s", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in language_id.keep_identified(docs, language_id.fit(docs)).collect()}
    assert kept == {r[0] for r in rows} - {2000}


@pytest.mark.parametrize("lang", [None])
def test_all_rows_stay_where_nothing_is_learned(spark, lang):
    docs = spark.createDataFrame([(2, "some text", lang, "s", 0.0), (3, "12", None, "s", 0.0)], SCHEMA)
    assert sorted(language_id.keep_identified(docs, language_id.fit(docs)).collect()) == sorted(docs.collect())


# -- toxicity --------------------------------------------------------------------------------


def plain_kernel(s, t):
    """Sum over pairs of equal three-character subsequences, each within the span limit."""

    def features(x):
        out = {}
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, len(x)):
                    if k - i + 1 <= toxicity.SPAN and (j - i, k - j) in toxicity._GAPS:
                        key = x[i] + x[j] + x[k]
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = features(s), features(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel_norms_and_landmark_features():
    kernel = toxicity.Kernel("<>abcdeg")
    strings = ["<abc>", "<aabbcc>", "<badge>", "<abcdeabcde>", "<aaaaaaaa>"]
    want = [plain_kernel(s, s) ** 0.5 for s in strings]
    assert kernel.norms(kernel.encode(strings)) == pytest.approx(want)
    space = toxicity.Landmarks.of(kernel, strings[:3])
    found = space.likeness(strings)
    for i, s in enumerate(strings):
        for j, t in enumerate(strings[:3]):
            assert found[i, j] == pytest.approx((plain_kernel(s, t) / want[i] / want[j]) ** toxicity.SHARP, abs=1e-4)
    x = space.likeness(strings[:3]) @ space.root()
    assert x @ x.T == pytest.approx(found[:3], abs=1e-3)


def plain_decision(model, text):
    """The strongest sentence: the sum of its parts' likeness to the landmarks, weighted."""
    own = toxicity.Landmarks(toxicity.Kernel(model.alphabet), model.columns, model.marks)
    sums = [float((own.likeness(list(s)) @ model.weights).sum()) for s in toxicity.sentence_parts(text)]
    return (max(sums) if sums else 0.0) + model.bias


def test_decisions_equal_plain_ones():
    rows = toxic_rows(200)
    model = toxicity.train([t for _, t, _ in rows], np.array([y for _, _, y in rows]))
    rng = random.Random(4)
    texts = [". ".join(words(rng, "aa", rng.randint(1, 70)) for _ in range(rng.randint(1, 4))) for _ in range(12)]
    texts += ["kato blorfik mi. ka to", "b l o r f i k", "x" * 300 + " blorfik " + "kato" * 30, "", "a b", "vash-tok!\nkato mira"]
    texts += [" ".join(rng.choice(["kato", "---", "...,", "blorfik", "a-b-c" * 9, "!"]) for _ in range(70)) for _ in range(8)]
    found = toxicity.Scorer(model).decisions(texts)
    assert found == pytest.approx([plain_decision(model, t) for t in texts], abs=1e-3)


def test_insults_in_other_scripts_are_found():
    rng = random.Random(6)
    clean, bad = ["あいうえお", "かきくけこ", "さしすせそ", "たちつてと", "なにぬねの", "はひふへほ", "まみむめも"], ["ばぼびぶご", "ぜじゃずぞ", "漢罵詈雑言"]
    rows = []
    for i in range(240):
        toxic = i % 3 == 0
        text = [" ".join(rng.choices(clean, k=rng.randint(4, 12))) for _ in range(4)]
        rows.append((". ".join(text[:2] + ([rng.choice(clean) + " " + rng.choice(bad)] if toxic else []) + text[2:]), int(toxic)))
    model = toxicity.train([t for t, _ in rows[:180]], np.array([y for _, y in rows[:180]]))
    score = model.score(toxicity.Scorer(model).decisions([t for t, _ in rows[180:]]))
    held = np.array([y for _, y in rows[180:]])
    assert (score[held == 1] >= 0.7).all() and (score[held == 0] < 0.7).all()


def test_sentences():
    assert toxicity.sentence_parts("One two. Three!  four\nf-i-ve s i x") == [("<one>", "<two>"), ("<three>",), ("<four>",), ("<five>",), ("<six>",)]
    assert toxicity.sentence_parts(None) == toxicity.sentence_parts(" . ") == []
    assert [len(s) for s in toxicity.sentence_parts("word " * 100)] == [40, 40, 20]


INSULTS = ["blorfik", "grunzel", "vashtok"]


def toxic_rows(n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        text, bad = words(rng, "aa", rng.randint(10, 80)).split(), rng.random() < 0.25
        for _ in range(rng.randint(1, 3) * bad):
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_held_out_toxicity_with_gaps_and_insertions(spark):
    rows = toxic_rows()
    more = [(5000, "ka to b l o r f i k mi"), (5001, "kato blorXfik mi"), (5002, "g.r.u.n.z.e.l"), (5003, None), (5004, ""), (5005, "kato mira " * 5000), (5006, "x" * 100_000), (0, "kato")]
    docs = spark.createDataFrame([(i, t, "x", "y", 0.0) for i, t, _ in rows] + [(i, t, "x", "y", 0.0) for i, t in more], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (7000, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    by_id = {r.doc_id: r for r in found if r.doc_id != 0}
    right = [by_id[i].predicted == y for i, _, y in rows if held(i) and i]
    assert np.mean(right) > 0.98 and len(right) > 150
    assert [by_id[i].predicted for i in range(5000, 5007)] == [1, 1, 1, 0, 0, 0, 0]
    assert by_id[5003].score == by_id[5004].score and len(found) == len(rows) + len(more)
    swapped = spark.createDataFrame([(i, 1, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, swapped)).collect() if r.doc_id}
    assert all(again[i] == r.score for i, r in by_id.items() if i)


def test_one_class_or_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 0.0)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


def small_rows(seed, n_bad=6, n_good=46, insult="blorfik"):
    """Every other toxic text has the insult, no clean one has."""
    rng = random.Random(seed)
    texts = [words(rng, "aa", 30) + (f" {insult}" if i < n_bad and i % 2 == 0 else "") for i in range(n_bad + n_good)]
    return texts, np.array([int(i < n_bad) for i in range(n_bad + n_good)])


@pytest.mark.parametrize("seed", range(3))
def test_small_tables_are_trained(seed):
    model = toxicity.train(*small_rows(seed))
    rng = random.Random(100 + seed)
    fresh = [words(rng, "aa", 8) for _ in range(40)]
    found = model.score(toxicity.Scorer(model).decisions([f"{t} blorfik" for t in fresh]))
    other = model.score(toxicity.Scorer(model).decisions(fresh))
    assert (found >= 0.7).all() and np.mean(other >= 0.7) < 0.2 and found.min() > np.median(other)


def test_given_small_table_finds_its_toxic_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("NOT held_out").groupBy("toxic").agg({"predicted": "avg"})
    rates = {r[0]: r[1] for r in found.collect()}
    assert rates[1] > 0.5 and rates[0] < 0.1


@pytest.mark.parametrize("sf, area, recall, alarms", [("sf0.01", 0.78, 0.5, 0.06)])
def test_held_out_labels_of_the_given_tables(spark, sf, area, recall, alarms):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet") for name in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    bad, good = ([r for r in found if r.toxic == y] for y in (1, 0))
    above = np.mean([(b.score > g.score) + 0.5 * (b.score == g.score) for b in bad for g in good])
    assert above > area and np.mean([r.predicted for r in bad]) > recall and np.mean([r.predicted for r in good]) < alarms


def test_texts_without_parts():
    assert toxicity.train(["a", "b c", "", "x y"], np.array([1, 1, 0, 0])).weights is None


# -- main text ---------------------------------------------------------------------------------


def test_held_out_layouts():
    tagger = html_extract.Tagger(html_extract.default_chain())
    pages = [html_extract.labelled_page(seed) for seed in range(5000, 5300)]
    assert np.mean([tagger.main_text(h) == "\n".join(main) for h, main in pages]) > 0.95


def test_viterbi_equals_all_labelings():
    import itertools

    chain = html_extract.default_chain()
    tagger = html_extract.Tagger(chain)
    for seed in range(6):
        blocks = html_extract.leaf_blocks(html_extract.labelled_page(seed)[0])[:9]
        scores = [tuple(a + b for a, b in zip(tagger._sum(html_extract.path_features(x.path)), tagger._sum(html_extract.text_features(x)))) for x in blocks]

        def total(y):
            return sum(s[a] for s, a in zip(scores, y)) + sum(chain.turn[a][b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=total)
        assert total(tagger.labels(blocks)) == pytest.approx(total(best))


#: Pages written by hand, unlike the generator's: plain wrappers, tables for layout, open
#: links, upper case, old and new markup.
FERRY = "The ferry left the island at noon and reached the harbour before dark."
STORM = "Nobody could remember a storm that had kept its captain away in twenty years."
HAND = [
    (f"<div><p>{FERRY}</p><p>{STORM}</p></div>", [FERRY, STORM]),
    (f'<div class="text">{FERRY}<br><br>{STORM}</div>', [f"{FERRY} {STORM}"]),
    (f"<HTML><BODY><P>{FERRY}<P>{STORM}</BODY></HTML>", [FERRY, STORM]),
    (f'<body><div id="wrapper"><div class="nav"><a href="/">Home</a> <a href="/n">News</a></div><div class="main-column"><h1>Ferry is back</h1><p>{FERRY}</p><p>{STORM}</p></div><div class="footer">&copy; 2020 Harbour Times</div></div></body>', ["Ferry is back", FERRY, STORM]),
    (f'<ul class="menu"><li><a href="a">Home<li><a href="b">News</ul><article><p>{FERRY}</p><p>{STORM}</p></article>', [FERRY, STORM]),
    (f'<main><section><h2>At sea</h2><p>{FERRY}</p></section><section><h2>Storms</h2><p>{STORM}</p></section></main><div id="comments"><p>Great read, thanks for posting it here!</p></div>', ["At sea", FERRY, "Storms", STORM]),
    (f'<header><p>Harbour Times daily</p></header><div><div><article><p>{FERRY}</p><div class="advert"><p>Buy two tickets and save a lot.</p></div><p>{STORM}</p></article></div></div><form><p>Subscribe now</p><input></form>', [FERRY, STORM]),
    (f"<table><tr><td><p>{FERRY}</p><p>{STORM}</p></td></tr></table>", [FERRY, STORM]),
    (f'<div class="cookie-notice"><p>We use cookies to make this site work for you.</p></div><div class="post"><p>{FERRY} <a href="x">More</a> about it.</p><blockquote><p>{STORM}</p></blockquote></div><aside><h3>Related</h3><ul><li><a href="1">Old boats</a></li></ul></aside>', [f"{FERRY} More about it.", STORM]),
    (f"<nav><ul><li><a href='/'>Start</a></li></ul></nav><div><div class='row'><div class='col'><p>{FERRY}</p></div></div><div class='row'><div class='col'><p>{STORM}</p></div></div></div><footer><p>All rights reserved</p></footer>", [FERRY, STORM]),
]


def test_pages_of_other_hands():
    tagger = html_extract.Tagger(html_extract.default_chain())
    assert [tagger.main_text(h) for h, _ in HAND] == ["\n".join(want) for _, want in HAND]


def test_an_open_link_ends_with_its_block():
    blocks = html_extract.leaf_blocks("<ul><li><a href=x>Home<li>Two</ul><p>Three</p><a href=y><div>Four</div></a><div>Five</div>")
    assert [(b.text, b.linked > 0) for b in blocks] == [("Home", True), ("Two", False), ("Three", False), ("Four", True), ("Five", False)]


PAGES = [
    ("<nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>T &amp; U</h1><p>one  two<br>three<p><b>four</b>\n five&nbsp;six</article><footer>&copy; x</footer>", "T & U\none two three\nfour five six"),
    ("<article><h1>Title here</h1><p>Broken text &am", "Title here\nBroken text &am"),
    ("<article><p>Text of the page.</p><script>var t='</p>'; x", "Text of the page."),
    ("<article><p>Text of the page.</p><di", "Text of the page."),
    ("<article><p>a < b and 1 &lt; 2 of it.</p><!-- no > --></article>", "a < b and 1 < 2 of it."),
    ("", ""),
    (None, ""),
    ("<nav><a href='x'>only menus</a></nav>", ""),
]


def test_pages(spark):
    rows = [(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], "x"), (99, "u", "<article>" + "<p>word word.</p>" * 20_000 + "</article>", "x")]
    found = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert [found[i].text for i in range(len(PAGES))] == [want for _, want in PAGES]
    assert found[None].text == PAGES[0][1] and found[99].n_chars == 20_000 * 11 - 1
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
