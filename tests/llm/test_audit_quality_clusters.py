"""Source divergence, the byte network and dual-tree clustering against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import byte_cnn, dual_tree_kmeans as K, queries, source_divergence as S

DOCS = "doc_id long, text string, lang string, source string, TERM string, rank string, n string"


# -- source divergence ----------------------------------------------------------------------


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_divergence(rows, min_docs, ranks):
    df, tf, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        words = plain_terms(text)
        df[lang or ""].update(set(words))
        tf[lang or "", source or ""].update(words)
        groups.add((lang or "", source or ""))
    kept = {lang: {t for t, n in c.items() if n >= min_docs} for lang, c in df.items()}
    share = lambda count, total, v: 1 + 10**9 * (count + 2) // (total + 2 * v)
    p, whole = {}, {}
    for lang in {g[0] for g in groups}:
        terms = kept.get(lang, set())
        mine = [g for g in groups if g[0] == lang]
        for g in mine:
            total = sum(tf[g][t] for t in terms)
            p[g] = {t: share(tf[g][t], total, len(terms)) for t in terms}
        total = sum(tf[g][t] for g in mine for t in terms)
        whole[lang] = {t: share(sum(tf[g][t] for g in mine), total, len(terms)) for t in terms}
    far = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, source in groups:
        own = p[lang, source]
        pairs = [(sum(far(x, p[lang, other][t]) for t, x in own.items()), other) for where, other in groups if where == lang and other != source]
        best = [(far(x, whole[lang][t]), t) for t, x in own.items() if tf[lang, source][t] and x > whole[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", best, ranks)):
            ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence_equals_plain(spark):
    rng = random.Random(3)
    words = [*"alpha beta Gamma DELTA été ÉTÉ über x y z q-r 中文 a_b naïve".split(), *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(i, rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(0, 40)))]) if i % 7 == 0 else " ".join(rng.choices(words[: rng.randint(4, len(words))], k=rng.randint(1, 60))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "ß", "中", None]), "t", "r", "n") for i in range(160)]
    rows += [(500, "alpha " * 400_000, "en", "s1", "", "", ""), (501, "lonely", "xx", "s1", "", "", ""), (3, "alpha beta", "en", "s1", "", "", ""), (3, "alpha beta", "en", "s1", "", "", ""), (502, None, "yy", None, "", "", ""), (503, "", "yy", "b", "", "", "")]
    found = S.divergence(spark.createDataFrame(rows, DOCS).repartition(5), 10, 4)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == plain_divergence(rows, 10, 4)


def test_divergence_of_nothing(spark):
    assert S.divergence(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_dense_and_sparse_sums_are_the_same_numbers(seed):
    rng = np.random.default_rng(seed)
    groups, terms = 9, 60
    count = rng.integers(0, 6, (terms, groups)) * (rng.random((terms, groups)) < 0.4) * (10**10 if seed == 3 else 1)
    totals, v = count.sum(0) + rng.integers(0, 50, groups), terms + 7
    for first, last in ((0, 9), (0, 4), (4, 9), (8, 9)):
        dense = S.dense_sums(count, totals, v, first, last)
        term, group = np.nonzero(count)
        assert (dense == S.sparse_sums(term, group, count[term, group], terms, totals, v, first, last)).all()
        p = [[1 + 10**9 * (int(c) + 2) // (int(n) + 2 * v) for c, n in zip(row, totals)] for row in count]
        for a in range(first, last):
            assert [int(x) for x in dense[a - first]] == [sum((r[a] - r[b]) ** 2 // (r[a] + r[b]) for r in p) if b > a else 0 for b in range(groups)]


def test_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 10)
    text = b"ab cd efghijklmnopqrstuvwxyz ab  cd " * 5
    assert b"".join(S.pieces(text)) == text
    assert Counter(t for p in S.pieces(text) for t in S._TERM.findall(p)) == Counter(S._TERM.findall(text))


# -- the byte network -----------------------------------------------------------------------


def plain_probability(net, text):
    """One window, chunk and unit after the other."""
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    halves = max(2, -(-len(text) // byte_cnn.HALF))
    symbols = [b + 1 for b in text] + [0] * (halves * byte_cnn.HALF - len(text) + byte_cnn.WIDTH)
    hidden = []
    for chunk in range(halves - 1):
        best = np.full(byte_cnn.FILTERS, -np.inf)
        for start in range(chunk * byte_cnn.HALF, (chunk + 2) * byte_cnn.HALF, 2):
            window = np.concatenate([w["byte"][s] for s in symbols[start : start + byte_cnn.WIDTH]])
            best = np.maximum(best, window @ w["filter"])
        pooled = np.maximum(best + w["filter_bias"], 0)
        hidden.append(np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0))
    return 1 / (1 + math.exp(-float((np.mean(hidden, 0) @ w["out"] + w["out_bias"])[0])))


def test_probabilities_equal_plain_ones(monkeypatch):
    rng = random.Random(5)
    net = byte_cnn.Network(byte_cnn.initial(3))
    texts = [bytes(rng.choices(range(256), k=n)) for n in (0, 1, 7, 255, 256, 257, 511, 512, 513, 1300, 4000)]
    want = [plain_probability(net, t) for t in texts]
    assert byte_cnn.probabilities(net, texts) == pytest.approx(want, abs=2e-6)
    for batch in (512, 1024, 2048):  # long texts go piece by piece
        monkeypatch.setattr(byte_cnn, "BATCH", batch)
        assert byte_cnn.probabilities(net, texts) == pytest.approx(want, abs=2e-6)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in byte_cnn.initial(5).items()}
    bags = [[rng.bytes(512) for _ in range(n)] for n in (1, 3, 2)]
    flat, _, inside = byte_cnn.symbols([p for b in bags for p in b])
    bag, label, weight = np.repeat(np.arange(3), [1, 3, 2]), np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])

    def loss(w):
        p = np.array([plain_probability_of_bag(w, b) for b in bags])
        return -(weight * np.where(label == 1, np.log(p), np.log(1 - p))).sum() / weight.sum()

    def plain_probability_of_bag(w, pieces):
        found = [byte_cnn.pooled(w, *byte_cnn.symbols([p])[::2]) for p in pieces]
        h = [np.maximum(np.maximum(f[0], f[1]) @ w["hidden"] + w["hidden_bias"], 0) for f in found]
        return 1 / (1 + np.exp(-float((np.mean(h, 0) @ w["out"] + w["out_bias"])[0])))

    back = byte_cnn.gradients(w, flat, inside, bag, label, weight)
    for name in byte_cnn.PARAMETERS:
        for at in rng.choice(w[name].size, min(6, w[name].size), replace=False):
            place = np.unravel_index(at, w[name].shape)
            step = {k: v.copy() for k, v in w.items()}
            step[name][place] += 1e-5
            up = loss(step)
            step[name][place] -= 2e-5
            assert back[name][place] == pytest.approx((up - loss(step)) / 2e-5, abs=2e-5), name


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    found = queries.op12_byte_cnn(spark, d).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    own = [(labels[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in own]) >= 0.93 and sum(1 for a, b in own if a and not b) <= 2


def test_quality_without_labels_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (2, "x" * 700_000, "a"), (None, "text", "a")], "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (9, 7), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in byte_cnn.score(docs, byte_cnn.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in byte_cnn.score(docs, byte_cnn.fit(docs, labels)).collect()} == {1.0}
    both = labels.unionByName(spark.createDataFrame([(3, 0), (1, 0)], labels.schema))
    rows = byte_cnn.score(docs, byte_cnn.fit(docs.unionByName(spark.createDataFrame([(3, "###", "")], docs.schema)), both)).collect()
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.doc_id, r.held_out].add(r.score)
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and not next(r for r in rows if r.doc_id is None).held_out
    assert byte_cnn.score(docs.limit(0), byte_cnn.Network()).count() == 0


# -- clustering -----------------------------------------------------------------------------


def plain_lloyd(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * v) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [x for _, x in sorted(kept, key=key)[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))

    def nearest(x):
        return min((far(x, c), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        for j, xs in groups.items():
            centres[j] = [sum(col) // len(xs) for col in zip(*xs)]
    out, spread = [], Counter()
    for i, x in kept:
        d, j = nearest(x)
        spread[j] += d
        out.append((i, j, d))
    fit = lambda v: v if v < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, fit(d), fit(spread[j]), fit(sum(spread.values())), names[j]) for i, j, d in out), key=repr)


def vector_rows(seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(rng.choice([-2, 0, 3]), 0.4) for _ in range(5)]) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 0.0, 1.0]) for i in range(150)] + [(None, [0.1] * 5), (7, [9.0] * 5), (7, [9.0] * 5), (7, [-9.0] * 5)]
    return [*rows, (2000, None), (2001, [1.0] * 4), (2002, [1.0, None, 1.0, 1.0, 1.0]), (2003, [math.nan] * 5), (2004, [math.inf, 1.0, 1.0, 1.0, 1.0]), (2005, [])]


VECTORS = "vec_id long, embedding array<double>, cluster string, X string"


@pytest.mark.parametrize("seed, k, wide", [(1, 12, []), (2, 40, []), (3, 400, []), (4, 9, [1e6, -3e5, 2.5e7]), (5, 8, [1e30, -1e30, 3e38])])
def test_clusters_equal_plain_rounds(spark, seed, k, wide):
    rows = vector_rows(seed) + [(3000 + i, [v, 1.0, -v, 0.5, v / 3]) for i, v in enumerate(wide)]
    df = spark.createDataFrame([(i, x, "c", "x") for i, x in rows], VECTORS).repartition(3)
    found = K.cluster(df, k, 3, 5)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_lloyd(rows, k, 3, 5)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")], VECTORS)
    assert {r.cluster for r in K.cluster(df, 40, 2, 2).collect()} == {0}
    assert K.cluster(df.limit(0), 40, 2, 2).count() == 0 and K.cluster(df, 40, 2, 64).count() == 0


def test_cover_tree_holds_its_invariants():
    rng = np.random.default_rng(4)
    points = np.floor(256 * np.concatenate([rng.normal(0, 1, (700, 6)), np.zeros((50, 6))]))
    order, tree = K.cover_tree(points, 8)
    assert sorted(order.tolist()) == list(range(750)) and (tree.points == points[order]).all()
    for (centre, start, end, child, last), radius in zip(tree.nodes.tolist(), tree.radius):
        far = np.sqrt(((tree.points[start:end] - tree.points[centre]) ** 2).sum(1))
        assert start <= centre < end and far.max() == pytest.approx(radius)
        if last:
            kids = tree.nodes[child:last]
            assert kids[0][0] == centre and kids[0][1] == start and kids[-1][2] == end and (kids[1:, 1] == kids[:-1, 2]).all()
            gap = np.sqrt(((tree.points[kids[:, 0]][:, None] - tree.points[kids[:, 0]][None]) ** 2).sum(2))
            level = np.floor(np.log2(gap[0, 1:].min()))
            assert gap[np.triu_indices(len(kids), 1)].min() >= 2**level


def test_whole_subtrees_go_at_once():
    rng = np.random.default_rng(6)
    points = np.floor(256 * np.concatenate([rng.normal(c * 50, 0.1, (500, 4)) for c in range(4)]))
    _, tree = K.cover_tree(points, 16)
    found = list(K.assign(tree, K.Centroids([[int(c * 50 * 256)] * 4 for c in range(4)])))
    assert sum(e - s for s, e, _ in found) == 2000 and len(found) <= 8 and all(isinstance(c, int) for _, _, c in found)


def test_limbs():
    for x in (0, 1, -1, 2**31, -(2**95) - 7, 2**140, 10**40):
        assert K.whole(K.limbs(x)) == x
    assert K.whole([a + b for a, b in zip(K.limbs(-5), K.limbs(3 * 2**70))]) == 3 * 2**70 - 5


def test_plain_numbers_for_whole_tables(spark):
    """The registered audit counts every document, whatever its length."""
    d = "/root/testdata/sf0.001"
    found = queries.op11_source_divergence(spark, d).filter(F.col("part") == "term").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in found) == [r for r in plain_divergence(rows, 10, 10) if r[2] == "term"]
