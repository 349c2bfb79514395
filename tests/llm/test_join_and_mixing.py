"""N-gram join, mixing and the pipeline against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import common, mixing, ngram_join

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def shingles(text, n=5):
    w = (text or "").encode().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain_join(rows, over=(4, 5)):
    nodes = {}
    for i, text, *_ in rows:
        nodes.setdefault(shingles(text), []).append(i)
    keys = [k for k in nodes if k]
    links = {k: [] for k in keys}
    for a, x in enumerate(keys):
        for y in keys[a + 1 :]:
            both = len(x & y)
            if both * over[1] >= over[0] * (len(x) + len(y) - both):
                links[x].append(y)
                links[y].append(x)
    root = {}
    for k in keys:
        if k in root:
            continue
        seen, todo = {k}, [k]
        while todo:
            for y in links[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        first = min(i for x in seen for i in nodes[x])
        root |= dict.fromkeys(seen, first)
    return sorted((i, root[s], len(links[s]), len(nodes[s])) if (s := shingles(t)) else (i, i, 0, 1) for i, t, *_ in rows)


def join_rows(seed, n=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    rows, bases = [], [[word() for _ in range(rng.randint(60, 160))] for _ in range(6)]
    for i in rng.sample(range(10_000), n):
        words = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 80))]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = word()
        rows.append((i, rng.choice([" ", "\n"]).join(words), "s", None, 0))
    return [*rows, rows[0], (20_000, None, "s", "x", 0), (20_001, "", "s", "x", 0), (20_002, "one two", None, "x", 0), (20_003, "one  two", "s", "x", 0), (20_004, "a b c d e", "s", "x", 0)]


@pytest.mark.parametrize("seed, shingles_, nodes", [(1, 400_000, 2000), (2, 400_000, 2000), (3, 300, 2000), (4, 400_000, 3)])
def test_join_equals_plain(spark, monkeypatch, seed, shingles_, nodes):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles_)
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", nodes)
    monkeypatch.setattr(ngram_join, "PARTED", 1 if nodes < 10 else 8)
    rows = join_rows(seed)
    found = ngram_join.join_classes(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in found.collect()) == plain_join(rows)


def test_texts_of_one_template_part_before_they_are_verified(spark, monkeypatch):
    """700 texts with a similarity of a third hang together through subtrees; the component
    dissolves by their paths but for planted pairs, so no task gets more sets than those."""
    monkeypatch.setattr(ngram_join, "PARTED", 0)
    rng = random.Random(9)
    template = [f"t{k}" for k in range(100)]
    rows = [(i, " ".join([*template, *(f"u{rng.randint(0, 10**6)}" for _ in range(96))]), "s", None, 0) for i in range(700)]
    near = [(i + 10_000, r[1].rsplit(" ", 2)[0] + f" z{i} y", "s", None, 0) for i, r in enumerate(rows[:20])]
    docs = spark.createDataFrame(rows + near, SCHEMA)
    sizes, verify = {}, ngram_join.verify

    def seen(sets, groups, *rest):
        sizes["sets"], sizes["most"] = sets.count(), groups.groupBy("root").count().agg(F.max("count")).first()[0]
        return verify(sets, groups, *rest)

    refined = ngram_join.refined

    def before(nodes, groups, *rest):
        sizes["before"] = groups.groupBy("root").count().agg(F.max("count")).first()[0]
        return refined(nodes, groups, *rest)

    monkeypatch.setattr(ngram_join, "refined", before)
    monkeypatch.setattr(ngram_join, "verify", seen)
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join_classes(docs).collect()}
    assert all(found[i] == found[i + 10_000] == (i, 1) for i in range(20)) and all(found[i] == (i, 0) for i in range(20, 700))
    assert sizes["before"] > 300 and sizes["sets"] <= 80 and sizes["most"] <= 20


def test_agreement_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    least = ngram_join.least_agreement(0.8)
    assert least < 60 and (rng.binomial(96, 0.8, 10**6) < least).sum() <= 2 and (rng.binomial(96, 0.33, 10**6) >= least).mean() < 1e-4
    path = rng.integers(0, 2**32, (6, 96))
    path[3, :least], path[5, : least - 1] = path[1, :least], path[2, : least - 1]
    assert ngram_join.agreeing(path, np.zeros(6, np.int8), least).tolist() == [0, 1, 2, 1, 4, 5]
    assert ngram_join.agreeing(path, np.array([0, 0, 0, 0, 1, 1], np.int8), least).tolist() == [0, 1, 2, 3, 4, 5]


def test_one_of_each_class_stays(spark):
    rows = [*join_rows(4), (None, "no id", "s", "x", 0)]
    classes = {c for _, c, _, _ in plain_join(rows[:-1])}
    kept = ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(classes) and kept.filter("doc_id is null").count() == 1


def test_null_ids_follow_their_shingles(spark):
    rows = [(7, "a b c d e f", "s", "x", 0), (None, "a b c d e f", "s", "x", 0), (None, "other words are in this one", "s", "x", 0)]
    found = ngram_join.join_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in found), key=str) == [(7, 7, 0, 2), (None, 7, 0, 2), (None, None, 0, 1)]


def test_join_of_no_rows(spark):
    assert ngram_join.join_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_floor_meets_the_target():
    assert ngram_join.forest_floor(0.8, 0.9995) == 4 and ngram_join.forest_floor(0.99, 0.9995) == 6 and ngram_join.forest_floor(0.1, 0.9999) == 1


def test_tries_group_by_longest_common_prefix():
    rng = np.random.default_rng(2)
    path = rng.integers(0, 2, (40, 3, 4)).astype(np.uint32)
    tries = ngram_join.Tries(path)
    for depth in (1, 2, 3, 4):
        want = {}
        for tree in range(3):
            for i in range(40):
                want.setdefault((tree, *path[i, tree, :depth].tolist()), set()).add(i)
        assert sorted(map(sorted, tries.groups(depth))) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def near_copies(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def local_links(texts, target=0.9995):
    sets = ngram_join.shingle_sets([t.encode() for t in texts])
    path = ngram_join.paths(sets).reshape(len(sets), ngram_join.TREES, ngram_join.DEPTH).astype(np.uint32)
    floor = ngram_join.forest_floor(0.8, target)
    return set(zip(*map(np.ndarray.tolist, ngram_join.linked_pairs(sets, path, np.zeros(len(sets), np.int8), (4, 5), target, floor)))), sets, path


def test_recall_against_all_pairs():
    rng = random.Random(7)
    texts = sorted({t for _ in range(12) for t in near_copies(rng, 40, rng.randint(60, 200), 5)})
    found, sets, _ = local_links(texts)
    every = set()
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(x, sets[j], True))
            if both * 5 >= 4 * (len(x) + len(sets[j]) - both):
                every.add((i, j))
    assert found <= every and len(every) > 800 and len(found) / len(every) > 0.998


def test_prefixes_are_shortened_only_where_recall_is_short(monkeypatch):
    """A group of close copies stops at a longer prefix than a pair at the threshold."""
    depths = []
    groups = ngram_join.Tries.groups
    monkeypatch.setattr(ngram_join.Tries, "groups", lambda self, depth: depths.append(depth) or groups(self, depth))
    rng = random.Random(3)
    local_links(sorted(set(near_copies(rng, 120, 400, 1))))
    many, depths[:] = list(depths), []
    local_links(sorted(set(near_copies(rng, 3, 100, 4))))
    assert many == [6] and depths == [6, 5, 4]


def test_sides_are_only_compared_with_each_other():
    rng = random.Random(5)
    texts = sorted(set(near_copies(rng, 30, 80, 2)))
    within, sets, path = local_links(texts)
    side = np.array([i % 2 for i in range(len(sets))], np.int8)
    left, right = ngram_join.linked_pairs(sets, path, side, (4, 5), 0.9995, 4)
    assert (side[left] == 0).all() and (side[right] == 1).all()
    across = {tuple(sorted(p)) for p in zip(left.tolist(), right.tolist())}
    assert across == {(i, j) for i, j in within if side[i] != side[j]}


def test_a_large_group_of_short_texts_stays_small(spark):
    """20,000 different templated texts of six words or so, in one component."""
    import os

    script = """
import sys, resource
import numpy as np
from docquarry.llm import ngram_join as J
texts = [f"order number {i} was sent to you".encode() for i in range(4000)]
sets = J.shingle_sets(texts)
path = J.paths(sets).reshape(len(sets), J.TREES, J.DEPTH).astype(np.uint32)
side = np.repeat(np.array([0, 1], np.int8), 2000)
J.linked_pairs(sets, path, side, (4, 5), 0.9995, 4)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, env=os.environ | {"OPENBLAS_NUM_THREADS": "1"})
    assert int(said.stdout) < 1_000_000, said.stderr  # KB: one task of two whole blocks
    texts = [f"order number {i % 20_000} was sent to you on monday in a box" for i in range(20_000)]
    found = ngram_join.join_classes(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert found.groupBy("n_links", "n_copies").count().collect() == [(0, 1, 20_000)]


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = ngram_join.paths([x[:2500], x[500:]])
    assert abs((a == b).mean() - 2000 / 3000) < 0.15


# -- mixing ---------------------------------------------------------------------------------


def mix_rows(seed, sizes):
    rng = random.Random(seed)
    ids = iter(rng.sample(range(10**6), sum(sizes.values())))
    return [(next(ids), " ".join(["w"] * rng.randint(0, 40)), s, "en", 0) for s, n in sizes.items() for _ in range(n)]


def weights(tokens, a):
    p = np.array(tokens, float) / sum(tokens)
    w = p**a
    return w / w.sum()


def entropy(w):
    return float(-(w * np.log(w)).sum())


def test_bisection_meets_the_binding_target(spark):
    tokens = [1000, 300, 40, 7]
    shares = spark.createDataFrame([(t / sum(tokens),) for t in tokens], "share double")
    target = 0.9 * math.log(4)
    a = mixing.bisect_exponent(shares, target, 1e9)
    assert entropy(weights(tokens, a)) == pytest.approx(target, abs=1e-5)
    b = mixing.bisect_exponent(shares, target, 3.0)
    assert (1000 / 7) ** (1 - b) == pytest.approx(3.0, rel=1e-6) and b > a
    assert mixing.bisect_exponent(shares, 0.1, 3.0) == 1.0


def plain_mix(spark, rows, mix):
    """Which (doc_id, epoch) the plan asks for, from its weights alone."""
    key = {(r.doc_id, r.epoch): r.k for r in spark.createDataFrame([(r[0], e) for r in rows for e in range(4)], "doc_id long, epoch int").select("doc_id", "epoch", mixing.order_key(F.col("doc_id"), F.col("epoch"), mix.seed).alias("k")).collect()}
    out = []
    for plan in mix.plan.collect():
        mine = [r for r in rows if r[2] == plan.source]
        out += [(r[0], e) for r in mine for e in range(plan.epochs)]
        used = 0
        for r in sorted(mine, key=lambda r: key[r[0], plan.epochs]):
            used += len((r[1] or "").split())
            if plan.rest == 0 or used > plan.rest:
                break
            out.append((r[0], plan.epochs))
    return sorted(out)


@pytest.mark.parametrize("block", [50, 1_000_000])
def test_blocks_hold_the_weights(spark, block):
    rows = mix_rows(1, {"big": 400, "mid": 120, "small": 30, None: 20})
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.plan_mix(docs, max_epochs=2.5, block_tokens=block)
    found = mixing.realise(mix, 1000).collect()
    assert sorted((r.doc_id, r.epoch) for r in found) == plain_mix(spark, rows, mix)
    total = sum(r.n_tokens for r in found)
    share = {s: sum(r.n_tokens for r in found if r.source == s) / total for s in ("big", "mid", "small", None)}
    want = {r.source: r.weight for r in mix.plan.collect()}
    assert all(abs(share[s] - want[s]) < 0.01 for s in share) and sum(want.values()) == pytest.approx(1)
    spread = {}
    for r in found:
        spread.setdefault(r.block, []).append(r)
    assert len(spread) == math.ceil(mix.budget / 1000)
    for part in list(spread.values())[:-1]:
        assert sum(r.n_tokens for r in part if r.source == "big") / sum(r.n_tokens for r in part) == pytest.approx(want["big"], abs=0.12)
    copies = sorted((r.doc_id for r in mixing.rewrite(docs, max_epochs=2.5, block_tokens=block).collect()))
    assert copies == sorted(r.doc_id for r in found)


def test_salted_plan_equals_broadcast_plan(spark, monkeypatch):
    docs = spark.createDataFrame(mix_rows(2, {"a": 60, "b": 10}), SCHEMA)
    few = sorted((r.doc_id, r.epoch) for r in mixing.realise(mixing.plan_mix(docs)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id, r.epoch) for r in mixing.realise(mixing.plan_mix(docs)).collect()) == few


@pytest.mark.parametrize("rows", [[], [(1, None, "a", "x", 0), (2, "", None, "x", 0)], [(1, "w w", "a", "x", 0), (1, "w w", "a", "x", 0)], [(1, "w", "a", "x", 0), (2, None, "b", "x", 0)]])
def test_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert mixing.realise(mixing.plan_mix(docs)).count() == len(rows) == mixing.rewrite(docs).count()


# -- pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    prose = "the house stands near the old river and many people walk there every day in summer"
    rows = [(i, f"{prose} {chr(97 + i % 26)}{i} " + " ".join(f"x{chr(97 + i % 26)}{k}" for k in range(30)), f"s{i % 2}", "en", 0) for i in range(40)]
    rows += [(100, rows[0][1], "s0", "en", 0), (101, "12 34 !!", "s0", "en", 0), (102, None, "s1", None, 0), (103, "", "s1", "en", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in found} == set(range(40)) and all(r.lossless for r in found)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "mixing", "sentencepiece"]


EMPTY = "doc_id long, text string, lang string, source string, n_chars long, stage string, keep_id long"


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, "x", 7)], [(2**53 + 1, "the house stands here", "en", "s", 21, "x", 7), (None, "the house stands there", "en", "s", 22, "y", 8)]])
def test_pipeline_of_few_rows_and_clashing_columns(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, EMPTY).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()  # all stay where no language was learned
    assert sorted((r.doc_id for r in found), key=str) == sorted((r[0] for r in rows), key=str)


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "w w", "a", "x", 2, "n"), (2, "v", "a", None, 3, "m")], "doc_id long, text string, source string, keep_id string, nth long, epochs string")
    for made in (mixing.rewrite(docs), ngram_join.keep_one(docs)):
        assert made.columns == docs.columns and set(made.collect()) == set(docs.collect())


def test_many_empty_texts_are_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    rows = [(i, None if i % 2 else "", "a", "x", 0) for i in range(300)] + [(1000, "w", "b", "x", 0)]
    mix = mixing.plan_mix(spark.createDataFrame(rows, SCHEMA))
    assert mix.bits == 5 and mixing.realise(mix).count() == len(rows)


def test_intermediate_tables_go(spark):
    before = common.opened()
    mixing.realise(mixing.plan_mix(spark.createDataFrame(mix_rows(3, {"a": 9}), SCHEMA))).collect()
    made = [s for s in common.opened() if s not in before]
    common.clear(keep=before)
    assert made and common.opened() == before and not any(s._files.exists(s._folder) for s in made)
