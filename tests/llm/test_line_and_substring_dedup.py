"""Line dedup, substring dedup and components against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from docquarry.llm import common, graphs, line_dedup, substring_dedup

SCHEMA = "doc_id long, text string, n_lines string, kept string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_lines(rows, min_docs=3, min_chars=20):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup._UPPER, line_dedup._LOWER))
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [i is not None and len(h := holders.get(key(x), set())) >= min_docs and i < max(h) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def line_rows(seed):
    rng = random.Random(seed)
    pool = [f"Shared line number {k} of the pool" for k in range(8)] + ["short", "", " \t", "SHARED line number 1 of the pool \r", "x" * 20 + "  "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 12))), "a", "b") for i in rng.sample(range(100), 30)]
    return [*rows, rows[0], (rows[1][0], "Shared line number 2 of the pool", "a", "b"), (None, rows[2][1], None, None), (500, None, None, None), (501, "", "", ""), (502, "\n".join(pool * 400), "", "")]


@pytest.mark.parametrize("seed, batches", [(1, 1), (2, 3), (3, 5)])
def test_lines_equal_plain(spark, seed, batches):
    rows = line_rows(seed)
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), batches=batches)
    got = sorted(((r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.line_dedup.kept) for r in found.collect()), key=str)
    assert got == plain_lines(rows)


def test_lines_of_no_rows_and_columns_stay(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert line_dedup.dedup_lines(docs).count() == 0
    clash = "doc_id long, text string, line_dedup string, drop string, row_key long, lines string"
    assert line_dedup.rewrite(spark.createDataFrame([(1, "a", "x", "y", 2, "z")], clash)).collect() == [(1, "a", "x", "y", 2, "z")]


def plain_windows(rows, n=13):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in words:
        for k in range(len(w) - n + 1):
            if i is not None:
                first[tuple(w[k : k + n])] = min(i, first.get(tuple(w[k : k + n]), i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = " ".join(x.decode() for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), kept, sha(kept)))
    return sorted(out, key=str)


def window_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("a b cc dé e f".split(" ")) + str(rng.randint(0, 60))
    passages = [[word() for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 40):
        parts = [w for _ in range(rng.randint(0, 4)) for w in (rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 30))])]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts), "x", "y"))
    return [*rows, (2000, rows[3][1], "x", "y"), (2001, rows[3][1], "x", "y"), rows[3], (rows[4][0], rows[3][1], "", ""), (None, rows[5][1], "", ""), (3000, None, "", ""), (3001, "", "", ""), (3002, " ".join(["same"] * 3000), "", ""), (3003, " ".join(["same"] * 20), "", "")]


@pytest.mark.parametrize("seed, window, chunk", [(1, 13, 1 << 19), (2, 13, 400), (3, 50, 400), (4, 6, 400), (5, 27, 1 << 19)])
def test_windows_equal_plain(spark, monkeypatch, seed, window, chunk):
    """Through one to four levels, in one chunk and in many."""
    monkeypatch.setattr(substring_dedup, "CHUNK_TEXT_MOST", chunk)
    rows = window_rows(seed) + [(5000 + i, "\n".join(f"p{k}" for k in range(i, 70)), "", "") for i in range(6)]
    found = substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA), window)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in found.collect()), key=str) == plain_windows(rows, window)


def test_only_what_repeats_is_extended():
    """A level asks only about windows both of whose ends repeated at the level before, and
    about nothing where none did."""
    import pandas as pd

    words_ = [f"v{k}" for k in range(60)]
    docs = pd.DataFrame({"doc_id": [1, 2, 3], "row_key": [1, 2, 3], "text": [" ".join(words_), " ".join(["x", *words_[10:40], *[f"y{k}" for k in range(30)]]), " ".join(f"z{k}" for k in range(60))], "chunk": 0})
    none = pd.DataFrame(columns=["level", "a", "b", "bits"])
    asked = []
    for level, n in enumerate(substring_dedup.levels(50)):
        block = substring_dedup.Block(docs, none, substring_dedup.levels(50), 4)
        block.climb(level)
        asked.append(int(block.alive.sum()))
    assert asked == [3 * 0 + (60 - 6) + (61 - 6) + (60 - 6), 2 * (30 - 12), 2 * (30 - 24), 0]
    assert len(substring_dedup.Block(docs, none, substring_dedup.levels(50), 4).questions(3, 0)) == 0


def test_no_rows_have_no_windows(spark):
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_levels_double():
    assert substring_dedup.levels(13, 5) == [7, 13] and substring_dedup.levels(50, 5) == [7, 13, 25, 50]


def test_window_hashes_tell_windows_apart():
    import numpy as np

    x = common.randoms(50, 3)
    for n in (1, 2, 5, 13, 50):
        h = common.window_hashes(x, n)
        assert len(h) == 51 - n == len(set(h.tolist()))
        assert h[0] == common.window_hashes(x[:n].copy(), n)[0]
    assert len(common.window_hashes(np.zeros(3, np.uint64), 4)) == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(200, k) for k in range(201, 260)] + [(k, k + 1) for k in range(300, 360)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    want = {x: r for x, r in want.items() if any(x in e for e in edges if e[0] != e[1])}
    scratch = common.Scratch(spark, "test")
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    assert got == want
    assert graphs.components(spark.createDataFrame([], "u long, v long"), scratch, "none").count() == 0


def test_runs_leave_no_tables(spark):
    before = {t.name for t in spark.catalog.listTables()}
    line_dedup.dedup_lines(spark.createDataFrame(line_rows(1), SCHEMA), batches=4).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Cluster)
