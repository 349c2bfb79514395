"""GIF, fingerprints, the piece codec: round trips and plain versions."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
import xxhash

from docquarry.llm import fingerprints, gif_store, queries
from docquarry.llm import sentencepiece_codec as sp

TEXTS = ["", "a", "Ünïcode 你好 😀 ", "ab" * 3000, "line\nnext\n", "xy z" * 17000, " "]


@pytest.mark.parametrize("size", [0, 1, 300, 5000, 40000])
def test_lzw_round_trip(size):
    rng = random.Random(size)
    for alphabet in (2, 8, 256):
        data = bytes(rng.randrange(alphabet) for _ in range(size))
        assert gif_store.lzw_decode(gif_store.lzw_encode(data), 8) == data
    small = bytes(rng.randrange(4) for _ in range(size))
    assert gif_store.lzw_decode(gif_store.lzw_encode(small, 2), 2) == small


def test_broken_stream_is_an_error():
    with pytest.raises(ValueError):
        gif_store.lzw_decode(gif_store._pack(np.array([256, 65, 300], np.uint16), np.array([9, 9, 9], np.uint8)), 8)
    with pytest.raises(ValueError):
        list(gif_store.read_frames(b"GIF89a\x01"))


def frame(x, y, w, h, samples, disposal=0, clear=None, delay=5, interlaced=False):
    control = bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0, 0])
    place = b"".join(v.to_bytes(2, "little") for v in (x, y, w, h))
    return control + b"\x2c" + place + bytes([0x40 * interlaced, 2]) + gif_store._blocks(gif_store.lzw_encode(bytes(samples), 2))


def test_disposal_transparency_and_times():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a\x02\0\x02\0\x81\0\0" + palette
    body = frame(0, 0, 2, 2, [1, 1, 1, 1], 1) + frame(0, 0, 1, 1, [2], 2) + frame(1, 1, 1, 1, [3], 3) + frame(0, 0, 2, 1, [0, 2], 0, clear=0)
    frames = list(gif_store.read_frames(head + body + b";"))
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    shown = [[tuple(map(int, p)) for p in f.canvas.reshape(-1, 4)] for f in frames]
    assert shown == [[red] * 4, [green, red, red, red], [none, red, red, blue], [none, green, red, red]]
    assert [(f.start, f.delay) for f in frames] == [(0, 5), (5, 5), (10, 5), (15, 5)]
    assert frames[2].histogram().sum() == 3


def test_interlaced_rows():
    head = b"GIF89a\x01\0\x05\0\x81\0\0" + bytes(range(12))
    found = next(gif_store.read_frames(head + frame(0, 0, 1, 5, [0, 1, 2, 3, 0], interlaced=True) + b";"))
    assert found.indices.ravel().tolist() == [0, 3, 2, 0, 1]


def test_store_and_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gif string")
    found = {r.doc_id: r for r in queries.op3_of(docs).collect()}
    for i, text, _ in rows:
        data = (text or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        assert (found[i].n_bytes, found[i].payload_bytes, found[i].payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert found[i].tail_crc32 == zlib.crc32(padded[-64:]) and found[i].feature == plain_feature(padded)
    stored = gif_store.store_texts(docs)
    for r in stored.collect():
        assert hashlib.sha256(r.gif).hexdigest() == found[r.doc_id].media_sha256 and len(r.gif) == found[r.doc_id].media_bytes
        assert plain_samples(bytes(r.gif))[: found[r.doc_id].n_bytes] == (rows[r.doc_id][1] or "").encode()
    assert sorted((r.frame, r.start, r.delay) for r in gif_store.frames_of(stored).filter("doc_id = 5").collect()) == [(0, 0, 10), (1, 10, 10)]
    assert found[0].feature == found[len(TEXTS)].feature
    assert gif_store.media_columns(docs.limit(0)).count() == 0


def plain_feature(payload):
    """Frames of 64 KB shown for a tenth of a second each, and the counts of the colours
    seen: a shorter last frame leaves the rest of the one before."""
    out, seen = [], b""
    for k in range(0, len(payload), 65536):
        counts = [0] * 64
        seen = payload[k : k + 65536] + seen[len(payload[k : k + 65536]) :]
        for b in seen:
            counts[(b >> 6) * 16 + (b * 7 % 256 >> 6) * 4 + (b * 31 % 256 >> 6)] += 1
        out.append(f"{k // 65536 * 10}+10:" + ",".join(map(str, counts)))
    return ";".join(out)


def plain_samples(gif):
    """All frames' samples of a GIF without local palettes, decoded bit by bit."""
    at, out = 13 + 768, b""
    while gif[at] != 0x3B:
        image = gif[at] == 0x2C
        at += 11 if image else 2
        body = b""
        while n := gif[at]:
            body += gif[at + 1 : at + 1 + n]
            at += n + 1
        at += 1
        if not image:
            continue
        bits, width, table, before, place = int.from_bytes(body, "little"), 9, {}, None, 0
        while True:
            code = bits >> place & ((1 << width) - 1)
            place += width
            if code == 257:
                break
            if code == 256:
                table, width, before = {i: bytes([i]) for i in range(256)} | {256: b"", 257: b""}, 9, None
                continue
            piece = table[code] if code in table else before + before[:1]
            out += piece
            if before is not None and len(table) < 4096:
                table[len(table)] = before + piece[:1]
            if len(table) == 1 << width and width < 12:
                width += 1
            before = piece
    return out


# -- fingerprints ------------------------------------------------------------------------


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(n))


def test_shared_substrings_share_interior_names():
    rng = random.Random(1)
    common = prose(rng, 200)
    for pad in range(1, 9):
        a, b = (fingerprints.phrase_levels([(x + common + y).encode()]) for x, y in (("", "zz"), (prose(rng, pad), "")))
        for level in range(3):
            x, y = set(a[level][0].tolist()), set(b[level][0].tolist())
            assert len(x & y) >= 0.85 * min(len(x), len(y)) - 6


def test_names_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 60)).encode() for _ in range(30)] + [b"", b"a", b"aaaaaaaa", b"ab"]
    assert fingerprints.sketches(texts) == [fingerprints.sketches([t])[0] for t in texts]


def test_likeness():
    rng = random.Random(3)
    a, b = prose(rng, 600), prose(rng, 600)
    half = a[: len(a) * 2 // 3] + b[: len(b) // 3]
    x, y, z, empty = fingerprints.sketches([a.encode(), half.encode(), b.encode(), b""])
    assert fingerprints.likeness(x, x) == 1 == fingerprints.likeness(empty, empty)
    assert fingerprints.likeness(x, z) < 0.1 < 0.25 < fingerprints.likeness(x, y) and fingerprints.likeness(empty, x) == 0


def plain_fingerprint(data):
    """Phrase names level by level, a symbol at a time."""
    mask = (1 << 64) - 1

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & mask
        return x ^ x >> 31

    def toss(own, left):
        bit = ((own ^ left) & -(own ^ left)).bit_length() - 1
        return 2 * bit + (own >> bit & 1)

    up = lambda k: pow(0x5851F42D4C957F2D, k, 1 << 64)
    names, out = [int(fingerprints._BYTES[0][b]) for b in data], []
    for _ in range(fingerprints.LEVELS):
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [mix((x + n * 0x632BE59BD9B4E019) & mask) if n > 1 else x for x, n in runs]
        label = [toss(x, names[i - 1] if i else x ^ mask) for i, x in enumerate(names)]
        for _ in range(3):
            label = [toss(x, label[i - 1] if i else x ^ 1) for i, x in enumerate(label)]
        n = len(names)
        starts = [i for i in range(n) if not i or 0 < i < n - 1 and label[i] > label[i - 1] and label[i] >= label[i + 1]]
        names = [mix(sum(x * up(k) for k, x in enumerate(names[a:b])) & mask) for a, b in zip(starts, [*starts[1:], n])]
        low = sorted({mix(x) >> 32 for x in names})
        out.append(f"{len(low)}:" + "".join(f"{x:08x}" for x in low[: fingerprints.SKETCH]))
    return "/".join(out)


def plain_likeness(one, other):
    if one == other:
        return 1.0
    a, b = ([(int(n), {h[k : k + 8] for k in range(0, len(h), 8)}) for n, h in (part.split(":") for part in x.split("/"))] for x in (one, other))
    level = max((k for k in range(1, len(a)) if min(a[k][0], b[k][0]) >= fingerprints.SKETCH), default=0)
    least = sorted(a[level][1] | b[level][1])[: fingerprints.SKETCH]
    return sum(h in a[level][1] and h in b[level][1] for h in least) / len(least) if least else 0.0


@pytest.mark.parametrize("n", [1, 2, 57])
def test_next_documents(spark, n):
    rng = random.Random(n)
    rows = [(i, prose(rng, rng.randint(0, 40)), "x") for i in rng.sample(range(10**9), n)]
    rows += [(None, "no id", "x"), (5, None, "x"), (rows[0][0], "again", "y")] if n > 2 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    rows += [(2**53 + 1, "large id", "x"), *[(None, f"{k} has no id", "x") for k in range(20)]] if n > 2 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), -signed(xxhash.xxh64(r[1].encode(), 42).intdigest())))
    want = []
    for k, (i, text) in enumerate(order):
        cut = len(text) // 3
        want.append((str(i), len(text), hashlib.sha256((text[: len(text) - cut] + order[(k + 1) % len(order)][1][:cut]).encode()).hexdigest()))
    found = fingerprints.with_next(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted(want)
    by_hash = {h: (text, nxt) for (_, text), (_, nxt), (_, _, h) in zip(order, [*order[1:], order[0]], want)}
    for r in found:
        text, nxt = by_hash[r.edited_sha256]
        cut = len(text) // 3
        a, b, c = (plain_fingerprint(t.encode()) for t in (text, text[: len(text) - cut] + nxt[:cut], nxt))
        assert (r.fingerprint, r.edited_fingerprint) == (a, b)
        assert r.near_edited == pytest.approx(plain_likeness(a, b)) and r.near_next == pytest.approx(plain_likeness(a, c))


def test_no_documents_have_no_next(spark):
    assert fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- pieces --------------------------------------------------------------------------------

needs_model = pytest.mark.skipif(not os.path.exists(sp.DEFAULT_MODEL), reason="the public vocabulary is not installed")


@needs_model
def test_ids_equal_the_library_and_decode():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sp.DEFAULT_MODEL)
    codec = sp.Codec(sp.load_model())
    rng = random.Random(9)
    parts = ["a", " ", "  ", "the ", "\n", "é", "你", "ab", "\t", "ing", "😀", "zq", "aaaa", " \n", "tion", "THE", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500)] + ["abcdefghijk" * 2000, "▁x ▁", "internationalisation " * 3]
    for learn in (False, True):
        if learn:
            codec = sp.Codec(sp.load_model())
            codec.learn(texts)
        for text in texts:
            assert codec.encode(text) == library.encode(text)
            assert "▁" in text or codec.decode(codec.encode(text)) == text


def toy(kind):
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -3.5, "aba": -4.0, "ba": -3.9, "▁abab": -9.0}
    return sp.PieceModel(list(pieces) + ["<unk>"], [*pieces.values(), 0.0], [True] * len(pieces) + [False], [], len(pieces), kind)


def committed(model, text):
    """What a decoder that keeps all paths may commit, character by character: the last
    boundary that every path to a boundary in reach runs through."""
    longest, back, base, out = max(map(len, model.ids)), {0: (None, 0.0)}, 0, []
    for end in range(1, len(text) + 1):
        found = [(back[s][1] + model.scores[i], s) for s in range(max(0, end - longest), end) if s in back and (i := model.ids.get(text[s:end])) is not None]
        if found:
            back[end] = (max(found, key=lambda x: x[0])[1], max(found, key=lambda x: x[0])[0])
        if end not in back or end - base < longest:
            continue

        def way(b):
            out = [b]
            while back[b][0] is not None:
                b = back[b][0]
                out.append(b)
            return set(out)

        meet = max(set.intersection(*[way(b) for b in range(end - longest + 1, end + 1) if b in back]))
        if meet > base:
            out.append((base, meet))
            base = meet
    return [*out, (base, len(text))]


def test_ids_are_committed_whenever_the_paths_meet():
    model, rng = toy("unigram"), random.Random(8)
    for _ in range(60):
        text = "▁" + "".join(rng.choices("ab▁", k=rng.randint(1, 60)))
        runs, at, spans = list(sp.Codec(model).viterbi(text)), 0, []
        for run in runs:
            size = sum(len(model.pieces[i]) for i in run)
            spans.append((at, at + size))
            at += size
        assert spans == committed(model, text)


def test_window_stays_bounded():
    codec, window, most = sp.Codec(toy("unigram")), sp._Window(), 0
    for _ in codec._decode(window, "▁" + "abab▁ba" * 2000, 0):
        most = max(most, len(window.arcs))
    assert most <= 4 * codec.longest


def message(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value])
    return bytes([number << 3 | 2, len(value)]) + value


@pytest.mark.parametrize("trainer, normaliser, kinds", [({3: 3}, {4: 0}, [1]), ({3: 1}, {4: 1}, [1]), ({3: 1}, {}, [1]), ({3: 1}, {4: 0, 3: 0}, [1]), ({3: 1}, {4: 0, 5: 0}, [1]), ({3: 1}, {4: 0, 2: b"x"}, [1]), ({3: 2}, {4: 0}, [1, 4])])
def test_models_that_need_more_are_rejected(trainer, normaliser, kinds):
    def file(trainer, normaliser, kinds):
        pieces = b"".join(message(1, message(1, f"p{k}".encode()) + message(3, kind)) for k, kind in enumerate(kinds))
        return pieces + message(2, b"".join(message(k, v) for k, v in trainer.items())) + message(3, b"".join(message(k, v) for k, v in normaliser.items()))

    with pytest.raises(ValueError):
        sp.parse_model(file(trainer, normaliser, kinds))
    assert sp.parse_model(file({3: 1}, {4: 0}, [1, 2])).kind == "unigram"


def test_unigram_takes_the_best_path_and_commits_early():
    model = toy("unigram")
    codec = sp.Codec(model)
    rng = random.Random(5)

    def best(text):
        score = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            found = [(score[s][0] + model.scores[i], [*score[s][1], i]) for s in range(end) if s in score and (i := model.ids.get(text[s:end])) is not None]
            if found:
                score[end] = max(found, key=lambda x: x[0])
        return score[len(text)][0]

    for _ in range(100):
        text = "▁" + "".join(rng.choices("ab▁", k=rng.randint(1, 40)))
        ids = [i for run in codec.viterbi(text) for i in run]
        assert sum(model.scores[i] for i in ids) == pytest.approx(best(text)) and "".join(model.pieces[i] for i in ids) == text
    assert len([run for run in codec.viterbi("▁" + "ab" * 200) if run]) > 5


def test_unknown_characters_and_empty_texts():
    codec = sp.Codec(toy("unigram"))
    assert codec.encode("") == codec.encode(None) == [] and codec.encode("zab")[1] == len(codec.model.pieces) - 1


@needs_model
def test_documents(spark):
    docs = spark.createDataFrame([(1, "Hello  world\n x", "q"), (2, None, "q"), (3, "", "q"), (1, "Hello  world\n x", "q")], "doc_id long, text string, n_tokens string")
    full = sp.encode_documents(docs, sp.load_model()).collect()
    digests = sp.encode_digests(docs, sp.load_model()).collect()
    assert [r.decoded for r in full] == ["Hello  world\n x", "", "", "Hello  world\n x"] and all(r.lossless for r in digests)
    assert [len(r.token_ids) for r in full] == [r.n_tokens for r in digests]
    assert sp.encode_digests(docs.limit(0), sp.load_model()).count() == 0
