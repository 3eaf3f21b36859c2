"""Packing, the id store and the language model."""

import functools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkwarden.llm import gru, packing, store, tokens
from sparkwarden.llm.common import Scratch, coded_words, tokenizer_path, word_lists

from .fixtures import BLANK, SF, crc, empty, odd, odd_rows


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def plain_ids(name, text, end):
    return [*library(name).encode(text or "", add_special_tokens=False).ids, end]


ODD_TEXTS = ["", " ", "a  b", "a   b\n\nc  \n d", "<|endoftext|> hi", "hi<|startoftext|>there\n", "\n", "tab\tq\r\n z", "a ̈b", "ΑΣ ΣΑΣ x", "don't 'll 's it''s", "  lead", "trail  ", "1234 56 7", "a\x1cb \x1c c", "é éx ́", "\n a", "a\n", "\nb c", None]


@pytest.mark.parametrize("name", [packing.TOKENIZER, store.TOKENIZER])
def test_encoder(spark, name):
    texts = ODD_TEXTS + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    e = tokens.Encoder(tokenizer_path(name), cache=3 << 20)  # so small that it is cut down
    for _ in range(2):  # the second time from the cache
        for at in range(0, len(texts), 50):
            ids, n = e.encode(texts[at : at + 50])
            for t, got in zip(texts[at : at + 50], np.split(ids, np.cumsum(n)[:-1])):
                assert got.tolist() == plain_ids(name, t, 0)[:-1]


FINE_TEXTS = [
    "Word word. WORD, (word) word's WORD'S word''s 'word' rock'n'roll don't!! x.y.z a1.b2 $Word$ _word_ word-Word ...", "T\u0308 T\u0308. t\u0308 H\u0331, h\u0331 E\u0301. e\u0301 W\u030a A\u030a", "İ I\u0307 ıI. ΑΣ ΑΣ. ß ẞ ŉ ǅ ǆ ﬁ ª º ⅷ Ⅷ ٣ ² ½ K Å",
    "ab<|startoftext|>cd", "AB<|STARTOFTEXT|>cd Ab", "<|startoftext", "|>", "x <|endoftext|>. y", "a\u0338 <\u0338 .\u0338 b.\u0338", "你好 你好. ถ้า हिन्दी \U0001e900\U0001e922 \U00032000 \ua7cb\ua7da \U00010d4a", "a\u2028B\u00a0c.\u3000D", "it'S 'Tis 'T 'll. L'LL", "e\u200dE .E\u200d", None, "Ab", "\u0301b"
]


def test_finer_chunks():
    """Words apart from punctuation and in lower case: the library's ids, each word learnt once. All texts at once, and each alone."""
    e, want = tokens.Encoder(tokenizer_path(store.TOKENIZER)), [plain_ids(store.TOKENIZER, t, 0)[:-1] for t in FINE_TEXTS]
    for at in (range(0, 1), range(len(FINE_TEXTS)), *([i] for i in range(len(FINE_TEXTS))), [2, 1, 9]):
        ids, n = e.encode([FINE_TEXTS[i] for i in at])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [want[i] for i in at]
    e = tokens.Encoder(tokenizer_path(store.TOKENIZER))
    e.encode(["Word word. WORD!! word, word!! Word."])
    assert e.table.n == 4  # word . !! ,
    learnt = []
    e._marked = lambda text, blank, real=e._marked: (learnt.extend(text), real(text, blank))[1]
    ids, n = e.encode(["un known İi words \u01c5 lower"])  # İ becomes a letter and a mark, so its words are told apart by marks
    assert ids.tolist() == plain_ids(store.TOKENIZER, "un known İi words \u01c5 lower", 0)[:-1] and "İi" in learnt and "words" not in learnt


@pytest.mark.parametrize("name", [packing.TOKENIZER, store.TOKENIZER])
def test_long_chunks_and_texts(name):
    """Chunks beyond SHORT, chunks that differ in the middle only, and a text of more than two slices."""
    a = ["x" * n + "y" * m for n in (10, 63, 64, 65, 200) for m in (0, 1, 63, 64)] + ["ab" * 40, "ba" * 40]
    texts = [" ".join(a), " ".join(a[::-1]), "\n".join(a), "word " * 500_000, "word " * 500_000 + "!"]
    e = tokens.Encoder(tokenizer_path(name))
    ids, n = e.encode(texts)
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert got.tolist() == plain_ids(name, t, 0)[:-1]


def test_a_full_table_stays_within_its_bytes():
    """Three times as many chunks as CACHE_BYTES hold; what they take and what the process grows by."""
    import subprocess
    import sys

    code = """if 1:
    import resource, numpy as np, pyarrow as pa
    from sparkwarden.llm import packing, tokens
    e = tokens.encoder(packing.TOKENIZER)
    e.encode(["begin"])
    before, seen, most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0, 0
    for k in range(200):
        e.encode([" ".join(f"w{i:x}" for i in range(k * 12_000 + a, k * 12_000 + a + 200)) for a in range(0, 12_000, 200)])
        most = max(most, e.nbytes())
    print(most, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024)"""
    most, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=tokens.__file__.split("/sparkwarden/")[0]).stdout.split())
    assert most < 1.6 * tokens.CACHE_BYTES and grown < 3 * tokens.CACHE_BYTES


def test_table():
    rng = np.random.default_rng(0)
    h = np.unique(np.concatenate([rng.integers(1, 1 << 63, 50_000, dtype=np.uint64), np.arange(1, 2000, dtype=np.uint64)]))
    rng.shuffle(h)
    t = tokens.Table(4)
    for part in np.array_split(h, 50):
        assert (t.find(part) == -1).all()
        t.add(part)
    assert (t.find(h) == np.arange(len(h))).all() and (t.find(h + np.uint64(1 << 63)) == -1).all()


def test_best_fill():
    rng = np.random.default_rng(1)
    for _ in range(100):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, 4)}
        room = int(rng.integers(1, 60))
        sums = {0}
        for k, n in counts.items():
            sums = {s + i * k for s in sums for i in range(n + 1)}
        fill = packing.best_fill(counts, room)
        assert sum(k * n for k, n in fill.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in fill.items())


def check_pack(rows, texts):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"], r["doc_tokens"]].append(r)
        seqs[r["sequence_id"]].append(r)
    padding = 0
    for v in seqs.values():
        v.sort(key=lambda r: r["offset"])
        at = 0
        for r in v:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    want = Counter()
    for i, t in texts:
        ids = np.array(plain_ids(packing.TOKENIZER, t, 1), "<u4")
        want[i, len(ids)] += len(ids)
        pieces = [r for r in docs[i, len(ids)]]
        assert any(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
    assert Counter({k: sum(r["length"] for r in v) for k, v in docs.items()}) == want


def test_pack(spark):
    check_pack(packing.pack_documents(odd(spark)).collect(), [(r[0], r[1]) for r in odd_rows()])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs, ids=True).collect()
    check_pack(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.pack_documents(empty(spark)).collect() == []


def test_crc_join():
    c = store.Crc()
    a, b = b"some bytes", bytes(range(256)) * 3
    assert c.join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert c.join(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 40000, 20000).astype(np.uint32)
    both = np.concatenate([a[:7], a])
    at, n = store.cuts(np.concatenate([both, a]), np.array([len(both), len(a)]))
    x, y = set((at[: n[0]] - 7).tolist()), set((at[n[0] :] - len(both)).tolist())
    assert len(x & y) > 0.8 * len(y)
    assert np.diff(np.append(at, len(both) + len(a))).max() <= store.MOST


def test_store(spark):
    for docs, texts in ((odd(spark), [(r[0], r[1]) for r in odd_rows()]), (d := spark.read.parquet(f"{SF}/documents.parquet"), [(r["doc_id"], r["text"]) for r in d.collect()])):
        path = Scratch(spark, "test").path("store")
        root = store.write(docs, path)
        assert len(root) == 64
        rows = store.read(spark, path).collect()
        assert all(r["verified"] for r in rows)
        want = Counter()
        for i, t in texts:
            ids = np.array(plain_ids(store.TOKENIZER, t, 2), "<u4")
            want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
        rows.sort(key=lambda r: r["start"])
        at = 0
        for r in rows:
            assert r["start"] == at
            at += r["n_tokens"]
        order = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
        assert order == sorted(order)
        got = Counter(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in store.load(spark, path).collect())
        assert got == Counter(k[2] for k in want.elements())
    path = Scratch(spark, "test").path("store")
    assert store.write(empty(spark), path) == "" and store.read(spark, path).collect() == []


def test_store_finds_damage(spark):
    path = Scratch(spark, "test").path("store")
    store.write(odd(spark), path)
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    hurt = [(r["digest"], r["n"], bytearray(r["ids"][:-1] + b"\xff") if k == 0 else r["ids"]) for k, r in enumerate(chunks)]
    spark.createDataFrame(hurt, "digest binary, n int, ids binary").write.mode("overwrite").parquet(f"{path}/chunks")
    assert not all(r["verified"] for r in store.read(spark, path).collect())


def test_gradients():
    rng = np.random.default_rng(0)
    m = gru.Gru(np.array([50, 20, 10, 5, 5, 4, 3, 3, 2, 1.0]), np.array([5.0, 4, 3]), hidden=5, embed=4)
    m.p = {k: v.astype(np.float64) + 0.05 * rng.standard_normal(v.shape) for k, v in m.p.items()}
    h, tok = rng.standard_normal((20, 5)), rng.integers(0, 13, 20)
    out, dh, g = m.outputs(h, tok, True)
    for name, at in (("C", (2, 3)), ("cb", (1,)), ("O", (1, 4)), ("ob", (8,))):
        old = m.p[name][at]
        m.p[name][at] = old + 1e-5
        up = m.outputs(h, tok).sum()
        m.p[name][at] = old
        assert (out.sum() - up) / 1e-5 == pytest.approx(g[name][at], abs=1e-3)
    h2 = h.copy()
    h2[3, 2] += 1e-5
    assert (out.sum() - m.outputs(h2, tok).sum()) / 1e-5 == pytest.approx(dh[3, 2], abs=1e-3)


def test_steps_of_adam_by_blocks(monkeypatch):
    """The weights are the same to the bit however many parameters a step goes through at once."""
    tok, new, found = np.random.default_rng(0).integers(0, 13, 400).astype(np.int16), np.arange(400) % 50 == 0, []
    for block in (7, 1 << 14):
        monkeypatch.setattr(gru, "ADAM_BLOCK", block)
        m = gru.Gru(np.arange(20, 10, -1.0), np.array([5.0, 4, 3]), hidden=5, embed=4)
        m.train(tok, new, epochs=2, lanes=4, steps=8)
        found.append(m.p)
    assert all((v == found[1][k]).all() for k, v in found[0].items())
    assert (gru.places(np.array([2, 0, 1])) == [1, 2, 0]).all()


def test_probabilities_sum_to_one():
    m = gru.Gru(np.array([50, 20, 10, 5, 5, 4, 3, 3, 2, 1.0]), np.array([5.0, 4, 3]), hidden=5, embed=4)
    h = np.random.default_rng(0).standard_normal((1, 5)).astype(np.float32)
    assert np.exp(m.outputs(np.repeat(h, 13, 0), np.arange(13))).sum() == pytest.approx(1, abs=1e-5)


def test_logits_beyond_exp():
    """Sums that leave the range of floats are taken again with the largest logit away."""
    m = gru.Gru(np.array([50, 20, 10, 5, 5, 4, 3, 3, 2, 1.0]), np.array([5.0, 4, 3]), hidden=5, embed=4)
    h, tok = np.random.default_rng(0).standard_normal((26, 5)).astype(np.float32), np.tile(np.arange(13), 2)
    want, want_dh, _ = m.outputs(h, tok, True)
    for shift in (200, -200):
        m.p["cb"] += np.float32(shift)
        m.p["ob"] += np.float32(shift)
        got, dh, _ = m.outputs(h, tok, True)
        assert got == pytest.approx(want, abs=1e-3) and dh == pytest.approx(want_dh, abs=1e-3)
        m.p["cb"] -= np.float32(shift)
        m.p["ob"] -= np.float32(shift)


def test_mean_of_copies():
    w = [np.full(4, v, np.float32) for v in (1, 2, 6)]
    table = lambda rows: pa.table({"heap": pa.array([h for h, *_ in rows], pa.int32()), "n": [n for _, n, _ in rows], "weights": pa.array([x.tobytes() for *_, x in rows], pa.binary())})
    whole = table([(0, 10, w[0]), (1, 20, w[1]), (0, 30, w[2])])
    parts = pa.concat_tables([gru.mean_copy(table([(0, 10, w[0]), (0, 30, w[2])])), gru.mean_copy(table([(1, 20, w[1])]))])
    for t in (gru.mean_copy(whole), gru.mean_copy(parts)):
        assert t.column("n").to_pylist() == [60] and np.frombuffer(t.column("weights")[0].as_py(), np.float32) == pytest.approx((10 + 40 + 180) / 60)
    assert gru.mean_copy(whole.slice(0, 0)).num_rows == 0


@pytest.mark.parametrize("heaps", [1, 64])
def test_copies_meet_in_heaps(spark, monkeypatch, heaps):
    monkeypatch.setattr(gru, "TASKS", heaps)
    docs = odd(spark)
    assert gru.score(docs, train_tokens=500).count() == docs.count()


def test_score_needs_no_neighbours():
    """A text's score is the same alone and among others: state is carried through it and from nowhere else."""
    rng = np.random.default_rng(0)
    m = gru.Gru(np.arange(20, 0, -1.0), np.array([5.0, 4, 3]), hidden=6, embed=4)
    texts = [rng.integers(0, 23, n) for n in (1, 700, 3, 90, 5000, 64, 65)]
    both = m.score(np.concatenate(texts), np.array(list(map(len, texts))))
    for t, s in zip(texts, both):
        assert m.score(t, np.array([len(t)]))[0] == pytest.approx(s, rel=1e-4)


def test_training_learns():
    x = np.tile(np.array([1, 2, 3, 4, 5, 0]), 4000)
    m = gru.Gru(np.full(6, 4000.0), np.zeros(2), hidden=16, embed=8)
    before = m.score(x[:600], np.full(100, 6)).sum()
    starts = np.zeros(len(x), bool)
    starts[::6] = True
    m.train(x, starts, epochs=6, lanes=16)
    assert m.score(x[:600], np.full(100, 6)).sum() > 0.3 * before


def test_coded_words():
    """Words by Arrow are those by Python: each distinct one once, an empty word at each text's end, odd blanks and slices of a column."""
    texts = [*ODD_TEXTS, "  a  B\tc ", "A\x0bÉ\x0cß\x85d\xa0Z\u2003q", "a\x1cb\x1d\x1e\x1f c", " \r\n", "x"]
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.string()).slice(3, 9), pa.array([None], pa.string()), pa.array(texts, pa.large_string())):
        words, code, counts = coded_words(column)
        words = words.to_pylist()
        assert len(words) == len(set(words))
        assert [[words[i] for i in x] for x in np.split(code, np.cumsum(counts)[:-1])] == [[*x, b""] for x in word_lists(column.to_pylist(), lower=True)]


@pytest.mark.parametrize("held", [1, 50, 600_000])
def test_counts_sent_in_parts(spark, monkeypatch, held):
    """Counts are whole however often a task merges and sends what it holds."""
    monkeypatch.setattr(gru, "HELD_WORDS", held)
    monkeypatch.setattr(gru, "BATCH_BYTES", 2000)
    want = Counter(w for x in word_lists([r[1] for r in odd_rows()], lower=True) for w in [*x, b""])
    assert {bytes(r["word"]): r["c"] for r in gru.count_words(odd(spark)).collect()} == want


@pytest.mark.parametrize("lookup", [40, 300_000])
def test_scores(spark, lookup):
    docs = odd(spark)
    rows = gru.score(docs, lookup=lookup).collect()
    texts = odd_rows()
    lower = lambda t: [w.translate({k: k + 32 for k in range(65, 91)}) for w in BLANK.findall(t or "")] + [None]
    c = Counter(w for i, t, *_ in texts if crc(i, 7) != 2 for w in lower(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in texts:
        w = lower(t)
        want[i, crc(i, 7) == 2, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in rows) == want
    assert {r["train_tokens"] for r in rows} == {n}
    assert all(r["score"] < 0 for r in rows)
    assert gru.score(empty(spark)).collect() == []


def test_training_takes_whole_texts_of_the_whole_corpus(spark, monkeypatch):
    """Every token of every training text is gone through, far beyond the start; ends come only where texts end."""
    rows = [(i, "aa bb cc " * (1200 if i < 6 else 3), "en", "s") for i in range(300)] + [(900, None, "en", "s")]
    docs, seen = odd(spark, rows), []
    real = gru.train
    monkeypatch.setattr(gru, "train", lambda *a: seen.append(real(*a)))
    scores = gru.score(docs, train_tokens=500).collect()
    want = sum(len((t or "").split()) + 1 for i, t, *_ in rows if crc(i, 7) != 2)
    assert seen == [want] and {r["train_tokens"] for r in scores} == {want}
    sizes = np.array([1, 3601, 10, 700, 10])
    x, new, length = gru.lanes_of(np.arange(sizes.sum()), sizes, 2)
    got = np.concatenate([x[k, :n] for k, n in enumerate(length)])
    assert sorted(got) == list(range(sizes.sum()))
    assert sorted(x[new]) == (np.cumsum(sizes) - sizes).tolist()
    assert all((np.diff(x[k, :n]) == 1)[~new[k, 1:n]].all() for k, n in enumerate(length))


def test_model_beats_counts(spark):
    rows = gru.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows)
