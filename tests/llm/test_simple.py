"""Quality rules, sharding, mixing and language identification against plain Python."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkwarden.llm import langid, mixing, rules, shards

from .fixtures import BLANK, SF, crc, empty, odd, odd_rows


def by_row(rows, key=lambda r: (r[0] is None, r[0] or 0)):
    return sorted((tuple(r) for r in rows), key=key)


def base(text):
    text = text or ""
    words = BLANK.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    twice = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice)


def test_rules(spark):
    rows = odd_rows() + [(2000, "a | b # c\nx\nx\nx", "en", "s")]
    got = rules.verdicts(odd(spark, rows)).collect()
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == Counter((r[0], *base(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert rules.verdicts(empty(spark)).collect() == []


def more(text):
    """The other measurements, by plain Python."""
    text = text or ""
    words = BLANK.findall(text)
    lines = [x.strip(" \t\n\x0b\x0c\r") for x in text.split("\n") if BLANK.search(x)]
    n = Counter(words)
    return {
        "n_lines": len(lines), "n_letters": sum(map(str.isalpha, text)), "n_capitals": sum(c.isalpha() and c.isupper() for c in text), "n_digits": sum(c.isdigit() and not c.isalpha() for c in text),
        "n_longest": max((len(w.encode()) for w in words), default=0), "n_letter_words": sum(any(map(str.isalpha, w)) for w in words), "n_top_word": max(n.values(), default=0), "n_distinct": len(n),
        "n_ended": sum(x[-1] in '.!?"…。' for x in lines),
    }


def test_all_measurements_and_verdicts(spark):
    strange = ["- a\n* b...\n• c…\nd.", "Click here http://x www.y {a} [b]", "\x01\x1f \ufffd \x85", "É1 ۳٤ x2 22 --", None, "", "a" * 40 + " b"]
    texts = [r[1] for r in odd_rows()] + strange + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    m = rules.measure(texts)
    assert set(m) == set(rules.MEASURES)
    for i, t in enumerate(texts):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        want = dict(zip(names, base(t))) | more(t)
        assert {k: int(v[i]) for k, v in m.items()} == want, repr(t)[:200]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    for r in rules.verdicts(odd(spark, rows)).collect():
        want = dict(zip(names, base(texts[r.doc_id]))) | more(texts[r.doc_id])
        bits = sum(1 << k for k, rule in enumerate(rules.RULES.values()) if eval(rule, {}, want))
        assert r.fail_bits == bits
        assert r.kept == (not any(eval(rules.RULES[k], {}, want) for k in ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals")))


def test_every_rule_is_live(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = {r["rule"]: r["failed"] for r in rules.ablations(rules.ledger(docs), "strict").collect()}
    assert len(found) >= 15 and all(found.values()), found


def test_acronyms_in_other_scripts(spark):
    texts = [" ".join(f"{w}{chr(ord(w[0]) + i % 20)}" for i in range(300)) + " DNA" for w in ("слово", "λόγος", "كلمة", "字")]
    shout = "".join(chr(ord("А") + i % 30) + " " * (i % 5 == 4) for i in range(600))
    rows = [(i, t, "xx", "s") for i, t in enumerate([*texts, shout, "АБВ abc"])]
    m = rules.measure([t for _, t, *_ in rows])
    assert m["n_letters"].tolist() == [sum(map(str.isalpha, t)) for _, t, *_ in rows]
    assert m["n_capitals"].tolist() == [sum(map(str.isupper, t)) for _, t, *_ in rows]
    bit = 1 << list(rules.RULES).index("capitals")
    assert {r.doc_id: bool(r.fail_bits & bit) for r in rules.verdicts(odd(spark, rows)).collect()} == {0: False, 1: False, 2: False, 3: False, 4: True, 5: False}


def test_ablations(spark):
    rows = rules.ledger(odd(spark))
    found = {r["rule"]: r for r in rules.ablations(rows, "strict").collect()}
    bits = [r["fail_bits"] for r in rows.collect()]
    for k, name in enumerate(rules.RULES):
        rest = rules.mask("strict") & ~(1 << k)
        assert found[name]["failed"] == sum(b >> k & 1 for b in bits)
        assert found[name]["kept_without"] == sum(not b & rest for b in bits)
        assert found[name]["alone"] == sum(bool(b >> k & 1) and not b & rest for b in bits)


def test_shards(spark):
    docs = odd(spark)
    rows = shards.slots(shards.assign(docs, [1.0] * 24)).collect()
    assert len(rows) == docs.count()
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    again = {r["doc_id"]: r["shard"] for r in rows}
    assert all(r["shard"] == again[r["doc_id"]] for r in shards.assign(docs.repartition(7), [1.0] * 25).select("doc_id", "shard").collect() if r["shard"] != 24)
    assert shards.slots(shards.assign(empty(spark), [1.0] * 24)).collect() == []


def test_shard_weights(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "'' as text")
    n = Counter(r["shard"] for r in shards.assign(docs, [1.0, 3.0, 0.0]).collect())
    assert 0.70 < n[1] / 20000 < 0.80 and n[2] == 0


def test_sainte_lague():
    def plain(votes, seats):
        got = [0] * len(votes)
        for _ in range(seats):
            k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
            got[k] += 1
        return got

    rng = np.random.default_rng(0)
    for _ in range(50):
        votes = rng.integers(0, 100, rng.integers(1, 9)).tolist()
        seats = int(rng.integers(0, 60))
        if sum(votes):
            assert sum(mixing.sainte_lague(votes, seats)) == seats
            assert mixing.sainte_lague(votes, seats) == plain(votes, seats)


@pytest.mark.parametrize("which", ["odd", "real"])
def test_mix(spark, which):
    docs = odd(spark) if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs, block=16).collect()
    texts = docs.select("doc_id", "text", "source").collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(BLANK.findall(r.text or ""))) for r in texts)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r["taken"]
        target[r.source] = r["target"]
    assert target == pytest.approx(mixing.targets(size))
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in size:
        assert abs(taken[s] - target[s]) <= 48
    again = mixing.mix(docs.repartition(5), block=16).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mix_empty(spark):
    assert mixing.mix(empty(spark)).collect() == []
    assert [r["taken"] for r in mixing.mix(odd(spark, [(1, None, "en", None), (2, " ", "en", "a")])).collect()] == [0, 0]


def greedy(text, known):
    """Phrases of `text`, blocks apart, by plain substring search."""
    n = 0
    for at in range(0, len(text), langid.BLOCK):
        block, i = text[at : at + langid.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j <= len(block) and block[i:j] in known:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
    return n


def test_cross_parsing():
    texts = {"a": "the cat and the dog then the end of it", "b": "una ción que de los ado mente"}
    m = langid.Model(texts)
    tried = ["the dog", "ción que the", "xyz the", "zz", "the cat and " * 90, ""]
    got = m.phrases([m.symbols(t) for t in tried])
    for k, lang in enumerate(m.langs):
        for i, t in enumerate(tried):
            import re

            norm = re.sub(" +", " ", langid.clean(t)).lstrip()
            assert got[k, i] == greedy(norm, texts[lang]), (lang, t)


def test_automata_of_many_letters_stay_small():
    """3,000 letters beside a language of 26: some megabytes, and parsing as by plain search."""
    rng = np.random.default_rng(0)
    many = "".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 3000, 32_000))
    few = "".join("abcdefghij "[int(k)] for k in rng.integers(0, 11, 32_000)).replace("  ", " ").strip()
    m = langid.Model({"few": few, "many": many})
    assert (m.base.nbytes + m.owner.nbytes + m.to.nbytes) / 2 < 4e6
    tried = [many[100:900] + many[50:99], few[7:700] + many[:5], "".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 3500, 600))]
    got = m.phrases([m.symbols(t) for t in tried])
    for i, t in enumerate(tried):
        assert [greedy(t, few), greedy(t, many)] == got[:, i].tolist()


def test_sample_comes_from_anywhere_in_a_text(spark):
    """A language whose texts begin with another's words is still learnt from what follows."""
    rows = [(i, "the and of thing " * 300 + "ción que ñez los mente " * 3000, "es", "s") for i in range(20)]
    rows += [(100 + i, "the and of thing onth erea " * 400, "en", "s") for i in range(20)]
    rows += [(1000 + i, "ción que ñez los mente " * 20, None, "s") for i in range(3)]
    lang = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd(spark, rows)).collect()}
    assert {lang[1000 + i] for i in range(3)} == {"es"}


def test_tie_goes_to_the_first_by_code_point():
    m = langid.Model({"b": "one two three", "a": "one two three"})
    assert m.predict(["one two", None, "12"])[0] == ["a", "und", "und"]


def test_languages(spark):
    rows = langid.identify(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert r["held_out"] == (crc(r["doc_id"], 4) == 2)
        assert 0 <= r["score"] <= 1
    lang = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [lang[k] for k in (1000, 1001, 1002, 1003)] == ["und"] * 4
    right = [lang[i] == ("en" if i % 3 else "es") for i in range(60) if i != 6]
    assert sum(right) >= 57
    assert langid.identify(empty(spark)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd(spark, [(1, "text", None, "a")])).collect()} == {"und"}


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in both) > 0.95 * len(both)


def test_rendezvous_by_hand(spark):
    """Each shard's draw in Python: the same shards, with weights and with one more."""
    import math

    import xxhash

    def draw(key, shard, weight):
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        h = xxhash.xxh64_intdigest((shards.SEED + shard).to_bytes(4, "little"), h)
        return -weight / math.log(((h >> 12) + 0.5) / 2**52)

    weights = [1.0, 2.5, 0.0, 1.0, 0.5]
    for r in shards.assign(odd(spark), weights, 2.0).collect():
        key = "null" if r.doc_id is None else str(r.doc_id)
        best = lambda ws: max((k for k, w in enumerate(ws) if w), key=lambda k: (draw(key, k, ws[k]), k))  # noqa: B023, E731
        assert (r.shard, r.grown_shard) == (best(weights), best([*weights, 2.0]))
    assert ((2**52 - 1) + 0.5) / 2**52 < 1  # the largest draw stays below 1


def test_language_of_copies(spark):
    """A language of which all rows are copies is learnt, whatever their hash; and so is one beside many others."""
    rng = np.random.default_rng(1)
    en = [" ".join(rng.choice("the and of thing onth erea tion ing thha".split(), 300)) for _ in range(30)]
    rows = [(4, "zażółć gęślą jaźń " * 170, "pl")] * 400 + [(i, t, "en") for i, t in enumerate(en)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for sample in (langid.SAMPLE_CHARS, 3000):
        model = langid.fit(df, sample_chars=sample)
        assert set(model.langs) == {"en", "pl"} and model.predict(["gęślą jaźń zażółć", "the thing and"])[0] == ["pl", "en"]


def test_small_counts_bytes(spark, monkeypatch):
    from sparkwarden.llm import common

    df = spark.createDataFrame([("x" * 1000,)] * 50, "id string")
    assert "broadcast" in common.small(df)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 40_000)
    assert "broadcast" not in common.small(df)._jdf.queryExecution().analyzed().toString()
    assert common.small(df.limit(0)).count() == 0


def test_slots_of_any_number_of_windows(spark):
    rows = shards.assign(odd(spark), [1.0] * 3).select("doc_id", "size", "text_crc32", "shard")
    for buckets in (None, 1, 5, 1000):
        got = defaultdict(list)
        for r in shards.slots(rows, buckets).collect():
            got[r.shard].append(r.slot)
        assert sum(map(len, got.values())) == len(odd_rows()) and all(sorted(v) == list(range(len(v))) for v in got.values())
