"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A text is parsed against each automaton
into the longest phrases that occur in the language's text; phrases x log2(size of that text), divided by the
text's length, estimate the cross-entropy in bits a letter, and the language needing fewest wins.

Texts are lower-cased, letters are kept and all between them counts as one blank. Parsing starts anew
every BLOCK symbols, so that long texts are parsed in blocks side by side (one phrase more a block at most).

The labelled sample, which bounds the model and is all that is learnt from: for each language texts in the order of a hash
of id and text (equal rows count once) until SAMPLE_CHARS symbols are reached; of a text longer than SPAN characters a
window of SPAN from a place that its hash chooses. The edges of an automaton are kept in rows that overlap in one
array, so a language takes some 30 bytes a symbol of its text, whatever the number of letters.

Null texts and texts without a letter are `und` with score 0. A tie goes to the language first by code point. Null and repeated
ids are rows like others; very long texts are parsed whole; extra columns are left out (select() keeps them). With
no labelled text at all everything is `und`; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import annotate, crc_bucket, free_prefix, map_slices, names, plain, worker_cache

BLOCK = 512
#: Symbols of a language's text, and characters that one text gives at most.
SAMPLE_CHARS, SPAN = 64_000, 4_000
SEED = 5


def clean(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton of `text`: for each state symbol -> state. State 0 is the start; nothing leads there."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return go


def overlapped(go: list[dict[int, int]], letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of edges laid over one another in one array: the edge of state s by symbol c is at base[s] + c, if owner there is s."""
    base, owner, to, taken, free = [0] * len(go), [-1] * letters, [0] * letters, bytearray(letters), 0
    for s in sorted(range(len(go)), key=lambda k: -len(go[k])):
        edges = go[s]
        if not edges:
            continue
        syms, tries = sorted(edges), 0
        while free < len(owner) and owner[free] >= 0:
            free += 1
        if syms[-1] - syms[0] > 256:  # few edges far apart: gaps are looked for everywhere
            full = np.frombuffer(bytes(taken), np.uint8)
            b = np.flatnonzero(full[syms[0] :] == 0)
            for c in syms[1:]:
                b = b[(b + c >= len(full)) | (full[np.minimum(b + c, len(full) - 1)] == 0)]
            b = int(b[0]) if len(b) else len(full)
        else:
            at = max(free, syms[0])
            while any(at - syms[0] + c < len(owner) and owner[at - syms[0] + c] >= 0 for c in syms):
                at, tries = at + 1, tries + 1
                if tries == 64:  # else the row goes to the end
                    at = max(at, len(owner))
            b = at - syms[0]
        if b + syms[-1] >= len(owner):
            more = b + syms[-1] + 1 - len(owner)
            owner += [-1] * more
            to += [0] * more
            taken += bytes(more)
        base[s] = b
        for c in syms:
            owner[b + c], to[b + c], taken[b + c] = s, edges[c], 1
    pad = max(base) + letters - len(owner)
    return np.array(base, np.int32), np.array(owner + [-1] * pad, np.int32), np.array(to + [0] * pad, np.int32)


class Model:
    """Automata of all languages over one alphabet; symbol 0 is the blank, the last one any unknown letter."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        letters = sorted(set("".join(texts.values())) - {" "})
        self.alphabet = [" ", *letters]
        self.letters = len(self.alphabet) + 1
        code = {c: k for k, c in enumerate(self.alphabet)}
        tables = [overlapped(automaton(np.array([code[c] for c in texts[x]], np.int64)), self.letters) for x in self.langs]
        self.bits = np.array([np.log2(max(2, len(texts[x]))) for x in self.langs])
        shift = lambda k: np.cumsum([0, *(len(t[k]) for t in tables[:-1])]) if tables else np.zeros(0, np.int64)
        join = lambda k: np.concatenate([t[k] for t in tables]) if tables else np.zeros(0, np.int32)
        self.state0, self.slot0 = shift(0), shift(1)
        self.base, self.owner, self.to = join(0), join(1), join(2)

    def step(self, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """The next state of each language (row) and text (column); 0 if there is none."""
        at = self.base[self.state0[:, None] + state] + self.slot0[:, None] + sym
        return np.where(self.owner[at] == state, self.to[at], 0)

    def symbols(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = is_letter()[code]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one blank after a run of letters
        code = code[keep]
        return self.codes()[np.where(letter[keep], code, 32)]

    def codes(self) -> np.ndarray:
        if not hasattr(self, "_codes"):
            self._codes = np.full(0x110000, self.letters - 1, np.int32)
            for k, c in enumerate(self.alphabet):
                self._codes[ord(c)] = k
        return self._codes

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_codes"}

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text needs in each language: [language, text]."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        n_blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        begin = (np.cumsum(size) - size)[owner] + nth * BLOCK
        length = np.minimum(BLOCK, size[owner] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        stream = np.concatenate(texts).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        L, B = len(self.langs), len(owner)
        state = np.zeros((L, B), np.int64)
        count = np.zeros((L, B), np.int32)
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")  # blocks longer than t
        start = self.step(np.zeros((L, 1), np.int64), np.arange(self.letters)[None, :])
        for t, n in enumerate(live.tolist()):
            sym = stream[begin[:n] + t]
            s = state[:, :n]
            nxt = self.step(s, sym[None, :])
            fail = nxt == 0
            again = start[:, sym]
            count[:, :n] += fail & (s != 0)
            count[:, :n] += fail & (again == 0)
            state[:, :n] = np.where(fail, again, nxt)
        count += state != 0
        out = np.zeros((L, len(texts)), np.int64)
        for k in range(L):
            out[k] = np.bincount(owner, count[k], len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a symbol of each text."""
        sym = [self.symbols(t) if t else np.zeros(0, np.int32) for t in texts]
        size = np.fromiter(map(len, sym), np.int64, len(sym))
        if not self.langs:
            return ["und"] * len(sym), np.zeros(len(sym)), np.zeros(len(sym))
        bits = self.phrases(sym) * self.bits[:, None] / np.maximum(size, 1)
        best = bits.argmin(0)
        least = bits.min(0)
        score = 1 / np.exp2(-(bits - least) * np.minimum(size, 64)).sum(0)
        none = size == 0
        return [self.langs[k] if not z else "und" for k, z in zip(best, none)], np.where(none, 0.0, score), np.where(none, 0.0, least)


@worker_cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def fit(docs: DataFrame, held_out: int = 2, of: int = 4, sample_chars: int = SAMPLE_CHARS, span: int = SPAN) -> Model:
    """Learns from labelled texts outside the held-out part. Two scans: characters of different rows by language, then the few rows whose
    hash is low enough for the sample; the lowest of a language always is."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = plain(docs, doc_id=kind, text="string", lang="string").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_bucket(of) != held_out))
    size = F.least(F.length("text"), F.lit(span))
    h = F.xxhash64("doc_id", "text", F.lit(SEED))
    every = rows.select("lang", h.alias("h"), size.alias("size")).where("size > 0").distinct()  # equal rows count once
    found = every.groupBy("lang").agg(F.sum("size").alias("n"), F.min_by("h", F.shiftrightunsigned("h", 11)).alias("first")).collect()
    have, first = {r["lang"]: r["n"] for r in found}, {r["lang"]: r["first"] for r in found}
    if not have:
        return Model({})
    u = F.shiftrightunsigned(h, 11) / float(1 << 53)
    share = F.create_map(*(F.lit(x) for k, n in sorted(have.items()) for x in (k, min(1.0, 4 * (sample_chars + span) / max(n, 1)))))
    begin = F.pmod(h, F.length("text") - size + 1).cast("int") + 1
    lowest = h == F.element_at(F.create_map(*(F.lit(x) for k in sorted(first) for x in (k, first[k]))), F.col("lang"))
    few = rows.where((u < F.element_at(share, F.col("lang"))) | lowest).select("lang", h.alias("h"), F.substring("text", begin, F.lit(span)).alias("text")).distinct()
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h", "text").rowsBetween(Window.unboundedPreceding, -1))
    few = few.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 2 * sample_chars)
    taken: dict[str, list[tuple[int, str]]] = {}
    for r in few.collect():  # 2 * sample_chars + span characters a language at most: blanks and signs go in clean()
        taken.setdefault(r["lang"], []).append((r["before"], r["text"]))
    texts = {k: re.sub(" +", " ", " ".join(clean(t) for _, t in sorted(v)))[:sample_chars].strip() for k, v in taken.items()}
    return Model({k: v for k, v in texts.items() if v})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits (a symbol)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, bits = shared.value.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names=["doc_id", "lang_pred", "score", "bits"])

    return map_slices(plain(docs, doc_id=kind, text="string"), run, f"doc_id {kind}, lang_pred string, score double, bits double")


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits; learns from the rows that aren't held out."""
    out = predict(docs, fit(docs, **bounds))
    return out.select("doc_id", (crc_bucket(4) == 2).alias("held_out"), "lang_pred", "score", "bits")


def select(docs: DataFrame, least: float = 0.5, **bounds: int) -> DataFrame:
    """The rows of which one language is found with a score of `least` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **bounds))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        lang, score, _ = shared.value.predict(batch.column("text").to_pylist())
        return [pa.array(lang, pa.string()), pa.array(score)]

    p = free_prefix(docs, "_l_")
    return annotate(docs, run, f"{p}lang string, {p}score double").where((F.col(f"{p}lang") != "und") & (F.col(f"{p}score") >= least)).select(*names(docs))
