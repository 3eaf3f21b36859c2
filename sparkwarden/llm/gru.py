"""Document log-likelihood by a gated recurrent language model.

Words are counted over the whole training part of the corpus. The most frequent ones are the model's own words
(HEAD of them, the end of a text among them), put into classes of about equal frequency; all other words, seen or not,
fall into one of TAILS spelling classes, which together are one class more. The model, a GRU, gives P(class | all before) by one
softmax and P(word or spelling class | class, all before) by another; inside a spelling class a word has (c + 1) / (N_k + V_k + 1),
c its count, N_k and V_k the class's tokens and distinct words. So all words, and one more unseen word in each
spelling class, sum up to 1. Training is truncated backpropagation through time with Adam in numpy; biases start from
the whole corpus's counts. One task makes a start of about TRAIN_TOKENS tokens, which it sees EPOCHS times; then all training
texts are gone through once, whole, in ROUNDS rounds: each task trains a copy of the model on its part of a round's
texts, and the copies' mean, weighted by tokens, begins the next round. So weights depend a little on how the table is split.
Training and scoring carry the state across windows from a text's first word to its end.

Texts are looked up once: their inputs, 16 bits a word, are staged, and training and scoring read these.
Counts of the LOOKUP most frequent words are broadcast, a fixed bound; the counts of all others meet the documents
that use them in a shuffle join, so vocabularies of any size give whole results.

Null texts are empty: the end alone. With no training text every count is 0 and the model is untrained. Repeated rows and
ids are scored each for itself; a null id counts as the empty text where rows are dealt out. A text of any length is scored whole, its state carried
from window to window. Extra columns of any name are left out; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Scratch, coded_words, crc_bucket, map_batches, plain, slices

HEAD, CLASSES, TAILS = 3072, 48, 64
LOOKUP = 300_000
HIDDEN, EMBED = 32, 16
TRAIN_TOKENS, EPOCHS, LANES, STEPS, RATE = 250_000, 5, 64, 32, 6e-3
#: Rounds of the pass over all training texts, tasks of a round (or the cluster's cores, if more), tokens that are worth a task, tokens that a
#: task lays out at once (far more than the longest texts, as these would run on in lanes of their own), its lanes, and the rate.
ROUNDS, TASKS, WORTH, LAID, PASS_LANES, PASS_RATE = 4, 64, 1 << 21, 1 << 22, 128, 2e-3
#: Tokens scored together in a task, and texts side by side.
BUFFER, SIDE, SPAN = 1 << 22, 256, 64
#: Tokens whose softmax over the classes is taken at once.
BLOCK = 512
#: Parameters that a step of Adam goes through at once: so many of all its vectors as stay in the cache.
ADAM_BLOCK = 1 << 14
#: Rows of words and counts that a task merges and holds, about.
HELD_WORDS = 600_000
LN10 = float(np.log(10))
END = b""


def places(order: np.ndarray) -> np.ndarray:
    """The inverse of a permutation."""
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return out


def spelling(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


class Gru:
    """Parameters, training and scoring. Tokens are inputs 0 to head - 1 (own words) and head + k (spelling class k)."""

    def __init__(self, head_counts: np.ndarray, tail_counts: np.ndarray, hidden: int = HIDDEN, embed: int = EMBED, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.head, self.hidden = len(head_counts), hidden
        mass = np.cumsum(head_counts + 1.0)
        cls = np.minimum((CLASSES * (mass - (head_counts + 1.0) / 2) / mass[-1]).astype(np.int64), CLASSES - 1)
        _, cls = np.unique(cls, return_inverse=True)
        # Spelling classes are members of one more class.
        self.cls = np.concatenate([cls, np.full(len(tail_counts), cls.max() + 1)])
        self.n_classes = int(self.cls.max()) + 1
        self.first = np.searchsorted(self.cls, np.arange(self.n_classes + 1))  # words come by frequency, so classes are runs
        count = np.concatenate([head_counts, tail_counts]) + 1.0
        total = np.bincount(self.cls, count)
        f = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
        self.p = {
            "E": f(self.head + len(tail_counts), embed, by=0.1), "W": f(embed, 3 * hidden, by=embed**-0.5), "b": np.zeros(3 * hidden, np.float32), "U": f(hidden, 3 * hidden, by=hidden**-0.5),
            "C": f(hidden, len(total), by=0.01).T.copy(), "cb": np.log(total / total.sum()).astype(np.float32), "O": f(hidden, len(count), by=0.01).T.copy(), "ob": np.log(count / total[self.cls]).astype(np.float32),
        }

    def outputs(self, h: np.ndarray, tok: np.ndarray, grad: bool = False):
        """ln P of each token (of a spelling class: of the class) after state h; with `grad` also gradients."""
        order = np.argsort(tok, kind="stable")
        x = np.ones((len(tok), h.shape[1] + 1), h.dtype)
        x[:, :-1] = h[order]
        out, *more = self.sorted_outputs(x, tok[order], grad)
        place = places(order)
        return (out[place], more[0][place], more[1]) if grad else out[place]

    def sorted_outputs(self, x: np.ndarray, tok: np.ndarray, grad: bool = False, careful: bool = False) -> tuple:
        """Like outputs, for ascending tokens; a row of x is the state and a one for the biases. Logits have a column for each token, so that
        sums over classes run along whole rows. `careful` takes the largest logit away before exp; without, sums that leave the safe
        range of floats are noticed and done again with it."""
        p, n, H = self.p, len(tok), x.shape[1] - 1
        C, O = np.concatenate([p["C"], p["cb"][:, None]], 1), np.concatenate([p["O"], p["ob"][:, None]], 1)
        out, sums = np.zeros(n, x.dtype), np.ones((2, n), x.dtype)
        gC, gO, dh = np.zeros_like(C), np.zeros_like(O), np.empty((n if grad else 0, H), x.dtype)

        def softmax(w: np.ndarray, at: np.ndarray, i: int, j: int, total: np.ndarray) -> np.ndarray:
            """Adds the true logits (flat places `at`) of tokens i to j to `out` and keeps the sums; with `grad` the logits' gradients."""
            y = w @ x[i:j].T
            if careful:
                y -= y.max(0)
            flat = y.reshape(-1)
            out[i:j] += flat[at]
            np.exp(y, out=y)
            np.add.reduce(y, 0, out=total[i:j])
            if grad:
                y *= 1 / total[i:j]
                flat[at] -= 1
            return y

        cls, rows = self.cls[tok], np.arange(n)  # words of a class are a run, so tokens of a class are together
        edge = np.searchsorted(tok, self.first)
        own = (tok - self.first[cls]) * np.diff(edge)[cls] + rows - edge[cls]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for i in range(0, n, BLOCK):  # so many as stay in the cache
                j = min(i + BLOCK, n)
                y = softmax(C, cls[i:j] * (j - i) + rows[: j - i], i, j, sums[0])
                if grad:
                    gC += y @ x[i:j]
                    np.matmul(y.T, p["C"], out=dh[i:j])
            for a, b, i, j in zip(self.first.tolist(), self.first[1:].tolist(), edge.tolist(), edge[1:].tolist()):
                if i == j or b - a == 1:
                    continue
                y = softmax(O[a:b], own[i:j], i, j, sums[1])
                if grad:
                    np.matmul(y, x[i:j], out=gO[a:b])
                    dh[i:j] += y.T @ p["O"][a:b]
        if not careful and n and not (sums.min() > 1e-30 and sums.max() < 1e30):
            return self.sorted_outputs(x, tok, grad, True)
        out -= np.log(sums[0]) + np.log(sums[1])
        return (out, dh, {"C": gC[:, :H], "cb": gC[:, H], "O": gO[:, :H], "ob": gO[:, H]}) if grad else (out,)

    def states(self, tok: np.ndarray, keep: np.ndarray, h: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Steps through tokens (steps x lanes) from state h, which `keep` sets to 0 where texts begin. A column for each lane, so that gates
        are whole rows: the state before each step, a one and the embedding; with `whole` the steps' gates (update, reset, the candidate's part by the
        state, its part by the input) and candidates; the last state."""
        p, H, (T, lanes) = self.p, self.hidden, tok.shape
        x = np.empty((T, H + p["E"].shape[1] + 1, lanes), np.float32)
        x[:, H] = 1
        x[:, H + 1 :] = p["E"][tok].transpose(0, 2, 1)
        w = np.zeros((4 * H, x.shape[1]), np.float32)
        w[: 3 * H, :H] = p["U"].T
        for to, of in ((slice(0, 2 * H), slice(0, 2 * H)), (slice(3 * H, None), slice(2 * H, None))):
            w[to, H], w[to, H + 1 :] = p["b"][of], p["W"].T[of]
        w[: 2 * H] *= 0.5  # sigmoid(x) = 0.5 + 0.5 tanh(x / 2)
        begins = ~keep.all(1)
        gates, cand = np.empty((T if whole else 1, 4 * H, lanes), np.float32), np.empty((T if whole else 1, H, lanes), np.float32)
        for t in range(T):
            hp, g, c = x[t, :H], gates[t * whole], cand[t * whole]
            if begins[t]:
                np.multiply(h, keep[t], out=hp)
            else:
                hp[...] = h
            np.matmul(w, x[t], out=g)
            zr = g[: 2 * H]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(g[H : 2 * H], g[2 * H : 3 * H], out=c)
            c += g[3 * H :]
            np.tanh(c, out=c)
            h = hp - c
            h *= g[:H]
            h += c
        return x, gates, cand, h

    def train(self, tokens: np.ndarray, starts: np.ndarray, epochs: int = EPOCHS, lanes: int = LANES, steps: int = STEPS, rate: float = RATE) -> None:
        """Truncated backpropagation over `tokens` laid in lanes; `starts` marks the first token of each text."""
        width = len(tokens) // lanes
        if width < 2:
            return
        self.passes(tokens[: lanes * width].reshape(lanes, width), starts[: lanes * width].reshape(lanes, width), np.full(lanes, width), epochs, steps, rate)

    def passes(self, x: np.ndarray, new: np.ndarray, length: np.ndarray, epochs: int, steps: int = STEPS, rate: float = RATE, least: float = 0.1) -> None:
        """Training on lanes of tokens, the longest first; `length` is how far each is filled. The rate falls to `least` of it."""
        H, width = self.hidden, x.shape[1]
        flat = np.concatenate([v.ravel() for v in self.p.values()])  # all parameters as one vector, which `p` looks into
        parts = lambda v: {k: x.reshape(w.shape) for (k, w), x in zip(self.p.items(), np.split(v, np.cumsum([w.size for w in self.p.values()])[:-1]))}
        grad, m1, m2 = (np.zeros_like(flat) for _ in range(3))
        change = np.empty(ADAM_BLOCK, np.float32)
        blocks = [tuple(v[i : i + ADAM_BLOCK] for v in (grad, m1, m2, flat)) for i in range(0, len(flat), ADAM_BLOCK)]
        p, into = parts(flat), parts(grad)
        self.p = p
        n, last = 0, epochs * -(-width // steps)
        for _ in range(epochs):
            h = np.zeros((H, len(x)), np.float32)
            for at in range(0, width, steps):
                lanes = int((length > at).sum())
                xs, keep = x[:lanes, at : at + steps].T, (~new[:lanes, at : at + steps].T).astype(np.float32)
                T = len(xs)
                live = (np.arange(at, at + T)[:, None] < length[:lanes]).ravel()
                size = int(live.sum())
                tok = xs.ravel().astype(np.int16)
                order = np.argsort(tok if size == len(tok) else np.where(live, tok, np.int16(0x7FFF)), kind="stable")  # places beyond a lane's end come last
                place, order = places(order), order[:size]
                tok = tok[order]
                col, gates, cand, h = self.states(xs, keep, h[:, :lanes], True)
                before, z, r, uh = col[:, :H], gates[:, :H], gates[:, H : 2 * H], gates[:, 2 * H : 3 * H]
                _, found, g = self.sorted_outputs(col[:, : H + 1].transpose(0, 2, 1).reshape(-1, H + 1).take(order, 0), tok, True)
                if size < len(place):
                    found = np.concatenate([found, np.zeros((len(place) - size, H), np.float32)])
                dh_out = np.ascontiguousarray(found.take(place, 0).reshape(T, lanes, H).transpose(0, 2, 1))
                # What a gradient of the state is multiplied by, for all steps at once: of the candidate, of both gates.
                by_c = 1 - z
                by_z = before - cand
                by_z *= z
                by_z *= by_c
                by_c *= 1 - cand * cand
                by_r = 1 - r
                by_r *= r
                by_r *= uh
                back = np.empty_like(gates)
                dh = np.zeros((H, lanes), np.float32)
                begins = ~keep.all(1)
                for t in reversed(range(T)):
                    d = back[t]
                    dc = d[3 * H :]
                    np.multiply(dh, by_c[t], out=dc)
                    np.multiply(dh, by_z[t], out=d[:H])
                    np.multiply(dc, by_r[t], out=d[H : 2 * H])
                    np.multiply(dc, r[t], out=d[2 * H : 3 * H])
                    dh *= z[t]
                    dh += p["U"] @ d[: 3 * H]
                    dh += dh_out[t]
                    if begins[t]:
                        dh *= keep[t]
                for k, v in g.items():
                    into[k][...] = v
                both = np.matmul(col, back.transpose(0, 2, 1)).sum(0)
                into["U"][...] = both[:H, : 3 * H]
                both = np.delete(both[H:], np.s_[2 * H : 3 * H], 1)
                into["b"][...], into["W"][...] = both[0], both[1:]
                by_gate = np.concatenate([p["W"][:, : 2 * H], np.zeros_like(p["W"][:, :H]), p["W"][:, 2 * H :]], 1)
                de = np.matmul(by_gate, back).transpose(0, 2, 1).reshape(T * lanes, -1)
                at_word = np.flatnonzero(np.diff(tok, prepend=-1))
                into["E"][...] = 0
                into["E"][tok[at_word]] = np.add.reduceat(de[order], at_word)
                n += 1
                norm = np.sqrt(float(np.dot(grad, grad))) / size
                grad *= np.float32(min(1.0, 0.5 / max(norm, 1e-9)) / size)
                lr = rate * (1 - (1 - least) * n / last) * np.sqrt(1 - 0.999**n) / (1 - 0.9**n)
                # Adam with means not divided through: m1 holds ten times the first, m2 a thousand times the second.
                by = np.float32(lr * 0.1 * 1000**0.5)
                for g, a, b, w in blocks:
                    a *= np.float32(0.9)
                    a += g
                    b *= np.float32(0.999)
                    c = change[: len(g)]
                    np.multiply(g, g, out=c)
                    b += c
                    np.sqrt(b, out=c)
                    c += np.float32(1e-8 * 1000**0.5)
                    np.divide(a, c, out=c)
                    c *= by
                    w -= c

    def score(self, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """ln P of each text (tokens of all texts, one after another, and the number of each text's)."""
        first = np.cumsum(sizes) - sizes
        heap = [(0, k) for k in range(min(SIDE, len(sizes)))]
        lane: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-sizes, kind="stable").tolist():  # the longest first, each to the shortest lane
            n, k = heapq.heappop(heap)
            lane[k].append(i)
            heapq.heappush(heap, (n + int(sizes[i]), k))
        lane.sort(key=lambda x: -int(sizes[x].sum()))
        length = np.array([int(sizes[x].sum()) for x in lane])
        total = int(length.max(initial=0))
        out = np.zeros(len(sizes))
        base = np.cumsum(length) - length
        order = np.array([i for x in lane for i in x])
        n_of = sizes[order]
        text = np.repeat(order, n_of)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        tok = tokens[first[text] + place].astype(np.int16)
        h = np.zeros((self.hidden, len(lane)), np.float32)
        for at in range(0, total, SPAN):
            n = int((length > at).sum())
            steps = np.arange(at, min(at + SPAN, total))[:, None]
            live = (steps < length[:n]).ravel()
            i = np.minimum(base[:n] + steps, len(tok) - 1)
            x, _, _, h = self.states(tok[i], (place[i] > 0).astype(np.float32), h[:, :n])
            i = i.ravel()
            order = np.argsort(tok[i] if live.all() else np.where(live, tok[i], np.int16(0x7FFF)), kind="stable")[: int(live.sum())]
            states = x[:, : self.hidden + 1].transpose(0, 2, 1).reshape(-1, self.hidden + 1).take(order, 0)
            i = i[order]
            out += np.bincount(text[i], self.sorted_outputs(states, tok[i])[0], len(sizes))
        return out


def lanes_of(tokens: np.ndarray, sizes: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts in lanes of about equal length, the longest lane first: tokens, starts of texts, and the lanes' lengths."""
    first = np.cumsum(sizes) - sizes
    heap = [(0, k) for k in range(min(lanes, len(sizes)))]
    lane: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-sizes, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        lane[k].append(i)
        heapq.heappush(heap, (n + int(sizes[i]), k))
    lane.sort(key=lambda x: -int(sizes[x].sum()))
    length = np.array([int(sizes[x].sum()) for x in lane])
    x, new = np.zeros((len(lane), int(length.max())), tokens.dtype), np.zeros((len(lane), int(length.max())), bool)
    rng = np.random.default_rng(len(sizes))
    for k, texts in enumerate(lane):
        at = 0
        for i in rng.permutation(texts).tolist():
            new[k, at] = True
            x[k, at : at + sizes[i]] = tokens[first[i] : first[i] + sizes[i]]
            at += int(sizes[i])
    return x, new, length


def count_words(rows: DataFrame) -> DataFrame:
    """word (binary, the end is empty) and c over all texts; tasks count before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        merged = waiting = 0

        def merge() -> pa.Table:
            sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
            return pa.table([sums.column("word"), sums.column("c_sum")], names=["word", "c"])

        for part in slices(batches, most=BATCH_BYTES):
            words, code, _ = coded_words(part.column("text"))
            held.append(pa.table([words, pa.array(np.bincount(code, minlength=len(words)))], names=["word", "c"]))
            waiting += len(words)
            if waiting > merged + HELD_WORDS:
                held[:] = [merge()]
                merged, waiting = held[0].num_rows, 0
                if merged > HELD_WORDS:
                    yield from held.pop().combine_chunks().to_batches()
                    merged = 0
        if held:
            yield from merge().combine_chunks().to_batches()

    return map_batches(rows.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """What scoring needs: the most frequent words, their counts, and the model."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, tail_n: np.ndarray, tail_v: np.ndarray) -> None:
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words = [words[i] for i in order]
        self.total, self.distinct = total, distinct
        c = counts[order].astype(float)
        self.head = min(HEAD, len(self.words))
        if END not in self.words[: self.head]:  # the end is always one of the model's own words
            at = self.words.index(END) if END in self.words else None
            count = c[at] if at is not None else 0.0
            if at is not None:
                self.words.pop(at)
                c = np.delete(c, at)
            at = max(self.head - 1, 0)
            self.words.insert(at, END)
            c, self.head = np.insert(c, at, count), max(1, self.head)
        self.tail_n, self.tail_v = tail_n.copy(), tail_v.copy()
        self.kind = np.fromiter(map(spelling, self.words), np.int64, len(self.words))
        rest = np.arange(len(self.words)) >= self.head
        np.add.at(self.tail_n, self.kind[rest], c[rest])
        np.add.at(self.tail_v, self.kind[rest], 1)
        self.known = c > 0
        self.base = np.log10((c + 1) / (total + distinct + 1))
        self.inside = np.where(rest, np.log10((c + 1) / (self.tail_n + self.tail_v + 1)[self.kind]), 0.0)
        self.input = np.where(rest, self.head + self.kind, np.arange(len(self.words)))
        self.model = Gru(c[: self.head], self.tail_n)
        self.words = pa.array(self.words, pa.binary())

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Position of each word, -1 where it is not among the most frequent."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)


def lexicon(rows: DataFrame, scratch: Scratch, lookup: int = LOOKUP) -> tuple[Lexicon, DataFrame]:
    """The lexicon of training texts with its untrained model, and the staged counts of the words beyond it."""
    counts = scratch.stage(count_words(rows), "counts")
    # By logarithmic steps of the count: as many of the most frequent words as the bound allows.
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    steps = sorted(((r["s"], r["v"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()), reverse=True)
    distinct, total = sum(v for _, v, _ in steps), int(sum(n for *_, n in steps))
    held, least = 0, 1 << 30
    for s, v, _ in steps:
        if held + v > lookup:
            break
        held, least = held + v, s
    top = counts.where(step >= least).toArrow()  # `lookup` rows at most
    rest = counts.where(step < least)
    kind = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(TAILS)).cast("int")
    tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    for r in rest.groupBy(kind.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tail_n[r["k"]], tail_v[r["k"]] = r["n"], r["v"]
    return Lexicon(top.column("word").to_pylist(), top.column("c").to_numpy(), total, distinct, tail_n, tail_v), rest


TAIL = pa.struct([("word", pa.binary()), ("kind", pa.int32()), ("times", pa.int64())])


def look(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """row (a number of its own), doc_id, learn, u (a number from 0 to 1 by id and text), x (the model's inputs, 16 bits each), n_tokens, and of
    the words that the lexicon has: n_known, base, inside; tail: all others."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    kind = docs.schema["doc_id"].dataType.simpleString()
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(11)), 11) / float(1 << 53)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, row = shared.value, TaskContext.get().partitionId() << 36
        for part in slices(batches, most=BATCH_BYTES):
            words, code, sizes = coded_words(part.column("text"))
            at = lex.look_up(words)
            ok = at >= 0
            rare = np.flatnonzero(~ok)
            kind = np.zeros(len(words), np.int32)
            kind[rare] = np.fromiter(map(spelling, words.take(pa.array(rare)).to_numpy(zero_copy_only=False)), np.int32, len(rare))
            x = np.where(ok, lex.input[at], lex.head + kind).astype(np.int16)[code]
            edges = np.concatenate([[0], np.cumsum(sizes)])
            inputs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((edges * 2).astype(np.int32)), pa.py_buffer(x)])
            text = np.repeat(np.arange(len(sizes)), sizes)
            by = lambda v: np.bincount(text, np.where(ok, v[at], 0)[code], len(sizes))  # noqa: B023, E731
            miss = np.flatnonzero(~ok[code])
            pairs, times = np.unique(text[miss] * len(words) + code[miss], return_counts=True)  # by text
            own = pairs % max(1, len(words))
            items = pa.StructArray.from_arrays([words.take(pa.array(own)), pa.array(kind[own]), pa.array(times)], fields=list(TAIL))
            ends = np.searchsorted(pairs, np.arange(len(sizes) + 1) * len(words))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
            out = [pa.array(np.arange(row, row + len(sizes))), *(part.column(c) for c in ("doc_id", "learn", "u")), inputs, pa.array(sizes), pa.array(by(lex.known).astype(np.int64)), pa.array(by(lex.base)), pa.array(by(lex.inside)), lists]
            row += len(sizes)
            yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "learn", "u", "x", "n_tokens", "n_known", "base", "inside", "tail"])

    return map_batches(docs.select("doc_id", "learn", u.alias("u"), "text"), run, f"row long, doc_id {kind}, learn boolean, u double, x binary, n_tokens long, n_known long, base double, inside double, tail array<struct<word: binary, kind: int, times: long>>")


def inputs_of(batch: pa.RecordBatch) -> np.ndarray:
    """The model's inputs of all rows, one after another; no row is null or empty."""
    x = batch.column("x")
    edges = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2], np.int16)[edges[0] // 2 : edges[-1] // 2].copy()


def mean_copy(copies: pa.Table) -> pa.Table:
    """One copy of the model, the mean of these by tokens; none of none."""
    if not copies.num_rows:
        return copies
    n, mean = copies.column("n").to_numpy(), 0.0
    for k, w in zip(n, copies.column("weights")):
        mean = mean + np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) * (k / n.sum())
    return pa.table([copies.column("heap").slice(0, 1), pa.array([int(n.sum())]), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["heap", "n", "weights"])


def train(rows: DataFrame, lex: Lexicon, start: int = TRAIN_TOKENS) -> int:
    """Trains the lexicon's model on all texts of `rows`, which were looked up; the number of tokens gone through after the start."""
    spark, u = rows.sparkSession, F.col("u")
    plan = copy.copy(lex.model)  # without its weights
    plan.p = {}

    def part(rows: DataFrame, tasks: int, epochs: int, rate: float, least: float, most: int | None = None) -> int:
        weights = spark.sparkContext.broadcast(lex.model.p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, waiting = [], 0, 0
            model = copy.copy(plan)
            model.p = {k: v.copy() for k, v in weights.value.items()}
            room = most or LAID

            def learn() -> None:
                laid = lanes_of(np.concatenate([x for x, _ in held]), np.concatenate([c for _, c in held]), LANES if most else PASS_LANES)
                model.passes(*laid, epochs, rate=rate, least=least)
                held.clear()

            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append((inputs_of(batch), batch.column("n_tokens").to_numpy()))
                n, waiting = n + len(held[-1][0]), waiting + len(held[-1][0])
                if waiting >= room:
                    learn()
                    waiting = 0
                    if most:  # the start is made; what is left comes in the pass over all texts
                        break
            if held:
                learn()
            if n:
                own = np.concatenate([v.ravel() for v in model.p.values()]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % TASKS], pa.int32()), pa.array([n]), pa.array([own], pa.binary())], names=["heap", "n", "weights"])

        copies = map_batches(rows.select("x", "n_tokens").coalesce(tasks), run, "heap int, n long, weights binary")
        if tasks > TASKS:  # the driver gets TASKS means at most, however many cores there are
            copies = copies.groupBy("heap").applyInArrow(mean_copy, "heap int, n long, weights binary")
        found = mean_copy(copies.toArrow())
        total = found.column("n")[0].as_py() if found.num_rows else 0
        if total:
            edge = np.cumsum([v.size for v in lex.model.p.values()])[:-1]
            mean = np.frombuffer(found.column("weights")[0].as_py(), np.float32)
            lex.model.p = {k: x.reshape(v.shape).copy() for (k, v), x in zip(lex.model.p.items(), np.split(mean, edge))}
        weights.destroy()
        return total

    part(rows.where(u < F.lit(1.2 * start / max(1, lex.total))), 1, EPOCHS, RATE, 0.1, start)
    tasks = max(spark.sparkContext.defaultParallelism, min(TASKS, -(-lex.total // (ROUNDS * WORTH))))
    return sum(part(rows.where(F.floor(u * ROUNDS) == k), tasks, 1, PASS_RATE * (1 - k / ROUNDS), 0.8) for k in range(ROUNDS))


def score(docs: DataFrame, held_out: int = 2, of: int = 7, lookup: int = LOOKUP, train_tokens: int = TRAIN_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Texts are looked up once; training and scoring read the staged inputs."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "gru")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = plain(docs, doc_id=kind, text="string").withColumn("learn", F.coalesce(crc_bucket(of) != held_out, F.lit(False)))
    lex, rest = lexicon(docs.where("learn"), scratch, lookup)
    looked = scratch.stage(look(docs, lex), "looked")
    train(looked.where("learn"), lex, train_tokens)
    shared = spark.sparkContext.broadcast(lex.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        held: list[tuple[np.ndarray, pa.RecordBatch]] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches([b for _, b in held]).combine_chunks().to_batches()[0]
            ln = model.score(np.concatenate([x for x, _ in held]), rows.column("n_tokens").to_numpy())
            held.clear()
            own = pa.array(ln / LN10 + rows.column("inside").to_numpy())
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in plain_columns), own], names=[*plain_columns, "own"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((inputs_of(batch), batch.drop_columns(["x"])))
            size += len(held[-1][0])
            if size >= BUFFER:
                yield flush()
                size = 0
        if held:
            yield flush()

    plain_columns = ["row", "doc_id", "n_tokens", "n_known", "base"]
    scored = map_batches(looked.select(*plain_columns, "inside", "x"), run, f"row long, doc_id {kind}, n_tokens long, n_known long, base double, own double")
    # The words beyond the lexicon go their own way, with nothing but their text's row.
    met = looked.select("row", F.explode("tail").alias("item")).select("row", "item.word", "item.kind", "item.times").join(rest, "word", "left")
    c, times = F.coalesce("c", F.lit(0)), F.col("times")
    room = F.array(*(F.lit(float(n + v + 1)) for n, v in zip(lex.tail_n, lex.tail_v)))
    tails = met.groupBy("row").agg(
        F.sum(F.when(c > 0, times).otherwise(0)).alias("_known"), F.sum(times * F.log10((c + 1) / F.lit(float(lex.total + lex.distinct + 1)))).alias("_base"),
        F.sum(times * F.log10((c + 1) / F.get(room, F.col("kind")))).alias("_inside"),
    )
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias
    out = scored.join(tails, "row", "left").select("doc_id", "n_tokens", plus("n_known", "_known")("n_known"), plus("base", "_base")("base_score"), plus("own", "_inside")("score"))
    return out.select("doc_id", (crc_bucket(of) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(lex.total).cast("long").alias("train_tokens"), "base_score", "score")
