"""LM scoring with a gated recurrent network in numpy.

Output words are factored: P(word) = P(class) * P(word | class), equal classes by frequency rank.  The vocabulary is
the most frequent training tokens and grows with the input: classes, and words of a class, are each twice the fourth
root of the distinct training tokens (16 at least), so words are four times their square root.  Any other token is the unknown word times its smoothed share among those
others, so each text has a probability.  Training is truncated backpropagation, one pass over all training texts in a few rounds:
in a round every task starts from the shared parameters, trains on its own texts, and the results are averaged
by parts of the parameters.  Scoring runs each document whole: lanes hold documents one after another, state is carried from window to window
and reset where a document starts.

Token counts are a distributed aggregation over all training texts.  The network's words and all tokens with
at least 1 / HEAVY of all occurrences are broadcast; the rest meets its counts in a join, where no key is hot.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import staged

END, UNKNOWN = 0, 1
#: Token of the end of a text; no word holds a blank.
END_TOKEN = b" "
HEAVY = 200_000
#: Tokens whose model id a worker remembers in training, about.
REMEMBERED = 200_000
#: Lanes of a batch in scoring and in training, and tokens after which training cuts a text (scoring never does).
LANES, WIDE, CUT = 512, 2_048, 1_024
#: Lanes of a batch in training at least, and the updates that a group of texts has if its lanes can be so few.
LEAST, UPDATES = 16, 64
#: Parameters of a part, as training sums them; rows of states whose classes are computed at once.
PART, ROWS = 65_536, 4_096


@dataclass(frozen=True)
class Shape:
    """Sizes: hidden units, classes and words of a class."""

    hidden: int = 16
    classes: int = 16
    members: int = 16

    @property
    def words(self) -> int:
        return self.classes * self.members

    @staticmethod
    def of(distinct: int, hidden: int = 16) -> Shape:
        """Sizes for so many distinct training tokens."""
        side = max(16, math.ceil(round(2 * distinct ** (1 / 4), 9)))
        return Shape(hidden, side, side)


def exponentials(states: np.ndarray, weight: np.ndarray, bias: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of the logits, the logit that each row picks and the sums of the former; one array of logits, worked in place.

    States end in a one, which takes the bias.  They lie within -1 and 1, so logits stay far from the range of float32;
    where weights don't make sure of it, a clip does.  Row sums are products with ones, which is several times faster
    than a sum over a short axis.
    """
    full = np.concatenate((weight, bias[None]))
    e = states @ full
    if not np.abs(full).sum(0).max() < 60:
        np.clip(e, -60, 60, out=e)
    own = e[np.arange(len(e)), picked]
    np.exp(e, out=e)
    return e, own, e @ np.ones(e.shape[1], e.dtype)


def slopes(e: np.ndarray, total: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Derivatives of the picked log-probabilities with respect to the logits, in place of their exponentials."""
    e *= (-1 / total)[:, None]
    e[np.arange(len(e)), picked] += 1
    return e


class Gru:
    """Parameters by name, each a float32 array."""

    def __init__(self, shape: Shape, counts: np.ndarray, seed: int = 5):
        rng, h = np.random.default_rng(seed), shape.hidden
        share = (counts + 0.5).reshape(shape.classes, shape.members)
        normal = lambda *size: (rng.standard_normal(size) / math.sqrt(h)).astype(np.float32)
        self.shape = shape
        self.p = {
            "x": normal(shape.words, 3 * h), "u": normal(h, 3 * h),
            "c": 0.1 * normal(h, shape.classes), "cb": np.log(share.sum(1) / share.sum()).astype(np.float32),
            "w": 0.1 * normal(shape.classes, h, shape.members), "wb": np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
        }
        self.square = {k: np.full_like(v, 0.05) for k, v in self.p.items()}

    def step(self, before: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step of all lanes: new state and what the way back needs."""
        h = self.shape.hidden
        g = state @ self.p["u"]
        a = self.p["x"].take(before, axis=0)
        gates = a[:, :2 * h] + g[:, :2 * h]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        r, z = gates[:, :h], gates[:, h:]
        n = r * g[:, 2 * h:]
        n += a[:, 2 * h:]
        np.tanh(n, out=n)
        new = state - n
        new *= z
        new += n
        return new, r, z, n, g[:, 2 * h:]

    def output(self, states: np.ndarray, words: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray | None, dict]:
        """Log-probabilities of the words, and gradients of their sum with respect to states and output parameters."""
        m = self.shape.members
        kind, member = words // m, words % m
        logp, grads, dstates = np.empty(len(words), states.dtype), {}, None
        if back:
            grads = {k: np.zeros_like(self.p[k]) for k in ("c", "cb", "w", "wb")}
            dstates = np.zeros_like(states)
        states = np.concatenate((states, np.ones((len(states), 1), states.dtype)), 1)
        for a in range(0, len(words), ROWS):
            s, picked = states[a:a + ROWS], kind[a:a + ROWS]
            e, own, total = exponentials(s, self.p["c"], self.p["cb"], picked)
            logp[a:a + ROWS] = own - np.log(total)
            if back:
                d = slopes(e, total, picked)
                both = s.T @ d
                grads["c"] += both[:-1]
                grads["cb"] += both[-1]
                dstates[a:a + ROWS] = d @ self.p["c"].T
        order = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(self.shape.classes + 1))
        for k in range(self.shape.classes):
            for a in range(bounds[k], bounds[k + 1], ROWS):
                rows = order[a:min(a + ROWS, bounds[k + 1])]
                s, picked = states.take(rows, axis=0), member[rows]
                e, own, total = exponentials(s, self.p["w"][k], self.p["wb"][k], picked)
                logp[rows] += own - np.log(total)
                if back:
                    d = slopes(e, total, picked)
                    both = s.T @ d
                    grads["w"][k] += both[:-1]
                    grads["wb"][k] += both[-1]
                    dstates[rows] += d @ self.p["w"][k].T
        return logp, dstates, grads

    def gradients(self, before: np.ndarray, words: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Of a window (steps x lanes; words -1: no token): gradients, log-probabilities, last state."""
        h, kept, states = self.shape.hidden, [], []
        for t in range(len(words)):
            state = state * ~fresh[t][:, None]
            new, r, z, n, g = self.step(before[t], state)
            kept.append((state, r, z, n, g))
            state = new
            states.append(state)
        live = words.reshape(-1) >= 0
        flat = np.concatenate(states)
        logp, part, grads = self.output(flat[live], words.reshape(-1)[live], True)
        dstates = np.zeros_like(flat)
        dstates[live] = part
        dstates = dstates.reshape(len(words), -1, h)
        grads["u"], grads["x"] = np.zeros_like(self.p["u"]), np.zeros_like(self.p["x"])
        carried, inputs = np.zeros_like(state), []
        for t in range(len(words) - 1, -1, -1):
            old, r, z, n, g = kept[t]
            d = dstates[t] + carried
            dn = d * (1 - z) * (1 - n * n)
            da = np.concatenate([dn * g * r * (1 - r), d * (old - n) * z * (1 - z), dn], 1)
            dg = da.copy()
            dg[:, 2 * h:] *= r
            grads["u"] += old.T @ dg
            carried = (d * z + dg @ self.p["u"].T) * ~fresh[t][:, None]
            inputs.append(da)
        one = np.zeros((before.size, 1), np.int64)
        one[:, 0] = before[::-1].reshape(-1)
        order = np.argsort(one[:, 0], kind="stable")
        ids, starts = np.unique(one[order, 0], return_index=True)
        grads["x"][ids] = np.add.reduceat(np.concatenate(inputs).take(order, axis=0), starts, axis=0)
        return grads, logp, state

    def learn(self, grads: dict, rate: float, ids: np.ndarray) -> None:
        """A step up the log-likelihood, each parameter by its own past gradients; of inputs only the words ``ids``."""
        for k, g in grads.items():
            at = ids if k == "x" else slice(None)
            self.square[k][at] += g * g
            self.p[k][at] += (rate * g / np.sqrt(self.square[k][at])).astype(np.float32)


def lanes(texts: list[np.ndarray], most: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents packed whole into lanes, longest first into the emptiest lane.

    Returns steps x lanes arrays: word (-1 after a lane's end), document, and whether a document starts; lanes are
    sorted by length, longest first.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    n = max(1, min(most, len(texts)))
    heap, holds = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for i in order:
        length, lane = heapq.heappop(heap)
        holds[lane].append(i)
        heapq.heappush(heap, (length + len(texts[i]), lane))
    holds.sort(key=lambda docs: -sum(len(texts[i]) for i in docs))
    steps = sum(len(texts[i]) for i in holds[0])
    words, doc = np.full((n, steps), -1, np.int32), np.zeros((n, steps), np.int32)
    fresh = np.zeros((n, steps), bool)
    for lane, docs in enumerate(holds):
        at = 0
        for i in docs:
            end = at + len(texts[i])
            words[lane, at:end], doc[lane, at:end], fresh[lane, at] = texts[i], i, True
            at = end
    return np.ascontiguousarray(words.T), np.ascontiguousarray(doc.T), np.ascontiguousarray(fresh.T)


def windows(texts: list[np.ndarray], width: int, most: int = LANES) -> Iterator[tuple[np.ndarray, ...]]:
    """(previous word, word, document, start) of each window, only the lanes that still have words."""
    words, doc, fresh = lanes(texts, most)
    before = np.full_like(words, END)
    before[1:] = np.where(fresh[1:], END, words[:-1])
    before[before < 0] = END
    for t in range(0, len(words), width):
        live = int((words[t] >= 0).sum())  # lanes are sorted, so these come first
        yield tuple(x[t:t + width, :live] for x in (before, words, doc, fresh))


def score(model: Gru, texts: list[np.ndarray], width: int = 64) -> np.ndarray:
    """Log-probability of each document, its state carried over all its windows."""
    out, state = np.zeros(len(texts)), None
    for before, words, doc, fresh in windows(texts, width):
        n = words.shape[1]
        state = np.zeros((n, model.shape.hidden), np.float32) if state is None else state[:n]
        states = []
        for t in range(len(words)):
            state = model.step(before[t], state * ~fresh[t][:, None])[0]
            states.append(state)
        live = words.reshape(-1) >= 0
        logp, _, _ = model.output(np.concatenate(states)[live], words.reshape(-1)[live], False)
        out += np.bincount(doc.reshape(-1)[live], logp, len(texts))
    return out


def train_on(model: Gru, texts: list[np.ndarray], width: int = 16, rate: float = 0.05) -> None:
    """One pass over the texts by truncated backpropagation."""
    state, full = None, 1
    wide = min(WIDE, max(LEAST, sum(map(len, texts)) // (width * UPDATES)))  # few texts: fewer lanes, not fewer updates
    for before, words, _, fresh in windows([t[i:i + CUT] for t in texts for i in range(0, len(t), CUT)], width, wide):
        n = words.shape[1]
        state = np.zeros((n, model.shape.hidden), np.float32) if state is None else state[:n]
        grads, logp, state = model.gradients(before, words, fresh, state)
        full = max(full, len(logp), 1)
        scale = np.float32(64.0 / full)  # so that the last windows, of few lanes, don't weigh as much as full ones
        ids = np.unique(before)
        grads["x"] = grads["x"][ids]
        model.learn({k: np.clip(g * scale, -5, 5) for k, g in grads.items()}, rate, ids)


class Ids:
    """Model ids and counts of tokens: those of the broadcast table, the others unknown here.

    ``tokens`` and ``counts`` of the table, most frequent first; the first ones are the words of the model.
    """

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, words: int):
        end = tokens == signed(END_TOKEN)
        place = np.cumsum(~end) + 1
        ids = np.where(end, END, np.where(place < words, place, UNKNOWN)).astype(np.int32)
        order = np.argsort(tokens)
        self.heavy, self.counts, self.ids = tokens[order], counts[order].astype(np.float64), ids[order]
        self.code: dict[bytes, int] = {}
        self.word: dict[bytes, int] = {}

    def words(self, tokens: list[bytes]) -> np.ndarray:
        """Model ids of tokens.  REMEMBERED of them, unknown ones too, aren't hashed again."""
        out = np.fromiter(map(self.word.get, tokens, repeat(-1)), np.int32, len(tokens))
        new = np.flatnonzero(out < 0)
        if len(new):
            names = [tokens[i] for i in new]
            h = hashes(names)
            found = np.full(len(new), UNKNOWN, np.int32)
            if len(self.heavy):
                at = np.minimum(np.searchsorted(self.heavy, h), len(self.heavy) - 1)
                found = np.where(self.heavy[at] == h, self.ids[at], UNKNOWN).astype(np.int32)
            out[new] = found
            if len(self.word) < REMEMBERED:
                self.word.update(zip(names, found.tolist(), strict=True))
        return out

    def codes(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Position of each token in the heavy table, -1 for others; and the hashes of those others, in order.

        Found tokens are remembered, as many as the table has at most.
        """
        get = self.code.get
        out = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
        new = np.flatnonzero(out < 0)
        h = hashes([tokens[i] for i in new])
        if len(new) and len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, h), len(self.heavy) - 1)
            hit = self.heavy[at] == h
            out[new[hit]] = at[hit]
            self.code.update(zip((tokens[i] for i in new[hit]), at[hit].tolist(), strict=True))
            h = h[~hit]
        return out, h


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)).view(np.int64)


def signed(token: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(token)
    return h - (1 << 64) if h >> 63 else h


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end; on bytes both know ASCII only."""
    return [*(text or "").encode().lower().split(), END_TOKEN]


def count_tokens(training: DataFrame) -> DataFrame:
    """(token, n): counts of token hashes over all whole training texts, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes(list(count))), pa.array(list(count.values()), pa.int64())], names=["token", "n"])

        for batch in batches:
            for at in range(batch.num_rows):
                count.update(tokens_of(batch.column(0)[at].as_py()))
                if len(count) > 400_000:
                    yield flush()
                    count.clear()
        yield flush()

    return training.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 12_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``most`` bytes of text, so that memory is bounded however long texts are."""
    for batch in batches:
        sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)))
        cuts = np.flatnonzero(np.diff(sizes // most, prepend=0)) if batch.num_rows else []
        edges = [0, *[int(c) for c in cuts if c], batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def fit(training: DataFrame, tokens: np.ndarray, counts: np.ndarray, shape: Shape = Shape(), rounds: int = 3, seed: int = 5,
        tasks: int | None = None) -> Gru:
    """A model trained on every whole training text (columns doc_key, text): one pass, in rounds of parallel training.

    A round takes the texts whose hash falls to it; with ``tasks``, in so many tasks, each of which goes through several
    partitions of the table and sends one model.  Parameters are summed by parts in Spark; the driver receives one sum of
    each part.
    """
    spark = training.sparkSession
    table = Ids(tokens[:shape.words], counts[:shape.words], shape.words)
    given = np.zeros(shape.words)
    np.add.at(given, table.ids, table.counts)
    if len(counts) > shape.words:
        given[UNKNOWN] += counts[shape.words:].sum()
    model = Gru(shape, given, seed)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((model.p, model.square, table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Gru(shape, np.ones(shape.words)), 0
            p, square, known = sent.value  # noqa: B023
            own.p, own.square = ({k: v.copy() for k, v in part.items()} for part in (p, square))
            for batch in pieces(batches, 0):
                texts = [known.words(tokens_of(text)) for text in batch.column(0).to_pylist()]
                train_on(own, texts)
                seen += sum(map(len, texts))
            if seen:
                flat = np.concatenate([part[k].ravel() for part in (own.p, own.square) for k in sorted(part)])
                for i, at in enumerate(range(0, len(flat), PART)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([flat[at:at + PART]]), pa.array([float(seen)])], names=["part", "values", "n"])

        chosen = training.filter(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(rounds)) == turn).select("text")
        chosen = chosen.coalesce(tasks) if tasks else chosen
        trained = chosen.mapInArrow(run, "part int, values array<float>, n double")
        got = trained.repartition("part").mapInArrow(_total, "part int, sums array<double>, n double").toArrow().sort_by("part")
        if got.num_rows:
            n = got["n"].to_numpy()
            flat = np.concatenate([x.values.to_numpy() / m for x, m in zip(got["sums"], n, strict=True)])
            at = 0
            for part in (model.p, model.square):
                for k in sorted(part):
                    part[k] = flat[at:at + part[k].size].astype(np.float32).reshape(part[k].shape)
                    at += part[k].size
        sent.unpersist()
    return model


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of each part, summed by weight; all rows of a part are in one task."""
    total: dict[int, np.ndarray] = {}
    seen: Counter[int] = Counter()
    for batch in batches:
        for i, values, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            total[i] = total.get(i, 0.0) + values.values.to_numpy().astype(np.float64) * n
            seen[i] += n
    for i, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([sums]), pa.array([float(seen[i])])], names=["part", "sums", "n"])


def score_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", shape: Shape | None = None,
                    rounds: int = 3) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    Learns from the rows whose ``held_out`` isn't true (null: not held out).  Null text counts as empty, one end token.
    Without a ``shape`` its sizes follow from the distinct training tokens.  ``base_score`` is the smoothed unigram log10 probability, ``score`` the network's.  Without training rows nothing
    is known and the network is the untrained one.  Repeated and null keys keep their rows; extra columns are left out.
    """
    held = F.coalesce(held_out, F.lit(False))
    docs = docs.select(F.col(key).alias("key"), held.alias("held_out"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    training = docs.filter(~F.col("held_out"))
    counts = staged(count_tokens(training), "tokens")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shape = shape or Shape.of(distinct)
    often = counts.filter(F.col("n") >= max(2, total / HEAVY)).count()  # HEAVY at most
    rows = counts.filter("n >= 2").orderBy(F.desc("n"), "token").limit(max(often, shape.words - 1)).toArrow()
    tokens, times_seen = rows["token"].to_numpy(), rows["n"].to_numpy()
    model = fit(training, tokens, times_seen, shape, rounds)
    table = Ids(tokens, times_seen, shape.words)
    named = table.ids != UNKNOWN
    whole = math.log10(total + 0.5 * (distinct + 1))
    others = math.log10(total - float(table.counts[named].sum()) + 0.5 * (distinct - int(named.sum()) + 1))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((table, model.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parameters = sent.value
        own = Gru(shape, np.ones(shape.words))
        own.p = parameters
        log_count = np.log10(known.counts + 0.5)
        for batch in pieces(batches, 3):
            texts, rows, rare_doc, rare = [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                tokens = tokens_of(text)
                code, left = known.codes(tokens)
                found = code >= 0
                word = np.where(found, known.ids[code] if len(known.ids) else UNKNOWN, UNKNOWN).astype(np.int32)
                texts.append(word)
                at = code[found]
                unknown = log_count[at[known.ids[at] == UNKNOWN]] if len(at) else np.empty(0)
                rows.append((len(tokens), len(at), float(log_count[at].sum()) - len(at) * whole, float(unknown.sum()) - len(unknown) * others))
                if len(left):
                    rare.append(left)
                    rare_doc.append(np.full(len(left), i))
            score_of = score(own, texts) / math.log(10)
            key_rows = batch.column(0).to_numpy()
            n, base, count = len(texts), np.array([r[2] for r in rows]), np.array([r[:2] for r in rows], np.int64)
            own_score = score_of + np.array([r[3] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(key_rows * -7046029254386353131), pa.array(np.zeros(n, np.int64)),
                 pa.array(count[:, 0]), pa.array(count[:, 1]), pa.array(base), pa.array(own_score)], names=NAMES)
            if rare:
                pairs = np.concatenate(rare), np.concatenate(rare_doc)
                order = np.lexsort(pairs)
                token, doc = pairs[0][order], pairs[1][order]
                starts = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]))))
                times = np.diff(np.append(starts, len(token)))
                for a in range(0, len(starts), 100_000):
                    s = starts[a:a + 100_000]
                    m = len(s)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key_rows[doc[s]]), pa.nulls(m, batch.column(1).type), pa.nulls(m, pa.bool_()), pa.array(token[s]),
                         pa.array(times[a:a + 100_000]), *[pa.nulls(m, pa.int64())] * 2, *[pa.nulls(m, pa.float64())] * 2], names=NAMES)

    # A row of a document has a token of its own and no occurrences, so it passes the join without meeting others.
    flowing = docs.select(F.monotonically_increasing_id().alias("row"), "key", "held_out", "text").mapInArrow(
        run, f"row long, key {kind}, held_out boolean, token long, times long, n_tokens long, n_known long, base double, score double")
    joined = flowing.join(counts.select("token", "n"), "token", "left")
    times, rare_log = F.col("times"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5))
    summed = joined.groupBy("row").agg(
        F.max("key").alias("key"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("_known"),
        F.max("base").alias("_base"), F.max("score").alias("_score"), F.sum("times").alias("_times"), rare_log.alias("_log"),
        F.sum(F.when(F.col("n") > 0, times).otherwise(0)).alias("_more"))
    return summed.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("_known") + F.col("_more")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_base") + F.col("_log") - F.col("_times") * whole).alias("base_score"),
        (F.col("_score") + F.col("_log") - F.col("_times") * others).alias("score"))


NAMES = ["row", "key", "held_out", "token", "times", "n_tokens", "n_known", "base", "score"]
