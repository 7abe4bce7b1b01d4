"""Toxic-span tagging with a linear-chain conditional random field.

Documents carry one label each, so token labels are derived first: a token of a
toxic document counts as toxic where its word, or a prefix of it, is found in
toxic documents far more often than in clean ones.  A two-state chain over the
tokens of a line is then fitted by gradient descent on its exact likelihood
(forward-backward), with the token's word and prefixes and the words before and
after it as features.  Scoring runs
forward-backward over every line of every document; marginals are aggregated to
a calibrated document score, and runs of tokens with a marginal of one half or
more are the offending spans.

The fit uses a bounded sample (``Settings.sample`` rows of each class) and whole
texts, like scoring.  The scores' intercept is that of all training labels: where
the bound leaves out more of one class than of the other, it is set right again.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep_small, map_batches, materialise

_TOKEN = re.compile(r"\w+|\n")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    sample: int = 600  # labelled rows of each class that the model is fitted on, at most
    min_docs: int = 3  # toxic documents that a tell-tale word or prefix is in, at least
    min_odds: float = 12.0  # its document rate in toxic over clean documents, at least
    rounds: int = 60
    step: float = 0.5
    l2: float = 1e-5
    seed: int = 7


def _names(word: str) -> list[str]:
    """A token's features: its lower-cased word and that word's prefixes."""
    w = word.lower()
    return [w, *(w[:n] + "*" for n in PREFIXES if len(w) >= n)]


#: Marks of the features that a word gives to the token after it and to the one before it.
BEFORE, AFTER = "<", ">"

def _sketch(toks: list[str]) -> int:
    """Smallest hash of three words in a row: near copies share it, so that a copied text counts once."""
    return min((crc32(" ".join(toks[k : k + 3]).encode()) for k in range(max(1, len(toks) - 2))), default=0)


def forward_backward(emit: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1, summed pair marginals and the log-partition of many chains.

    ``emit`` holds state 1's score less state 0's for all tokens of all chains;
    chain k begins at ``starts[k]``.  Chains run side by side, longest first, so
    the loop is over positions and not over tokens.
    """
    n = len(emit)
    ends = np.append(starts[1:], n)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    first, size = starts[order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # chains longer than t
    e = np.exp(np.clip(emit, -60, 60))
    t00, t01, t10, t11 = np.exp(trans).ravel()
    ahead = np.empty(n)  # p(state 1 | past) at each token
    log_z = 0.0
    p = np.empty(len(first))
    for t in range(longest):
        k = active[t]
        at = first[:k] + t
        if t:
            q = p[:k]
            a0, a1 = (1 - q) * t00 + q * t10, ((1 - q) * t01 + q * t11) * e[at]
        else:
            a0, a1 = np.ones(k), e[at]
        z = a0 + a1
        p[:k] = a1 / z
        ahead[at] = p[:k]
        log_z += float(np.log(z).sum())
    marginal = np.empty(n)
    pairs = np.zeros((2, 2))
    b0, b1 = np.ones(len(first)), np.ones(len(first))
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        f1 = ahead[at]
        m0, m1 = (1 - f1) * b0[:k], f1 * b1[:k]
        marginal[at] = m1 / (m0 + m1)
        if t:
            g = ahead[at - 1]
            u0, u1 = b0[:k], b1[:k] * e[at]
            j = np.array([(1 - g) * t00 * u0, (1 - g) * t01 * u1, g * t10 * u0, g * t11 * u1])
            pairs += (j / j.sum(axis=0)).sum(axis=1).reshape(2, 2)
            c0, c1 = t00 * u0 + t01 * u1, t10 * u0 + t11 * u1
            s = c0 + c1
            b0[:k], b1[:k] = c0 / s, c1 / s
    return marginal, pairs, log_z


def _chains(tokens: list[str]) -> list[list[str]]:
    out, cur = [], []
    for t in tokens:
        if t == "\n":
            if cur:
                out.append(cur)
            cur = []
        else:
            cur.append(t)
    return [*out, cur] if cur else out


_BREAK = np.array([[math.nan], [0.0], [0.0]])


class Model:
    """Fitted weights by feature; ``tagger()`` gives a function from texts to their marginals."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, calibration: tuple[float, float, float]):
        self.weights, self.bias, self.trans, self.calibration = weights, bias, trans, calibration

    def tagger(self):
        """A function from texts to ``(marginals, tokens)``; what it knows of words is bounded."""
        most = 150_000
        known: dict[str, int] = {"\n": 0}
        held = [0]  # characters remembered
        # of each word known: its own score, and what it adds to the token after and before it
        table = np.zeros((3, most + 1))
        table[0, 0] = math.nan
        weigh = self.weights.get

        def remember(word: str) -> int:
            w = word.lower()
            k = len(known)
            table[0, k] = self.bias + sum(weigh(x, 0.0) for x in _names(w))
            table[1, k], table[2, k] = weigh(BEFORE + w, 0.0), weigh(AFTER + w, 0.0)
            known[word] = k
            held[0] += len(word)
            return k

        def look_up(toks: list[str]) -> np.ndarray:
            if len(known) + len(toks) > most or held[0] > 8_000_000:
                known.clear()
                known["\n"] = held[0] = 0
            ids = list(map(known.get, toks))
            if None in ids:
                ids = [known[w] if w in known else remember(w) for w in toks]
            return table[:, ids]

        def tag(texts: list[str]) -> list[tuple[np.ndarray, list[str]]]:
            rows, all_tokens, lengths = [], [], []
            for text in texts:
                toks = _TOKEN.findall(text)
                all_tokens.append(toks)
                lengths.append(len(toks) + 1)
                rows += [_BREAK, *(look_up(toks[at : at + most // 2]) for at in range(0, len(toks), most // 2))]
            x = np.concatenate(rows, axis=1) if rows else np.zeros((3, 0))
            flat = x[0].copy()
            real = ~np.isnan(flat)
            inner = np.flatnonzero(real[1:] & real[:-1]) + 1
            flat[inner] += x[1, inner - 1]
            flat[inner - 1] += x[2, inner]
            begins = np.flatnonzero(real & np.append(True, ~real[:-1])) if len(flat) else np.empty(0, np.int64)
            starts = (np.cumsum(real) - 1)[begins]
            marginal = np.zeros(len(flat))
            if len(starts):
                marginal[real] = forward_backward(flat[real], starts, self.trans)[0]
            cuts = np.cumsum(lengths)[:-1]
            return list(zip([m[1:] for m in np.split(marginal, cuts)], all_tokens, strict=True)) if rows else []

        return tag

    def score(self, marginal: np.ndarray) -> float:
        a, b, c = self.calibration
        top = float(marginal.max()) if len(marginal) else 0.0
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * top + c * math.log1p(float(marginal.sum()))))))


def fit(rows: list[tuple[str, int]], s: Settings, drawn: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Fit on ``(text, label)``; with one class only, every score is that class's smoothed share.

    ``drawn`` is the share of the rows of class 0 and of class 1 that ``rows`` holds.
    """
    texts, labels = [r[0] for r in rows], np.array([r[1] for r in rows], int)
    n1 = int(labels.sum())
    all0, all1 = (len(labels) - n1) / drawn[0], n1 / drawn[1]
    base = (all1 + 0.5) / (all0 + all1 + 1)
    flat = Model({}, -60.0, np.zeros((2, 2)), (math.log(base / (1 - base)), 0.0, 0.0))
    if not 0 < n1 < len(labels):
        return flat
    one: dict[str, str] = {}
    tokens = [[one.setdefault(m[0], m[0]) for m in _TOKEN.finditer(t)] for t in texts]  # equal tokens are one string
    seen, size, met = (Counter(), Counter()), [0, 0], set()
    for toks, y in zip(tokens, labels, strict=True):
        if (key := (y, _sketch(toks))) not in met:
            met.add(key)
            size[y] += 1
            seen[y].update({x for w in set(toks) - {"\n"} for x in _names(w)})
    share, many = size[1] / sum(size), math.log(len(seen[1]) + 1) + 3

    def tells(c: int, k: int) -> bool:
        """In c toxic and k clean documents: often enough, at the wanted odds, and not by chance among so many features."""
        if c < s.min_docs or (c / size[1]) / ((k + 0.5) / size[0]) < s.min_odds:
            return False
        r = c / (c + k)
        return c * math.log(r / share) + (k * math.log((1 - r) / (1 - share)) if k else 0.0) >= many

    telling = {x for x, c in seen[1].items() if tells(c, seen[0][x])}
    if not telling:
        return flat
    verdict: dict[str, bool] = {}
    chains, tags = [], []
    for toks, y in zip(tokens, labels, strict=True):
        for chain in _chains(toks):
            marks = [False] * len(chain)
            if y:
                for k, w in enumerate(chain):
                    if w not in verdict:
                        verdict[w] = any(x in telling for x in _names(w))
                    marks[k] = verdict[w]
            chains.append(chain)
            tags.append(np.array(marks))
    index: dict[str, int] = {}
    width = 3 + len(PREFIXES)
    ids = np.zeros((width, sum(map(len, chains))), np.int32)  # weight 0 stays 0: no feature
    words: dict[str, list[int]] = {}
    at = 0
    for chain in chains:
        rows = []
        for w in chain:
            if w not in words:
                low = w.lower()
                own = [index.setdefault(x, len(index) + 1) for x in _names(w)]
                words[w] = [index.setdefault(BEFORE + low, len(index) + 1), index.setdefault(AFTER + low, len(index) + 1), *own, *[0] * (width - 2 - len(own))]
            rows.append(words[w])
        own = np.array(rows, np.int32)
        ids[2:, at : at + len(own)] = own[:, 2:].T
        ids[0, at + 1 : at + len(own)] = own[:-1, 0]
        ids[1, at : at + len(own) - 1] = own[1:, 1]
        at += len(own)
    gold = np.concatenate(tags).astype(float)
    sizes = np.array([len(c) for c in chains])
    starts = np.append(0, np.cumsum(sizes)[:-1])
    inner = np.ones(len(gold), bool)
    inner[starts] = False
    prev = gold[np.flatnonzero(inner) - 1].astype(int)
    cur = gold[inner].astype(int)
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (prev, cur), 1)
    w, bias, trans = np.zeros(len(index) + 1), 0.0, np.zeros((2, 2))
    gw, gb, gt = np.full(len(w), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(s.rounds):  # full-batch AdaGrad on the negative log-likelihood
        m, pairs, _ = forward_backward(sum(w[column] for column in ids) + bias, starts, trans)
        d = m - gold
        g = sum(np.bincount(column, d, minlength=len(w)) for column in ids) + s.l2 * len(gold) * w
        g[0] = 0
        gw += g * g
        w -= s.step * g / np.sqrt(gw)
        gb += d.sum() ** 2
        bias -= s.step * d.sum() / math.sqrt(gb)
        dt = pairs - gold_pairs
        gt += dt * dt
        trans -= s.step * dt / np.sqrt(gt)
    model = Model({x: float(w[k]) for x, k in index.items() if abs(w[k]) > 1e-3}, float(bias), trans, (0.0, 0.0, 0.0))
    tag = model.tagger()
    x = []
    for k in range(0, len(texts), 200):
        x += [(1.0, float(m.max()) if len(m) else 0.0, math.log1p(float(m.sum()))) for m, _ in tag(texts[k : k + 200])]
    x, beta = np.array(x), np.array([-2.0, 2.0, 1.0])
    for _ in range(200):  # ridge logistic regression by Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (p - labels) + 0.1 * beta)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    beta[0] += math.log(drawn[0] / drawn[1])  # from the sample's class shares to those of all rows
    model.calibration = tuple(beta.tolist())
    return model


def in_training(doc_id: F.Column) -> F.Column:
    """Rows whose labels may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label_col: str = "toxic") -> Model:
    """Fit on at most ``settings.sample`` training rows of each class, those whose hashed ids come first."""
    own = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where(in_training(F.col("doc_id")) & F.col("y").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.col("doc_id"), F.lit(settings.seed))
    size = {r[0]: r[1] for r in own.groupBy("y").count().collect()}  # two rows
    drawn = tuple(min(1.0, settings.sample / size.get(y, 1)) for y in (0, 1))
    sample = None
    for y in (1, 0):
        part = own.where(F.col("y") == y).orderBy(order, "doc_id").limit(settings.sample)
        sample = part if sample is None else sample.unionByName(part)
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y").collect()  # 2 x sample rows
    rows = sorted((r[0], r[1], r[2]) for r in rows)
    keep_small()
    model = fit([(t, y) for _, t, y in rows], settings, drawn)
    give_back()
    return model


SCORED = "doc_id long, score double, n_spans long, spans string"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, n_spans, spans)`` for every row of ``docs``.

    ``spans`` lists ``start:end`` in code points, comma-joined.  Null and empty
    texts get the score of a text without toxic tokens; texts of any length are
    scored whole; repeated rows and null ids keep a row each; extra columns are
    ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        tag = m.tagger()
        for b in batches:
            ids, scores, counts, spans = b.column(0), [], [], []
            pending: list[str] = []
            size = 0

            def flush() -> None:
                for text, (marginal, toks) in zip(pending, tag(pending), strict=True):
                    scores.append(m.score(marginal))
                    found = _spans(text, marginal, toks) if len(marginal) and marginal.max() >= 0.5 else []
                    counts.append(len(found))
                    spans.append(",".join(f"{s}:{e}" for s, e in found))

            for t in b.column(1):
                pending.append(t.as_py() or "")
                size += len(pending[-1])
                if size > 2_000_000:
                    flush()
                    pending, size = [], 0
            flush()
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())], names=["doc_id", "score", "n_spans", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_batches, run, SCORED)


def _spans(text: str, marginal: np.ndarray, toks: list[str]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    joined = False
    for k, m in enumerate(_TOKEN.finditer(text)):
        if toks[k] != "\n" and marginal[k] >= 0.5:
            out = [*out[:-1], (out[-1][0], m.end())] if joined else [*out, m.span()]
            joined = True
        else:
            joined = False
    return out


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; rows with a null id stay."""
    bad = score(docs, train(docs, labels)).where(F.col("score") >= threshold).select("doc_id").distinct()
    return docs.join(materialise(bad, "toxic"), "doc_id", "left_anti").select(*docs.columns)
