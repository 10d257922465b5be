"""Language identification by a linear-chain conditional random field over words.

Features of a word are its character 1- to 4-grams with marks at both ends (so prefixes and suffixes are among them)
and, for words of the lexicon, the word itself; all are hashed into one weight table. Transition weights are learned
with them, on sequences of segments from texts of different languages, so the chain knows code-switching. Texts are
labelled word by word with forward-backward posteriors; the language with the largest sum over the whole text wins.

Training runs on the driver over at most SAMPLE_ROWS labelled texts of each language (the first by a seeded hash), so
that a rare language is learned as well as a frequent one; each of them is read whole. The bound is for learning only.
Prediction is a map over partitions and reads every whole text: blocks of BLOCK words are multiplied up as matrices at
once, so a long text costs no long chain of steps.

Cases: an empty table gives an empty one. A null text or one without letters gives `und` with score 0. Texts that equal each other get equal results.
Rows without a language are predicted but never learned from; with nothing to learn from, every text gives `und`.
Input columns named lang_pred or score are replaced, others are carried along.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fold, pieces_of, small_batches

NAME = "op9_language_crf"
UNKNOWN = "und"
#: Labelled rows of a language that a model learns from, as whole texts.
SAMPLE_ROWS, SEED = 400, 9
BUCKETS, LEXICON, GRAMS = 1 << 17, 4000, 4
LENGTH, BATCH, EPOCHS, RATE, SEGMENT = 32, 256, 2, 0.3, 14
BLOCK = 64
CACHE_WORDS = 200_000


def _no_letters() -> str:
    """The characters that \\w takes besides letters, decimal digits and _, as ranges of a pattern: numbers such as ½, ² or Ⅷ."""
    out, last = [], -2
    for c in range(0x80, sys.maxunicode + 1):
        if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal():
            if c == last + 1:
                out[-1][1] = c
            else:
                out.append([c, c])
            last = c
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


WORD = re.compile(rf"[^\W\d_{_no_letters()}]+")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hash(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each of the words whose code points stand in one flat array."""
    starts = np.cumsum(lengths) - lengths
    place = (np.arange(len(points)) - np.repeat(starts, lengths)).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(points.astype(np.uint64) + (place << np.uint64(24))), starts)) if len(points) else np.zeros(0, np.uint64)


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat feature buckets of the words and the number of each word's."""
    lengths = np.array([len(w) for w in words], np.int64)
    own = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    marked = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths + 2)
    codes, owners = [], []
    h = np.zeros(len(marked), np.uint64)
    for n in range(1, GRAMS + 1):
        h = h[: len(marked) - n + 1] * np.uint64(0x100000001B3) + marked[n - 1 :] if n > 1 else marked + np.uint64(7)
        inside = owner[: len(h)] == owner[n - 1 :] if n > 1 else (marked != ord("^")) & (marked != ord("$"))
        codes.append(_mix(h[inside] + np.uint64(n << 56)))
        owners.append(owner[: len(h)][inside])
    whole = word_hash(own, lengths)
    at = np.minimum(np.searchsorted(lexicon, whole), max(0, len(lexicon) - 1))
    known = lexicon[at] == whole if len(lexicon) else np.zeros(len(words), bool)
    codes.append(_mix(whole[known]))
    owners.append(np.flatnonzero(known))
    code, who = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return (code[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.bincount(who, minlength=len(words))


@dataclass
class Model:
    languages: list[str]
    lexicon: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        code, count = features(words, self.lexicon)
        return np.add.reduceat(self.weights[code], np.cumsum(count) - count, axis=0)


def train(texts: list[str], langs: list[str]) -> Model:
    """Fits weights and transitions by AdaGrad on the exact gradient."""
    languages = sorted(set(langs))
    k = len(languages)
    split = [[w.lower() for w in WORD.findall(t)] for t in texts]
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in ws], np.int64) for ws in split]
    keep = [i for i, x in enumerate(ids) if len(x)]
    if not keep:
        return Model([], np.zeros(0, np.uint64), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32))
    words = list(index)
    seen = np.bincount(np.concatenate([ids[i] for i in keep]), minlength=len(words))
    common = [words[i] for i in np.argsort(-seen, kind="stable")[:LEXICON]]
    lexicon = np.sort(word_hash(np.frombuffer("".join(common).encode("utf-32-le"), np.uint32), np.array([len(w) for w in common], np.int64)))
    code, count = features(words, lexicon)
    first = np.cumsum(count) - count
    rnd = np.random.default_rng(SEED)
    total = sum(len(ids[i]) for i in keep)
    stream, label = [], []
    for _ in range(EPOCHS):
        for i in rnd.permutation(keep):
            a = 0
            while a < len(ids[i]):
                n = int(rnd.geometric(1 / SEGMENT))
                stream.append(ids[i][a : a + n])
                label.append(np.full(len(stream[-1]), languages.index(langs[i])))
                a += n
    order = rnd.permutation(len(stream))
    flat, gold = np.concatenate([stream[i] for i in order]), np.concatenate([label[i] for i in order])
    n = max(1, len(flat) // LENGTH)
    flat, gold = np.resize(flat, n * LENGTH).reshape(n, LENGTH), np.resize(gold, n * LENGTH).reshape(n, LENGTH)
    w, a = np.zeros((BUCKETS, k)), np.zeros((k, k))
    gw, ga = np.full((BUCKETS, k), 1e-2), np.full((k, k), 1e-2)
    for s in range(0, n, BATCH):
        x, y = flat[s : s + BATCH], gold[s : s + BATCH]
        token = x.ravel()
        c = count[token]
        ends = np.cumsum(c)
        where = code[np.arange(ends[-1]) + np.repeat(first[token] - ends + c, c)]
        e = np.add.reduceat(w[where], ends - c, axis=0).reshape(*x.shape, k)
        p, pairs = _posteriors(e, a)
        miss = (np.eye(k)[y] - p).reshape(-1, k)
        spread = np.repeat(miss, c, axis=0)
        g = np.stack([np.bincount(where, spread[:, j], BUCKETS) for j in range(k)], axis=1) / len(x)
        seen_pairs = np.zeros((k, k))
        np.add.at(seen_pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d = (seen_pairs - pairs) / len(x)
        gw += g * g
        ga += d * d
        w += RATE * g / np.sqrt(gw)
        a += RATE * d / np.sqrt(ga)
    return Model(languages, lexicon, w.astype(np.float32), a.astype(np.float32))


def _posteriors(e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word posteriors of sequences of one length, and the expected transitions summed over them."""
    m = np.exp(a - a.max())
    x = np.exp(e - e.max(axis=2, keepdims=True))
    alpha, beta = np.empty_like(x), np.ones_like(x)
    alpha[:, 0] = x[:, 0] / x[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, x.shape[1]):
        v = (alpha[:, t - 1] @ m) * x[:, t]
        alpha[:, t] = v / v.sum(axis=1, keepdims=True)
    for t in range(x.shape[1] - 2, -1, -1):
        v = (beta[:, t + 1] * x[:, t + 1]) @ m.T
        beta[:, t] = v / v.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    right = x[:, 1:] * beta[:, 1:]
    norm = np.einsum("bti,ij,btj->bt", alpha[:, :-1], m, right)
    pairs = np.einsum("bti,btj->ij", alpha[:, :-1] / norm[..., None], right) * m
    return p, pairs


def summed_posteriors(e: np.ndarray, counts: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Forward-backward over texts of any lengths (counts words each, none empty): posteriors summed over each text.

    Texts are cut into blocks; the products of all blocks' matrices are taken side by side, the few block borders of
    each text are then chained, and the words inside all blocks are filled in side by side again."""
    k = e.shape[1]
    m = np.exp(a - a.max()).astype(np.float64)
    n_blocks = -(-counts // BLOCK)
    doc_of = np.repeat(np.arange(len(counts)), n_blocks)
    rank = np.arange(len(doc_of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start = np.repeat(np.cumsum(counts) - counts, n_blocks) + rank * BLOCK
    size = np.minimum(BLOCK, np.repeat(counts, n_blocks) - rank * BLOCK)
    x = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float64)
    grid = np.ones((BLOCK, len(start), k))
    inside = np.arange(BLOCK)[:, None] < size
    grid[inside] = x[(start + np.arange(BLOCK)[:, None])[inside]]
    first = rank == 0
    product = np.broadcast_to(np.eye(k), (len(start), k, k)).copy()
    for t in range(BLOCK):
        step = product @ m
        if t == 0:
            step[first] = product[first]  # no transition into a text's first word
        step *= grid[t][:, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        product = np.where(inside[t][:, None, None], step, product)
    into, out = np.full((len(start), k), 1 / k), np.full((len(start), k), 1.0)
    by_rank = np.argsort(rank, kind="stable")
    levels = np.searchsorted(rank[by_rank], np.arange(n_blocks.max() + 1))
    for r in range(1, n_blocks.max()):
        b = by_rank[levels[r] : levels[r + 1]]
        v = np.einsum("bi,bij->bj", into[b - 1], product[b - 1])
        into[b] = v / v.sum(axis=1, keepdims=True)
    for r in range(n_blocks.max() - 1, 0, -1):
        b = by_rank[levels[r] : levels[r + 1]]
        v = np.einsum("bij,bj->bi", product[b], out[b])
        out[b - 1] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty_like(grid)
    v = into
    for t in range(BLOCK):
        nxt = v @ m
        if t == 0:
            nxt[first] = v[first]
        nxt = nxt * grid[t]
        nxt /= nxt.sum(axis=1, keepdims=True)
        v = np.where(inside[t][:, None], nxt, v)
        alpha[t] = v
    total, beta = np.zeros((len(start), k)), out
    for t in range(BLOCK - 1, -1, -1):
        p = alpha[t] * beta
        p /= p.sum(axis=1, keepdims=True)
        total += np.where(inside[t][:, None], p, 0)
        nxt = (beta * grid[t]) @ m.T
        beta = np.where(inside[t][:, None], nxt / nxt.sum(axis=1, keepdims=True), beta)
    return np.add.reduceat(total, np.cumsum(n_blocks) - n_blocks, axis=0)


class Labeller:
    def __init__(self, model: Model):
        self.model, self.known, self.scores = model, {}, np.zeros((1 << 12, len(model.languages)), np.float32)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [WORD.findall(t.lower()) if t else [] for t in texts]
        counts = np.array([len(ws) for ws in split], np.int64)
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not counts.any() or not self.model.languages:
            return langs, scores
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        if new := list({w for ws in split for w in ws} - self.known.keys()):
            k = len(self.known)
            while len(self.scores) < k + len(new):
                self.scores = np.resize(self.scores, (2 * len(self.scores), self.scores.shape[1]))
            self.scores[k : k + len(new)] = self.model.emissions(new)
            self.known.update(zip(new, range(k, k + len(new)), strict=True))
        get = self.known.__getitem__
        codes = np.array([get(w) for ws in split for w in ws], np.int64)
        some = np.flatnonzero(counts)
        share = summed_posteriors(self.scores[codes], counts[some], self.model.transitions) / counts[some, None]
        best = share.argmax(axis=1)
        for i, b, s in zip(some.tolist(), best.tolist(), share[np.arange(len(some)), best].tolist(), strict=True):
            langs[i], scores[i] = self.model.languages[b], min(1.0, s)
        return langs, scores


def fit(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most rows rows of each language of df that have a text."""
    place = F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 30)).alias("place")
    # the first rows of each language are found without their texts, on every partition before they meet
    rank = lambda *more: F.row_number().over(Window.partitionBy("l").orderBy("place", "k", *more))
    ids = df.filter(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"), place)
    chosen = ids.withColumn("r", rank()).filter(F.col("r") <= rows).select("k", "l", "place").distinct()
    # of rows ids a language, a tenth of what the model holds for one
    some = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).join(F.broadcast(chosen), ["k", "l"]).filter("t is not null")

    got = some.withColumn("r", rank("t")).filter(F.col("r") <= rows).orderBy("l", "r").select("t", "l").collect()
    return train([r.t for r in got], [r.l for r in got])


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all, if not given), lang_pred and score."""
    columns = [c for c in (keep if keep is not None else df.columns) if c not in ("lang_pred", "score")]
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size: BUCKETS weights for each language

    def run(batches):
        import pyarrow as pa

        labeller = Labeller(shared.value)
        for batch in batches:
            texts, langs, scores = batch.column(batch.num_columns - 1).to_pylist(), [], []
            for a, b in pieces_of(texts, 2_000_000):
                x, y = labeller.label(texts[a:b])
                langs, scores = langs + x, scores + y
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    return df.select(*columns, F.col(text).alias("__text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
