"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of context windows.

Every word of a text runs through a table that is the product of the lexicon's trie with the Levenshtein automaton of
each branch, determinised: a state is the set of (trie node, edits so far), a step takes one character. The table is
built once from the lexicon; a batch's distinct words run through it side by side, one character a step. It accepts
terms and words that begin with a stem, those of more than EXACT_UP_TO letters with one edit too: a letter more, less
or other than it should be, or two neighbours swapped. A word with an edit that clean texts of the sample use as often
is a word of its own and no misspelling.

A hit is weighed by its window of CONTEXT words: quotation marks around it or reporting words near it make it a
quotation, second-person words near it an address. A logistic model over the summed weights (exact and misspelled
hits, stems, quoted and addressed hits, density) gives the score. It is trained on at most SAMPLE_ROWS labelled texts
(the first by a seeded hash); that bound is for learning only. So is the lexicon: to the given terms it adds words and
stems that in the sample stand in toxic texts far more often than elsewhere. They are counted by the different words
before them, so that copies and near copies of one text count once. Every text is scored whole.

Cases: a null or empty text has no hits and gets the score of a text without hits. With nothing to learn from, the
weights of PRIOR hold. Equal texts get equal scores. Input columns named score or predicted are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, documents, fold, pieces_of, small_batches

NAME = "op6_toxicity"
#: Terms to start from; the sample adds its own.
TERMS = "idiot moron stupid loser clown scum trash pathetic worthless disgusting imbecile dimwit vermin".split()
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word term dijo llamó sagte schrieb nannte wort dit écrit appelé mot".split())
SECOND_PERSON = frozenset("you your yourself youre du dein dich ihr euch tu te toi vous votre usted tú eres".split())
QUOTES = "\"'“”„«»‘’"
CONTEXT, EXACT_UP_TO, CACHE_WORDS = 6, 3, 200_000
#: Lengths of the stems that are looked for, and the least length of one that takes an edit.
STEM, STEM_EDIT = (4, 7), 6
SAMPLE_ROWS, SEED = 3000, 6
#: Intercept, then weights of FEATURES, before training.
PRIOR = (-2.0, 2.0, 1.5, 0.5, 0.0, -1.5, 1.0, 0.5)
FEATURES = ("exact", "misspelled", "stem", "stem_forms", "quoted", "addressed", "density")
TOKEN = re.compile(r"[^\W\d_]+")


class Automaton:
    """The lexicon's trie intersected with Levenshtein automata, as a transition table."""

    def __init__(self, terms: list[str], stems: list[str] = ()):
        self.terms = sorted({t.lower() for t in terms if t})
        letters = sorted({c for t in [*self.terms, *stems] for c in t})
        self.symbol = {c: i + 1 for i, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [0]  # length of the term that ends here
        reach: list[int] = [0]  # longest entry below that takes an edit
        stem_ends: dict[int, int] = {}  # a stem's end takes any letters
        for t, stem in [*((t, False) for t in self.terms), *((t, True) for t in stems)]:
            node, edit = 0, len(t) if len(t) >= STEM_EDIT or not stem else 0
            reach[0] = max(reach[0], edit)
            for c in t:
                s = self.symbol[c]
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                    ends.append(0)
                    reach.append(0)
                node = children[node][s]
                reach[node] = max(reach[node], edit)
            if stem:
                stem_ends[node] = edit
            else:
                ends[node] = len(t)

        # an item is (node, letter that must come next or 0) with the edits so far, of two ways to it the one with fewer
        def put(items: dict, node: int, due: int, edits: int) -> None:
            if edits < items.get((node, due), 2) and (edits == 0 or reach[node] > EXACT_UP_TO):
                items[node, due] = edits

        def closed(items: dict) -> frozenset:
            """With the term letters that may be missing."""
            for (node, due), edits in list(items.items()):
                if edits == 0 and not due:
                    for child in children[node].values():
                        put(items, child, 0, 1)
            return frozenset(items.items())

        def step(state: frozenset, symbol: int) -> frozenset:
            out: dict = {}
            for (node, due), edits in state:
                if due:  # the second letter of a swap
                    if symbol == due:
                        put(out, node, 0, edits)
                    continue
                if node in stem_ends:
                    put(out, node, 0, edits)
                if symbol in children[node]:
                    put(out, children[node][symbol], 0, edits)
                if edits == 0:
                    put(out, node, 0, 1)  # a letter too many
                    for first, child in children[node].items():
                        put(out, child, 0, 1)  # a wrong letter
                        if first != symbol and symbol in children[child]:
                            put(out, children[child][symbol], first, 1)
            return closed(out)

        start = closed({(0, 0): 0})
        states, rows, todo = {start: 0}, [], [start]
        terms_kind, stems_kind = [], []
        for state in todo:
            row = []
            for s in range(len(letters) + 1):
                nxt = step(state, s)
                if nxt not in states:
                    states[nxt] = len(states)
                    todo.append(nxt)
                row.append(states[nxt])
            rows.append(row)
            own = [(n, e) for (n, due), e in state if not due]
            terms_kind.append(1 + min((e for n, e in own if ends[n] and (e == 0 or ends[n] > EXACT_UP_TO)), default=-1))
            stems_kind.append(3 + min((e for n, e in own if n in stem_ends and (e == 0 or stem_ends[n] > EXACT_UP_TO)), default=-3))
        self.table, self.term_kind, self.stem_kind = np.array(rows, np.int32), np.array(terms_kind, np.int8), np.array(stems_kind, np.int8)
        self.dead = states.get(frozenset(), -1)
        self.longest = max(map(len, [*self.terms, *stems]), default=0) + 1
        self.codes = np.zeros(0x110000, np.int16)
        for c, i in self.symbol.items():
            self.codes[ord(c)] = i

    def match(self, words: list[str]) -> np.ndarray:
        """0 no term, 1 a term, 2 a misspelled term, 3 a word with a stem, 4 with a misspelled one, for each lower-case word."""
        out = np.zeros(len(words), np.int8)
        lengths = np.array([len(w) for w in words], np.int64)
        fit = np.flatnonzero(lengths > 0)
        if not len(fit) or not self.symbol:
            return out
        points = self.codes[np.frombuffer("".join([words[i] for i in fit.tolist()]).encode("utf-32-le"), np.uint32)]
        size = lengths[fit]
        starts = np.cumsum(size) - size
        state, live = np.zeros(len(fit), np.int32), np.arange(len(fit))
        for t in range(min(int(size.max()), self.longest)):
            live = live[(size[live] > t) & (state[live] != self.dead)]
            state[live] = self.table[state[live], points[starts[live] + t]]
        # beyond the longest term only a stem still holds
        term, stem = np.where(size > self.longest, 0, self.term_kind[state]), self.stem_kind[state]
        out[fit] = np.where(term == 1, 1, np.where(stem == 3, 3, np.where(term == 2, 2, stem)))
        return out


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    weights: np.ndarray
    #: Words of their own that are an edit away from a term.
    usual: frozenset[str] = frozenset()


class Scorer:
    def __init__(self, model: Model):
        self.model, self.automaton, self.known = model, Automaton(model.terms, model.stems), {}

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """FEATURES of each text."""
        split = [TOKEN.findall(t.lower()) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = list({w for ws in split for w in ws} - self.known.keys())
        if new:
            kinds = self.automaton.match(new).tolist()
            self.known.update((w, 0 if k in (2, 4) and w in self.model.usual else k) for w, k in zip(new, kinds, strict=True))
        out = np.zeros((len(texts), len(FEATURES)))
        get = self.known.__getitem__
        for i, ws in enumerate(split):
            kinds = list(map(get, ws))
            if any(kinds):
                out[i] = self._window_scores(texts[i], kinds)
        return out

    def _window_scores(self, text: str, kinds: list[int]) -> list[float]:
        low = text.lower()
        places = [m.span() for m in TOKEN.finditer(low)]
        words = [low[a:b] for a, b in places]
        exact = wrong = stem = quoted = addressed = 0.0
        forms = set()
        for k, kind in enumerate(kinds):
            if not kind:
                continue
            if kind == 3:
                stem += 1
                forms.add(words[k])
            around = words[max(0, k - CONTEXT) : k] + words[k + 1 : k + 1 + CONTEXT]
            a, b = places[max(0, k - CONTEXT)][0], places[min(len(words) - 1, k + CONTEXT)][1]
            own_a, own_b = places[k]
            marks = any(c in QUOTES for c in low[a:own_a]) and any(c in QUOTES for c in low[own_b : b + 1])
            quote = marks or any(w in REPORTING for w in around)
            exact += kind == 1
            wrong += kind in (2, 4)
            quoted += quote
            addressed += not quote and any(w in SECOND_PERSON for w in around)
        squash = lambda x: min(x, 5.0)
        return [squash(exact), squash(wrong), squash(stem), squash(len(forms)), squash(quoted), squash(addressed), min(1.0, 20 * (exact + wrong) / len(words))]

    def scores(self, texts: list[str | None]) -> list[float]:
        x = self.counts(texts)
        z = self.model.weights[0] + x @ self.model.weights[1:]
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def train(texts: list[str], toxic: list[int]) -> Model:
    """Lexicon and logistic weights (Newton steps; a ridge pulls towards PRIOR, which holds where the sample says little).

    Equal texts count once."""
    once = dict(zip(texts, toxic, strict=True))
    texts, y = list(once), np.array([int(v) for v in once.values()], float)
    if not len(y) or y.min() == y.max():
        return Model(list(TERMS), [], np.array(PRIOR))
    n1, n0 = y.sum(), len(y) - y.sum()
    words, heads = (defaultdict(set), defaultdict(set)), (defaultdict(set), defaultdict(set))
    enough = max(4, 0.015 * n1)
    seen: set[str] = set()
    for label in (1, 0):  # clean texts are read for what toxic ones show often enough
        for t, own in zip(texts, y.tolist(), strict=True):
            if own != label:
                continue
            before: dict[str, str] = {}
            last = ""
            for w in TOKEN.findall((t or "").lower()):
                if len(w) >= STEM[0] and w not in before:
                    before[w] = last
                last = w
            seen.update(before)
            for w in before.keys() & words[1].keys() if label == 0 else before:
                words[label][w].add(before[w])
            if label == 1:
                starts = Counter(w[:n] for w in before for n in range(STEM[0], min(STEM[1], len(w)) + 1))
            else:
                starts = Counter(h for w in before if w[: STEM[0]] in short for n in range(STEM[0], min(STEM[1], len(w)) + 1) if (h := w[:n]) in heads[1])
            twice = {h for h, n in starts.items() if n > 1}
            for w, last in before.items():
                for h in [w[:n] for n in range(STEM[0], STEM[1] + 1)] if w[: STEM[0]] in twice else ():
                    if h in twice:  # once a text
                        heads[label][h].add(last)
                        twice.discard(h)
        if label == 1:
            words, heads = (words[0], {w: x for w, x in words[1].items() if len(x) >= enough}), (heads[0], {h: x for h, x in heads[1].items() if len(x) >= enough})
            short = {h[: STEM[0]] for h in heads[1]}
    rare = lambda found, h, times: len(found[1][h]) / n1 > times * (len(found[0].get(h, ())) + 0.5) / n0
    stems: list[str] = []
    for h in sorted((h for h in heads[1] if rare(heads, h, 30)), key=lambda h: (len(h), h)):
        if not any(h.startswith(x) for x in stems) and not any(t.startswith(h) for t in TERMS):
            stems.append(h)
    learned = [w for w in words[1] if rare(words, w, 40) and not any(w.startswith(x) for x in stems)]
    terms = sorted({*TERMS, *learned})
    all_words = sorted(seen)
    edited = {w for w, k in zip(all_words, Automaton(terms, stems).match(all_words).tolist(), strict=True) if k in (2, 4)}
    texts_with = (Counter(), Counter())
    for t, label in zip(texts, y.astype(int).tolist(), strict=True):
        texts_with[label].update(edited.intersection(TOKEN.findall((t or "").lower())))
    usual = frozenset(w for w in edited if texts_with[1][w] / n1 <= 3 * texts_with[0][w] / n0)
    base = Model(terms, stems, np.array(PRIOR), usual)
    x = np.c_[np.ones(len(y)), Scorer(base).counts(texts)]
    w, ridge = np.array(PRIOR), np.r_[1e-3, np.full(x.shape[1] - 1, 0.5)]

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * (v - PRIOR) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * (w - PRIOR))
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-8:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(terms, stems, w, usual)


def fit(df: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most rows rows of df with a label."""
    return learn(bounded_sample(df.filter(F.col(label).isNotNull()), F.col(key), rows, SEED), label, text)


def learn(sample: DataFrame, label: str = "toxic", text: str = "text") -> Model:
    """Learns from all rows of a bounded sample."""
    got = sample.filter(F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("int").alias("y")).collect()
    return train([r.t for r in got], [r.y for r in got])


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """The columns keep (all, if not given), score and predicted."""
    columns = [c for c in (keep if keep is not None else df.columns) if c not in ("score", "predicted")]
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        for batch in batches:
            texts, out = batch.column(batch.num_columns - 1).to_pylist(), []
            for a, b in pieces_of(texts, 2_000_000):
                out += scorer.scores(texts[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*columns, "score"])

    return df.select(*columns, F.col(text).alias("__text")).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out & F.col("toxic").isNotNull())
    # the sample is drawn before the texts are read, so its size bounds the broadcast
    chosen = bounded_sample(labels, F.col("doc_id"), SAMPLE_ROWS, SEED)
    model = learn(docs.join(F.broadcast(chosen), "doc_id"))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")
