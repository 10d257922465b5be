import random

import numpy as np
import pytest

from junctura.llm import toxicity as X


def distance(a, b):
    """Edits from a to b, a swap of neighbours being one; no part is edited twice."""
    d = [[max(i, j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def brute(word, terms, stems):
    if word in terms:
        return 1
    if any(word.startswith(s) for s in stems):
        return 3
    if any(len(t) > X.EXACT_UP_TO and distance(word, t) == 1 for t in terms):
        return 2
    edited = any(distance(word[:n], s) == 1 for s in stems if len(s) >= X.STEM_EDIT for n in range(len(s) - 1, len(s) + 2))
    return 4 if edited else 0


def test_automaton_equals_edit_distance():
    rnd = random.Random(8)
    terms = {"".join(rnd.choices("abc", k=rnd.randrange(3, 10))) for _ in range(25)}
    stems = ["abca", "ccb", "cabbac"]
    words = ["".join(rnd.choices("abcé", (5, 5, 5, 1), k=rnd.randrange(1, 13))) for _ in range(3000)]
    for t in [*sorted(terms), *stems]:
        for k in range(len(t)):
            words += [t, t[:k] + t[k + 1 :], t[:k] + "x" + t[k:], t[:k] + "b" + t[k + 1 :], t + "z", t[:k] + t[k + 1 : k + 2] + t[k] + t[k + 2 :] + "é"]
    words = [w for w in words if w]
    got = X.Automaton(sorted(terms), stems).match(words).tolist()
    assert got == [brute(w, terms, stems) for w in words]


def test_short_misspelled_terms_and_usual_words():
    made = [(t.replace("idiot", "idoit"), y) for t, y in texts()] + [(f"plain crown {i} words", 0) for i in range(30)]
    model = X.train(*map(list, zip(*made, strict=True)))
    kinds = dict(zip(ws := ["moronn", "idoit", "clwn", "crown", "scun"], X.Scorer(model).automaton.match(ws).tolist(), strict=True))
    assert all(k in (1, 2) for k in kinds.values()) and "crown" in model.usual and "idoit" not in model.usual
    assert X.Scorer(model).scores(["the crown of it"]) == X.Scorer(model).scores(["the words of it"])


def test_copies_do_not_teach_terms():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    hot = [word() for _ in range(60)]
    near = [" ".join([*hot[:k], word(), *hot[k + 1 :]]) for k in range(50)]
    made = [*texts(300), *((t + " idiot", 1) for t in [" ".join(hot)] * 40 + near)]
    model = X.train(*map(list, zip(*made, strict=True)))
    assert not set(hot) & set(model.terms) and np.abs(model.weights).max() < 50


def texts(n=400, seed=2):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        ws = ["".join(rnd.choices(["tha", "ner", "ou", "sti"], k=2)) for _ in range(rnd.randrange(10, 60))]
        if i % 4 == 0:
            for _ in range(rnd.randrange(1, 4)):
                ws[rnd.randrange(len(ws))] = rnd.choice(["idiot", "moron", "pathetic", "worthles", "pathetik"])
        out.append((" ".join(ws), int(i % 4 == 0)))
    return out


@pytest.fixture(scope="module")
def model():
    return X.train(*map(list, zip(*texts(), strict=True)))


def test_held_out_accuracy(model):
    got = X.Scorer(model).scores([t for t, _ in texts(200, 9)])
    y = np.array([label for _, label in texts(200, 9)])
    assert ((np.array(got) >= 0.7) == y).mean() > 0.95


def test_quotation_and_abuse():
    scorer = X.Scorer(X.Model(list(X.TERMS), [], np.array(X.PRIOR)))
    abuse, quote = scorer.scores(["you are a worthless idiot", 'he said the word "idiot" was wrote here'])
    assert abuse > quote


def test_operator_and_cases(spark, model):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "the idiot " * 20_000, 0.5), (4, "plain words", 0.5), (4, "plain words", 0.5), (5, "x" * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = sorted((r.doc_id, r.score, r.predicted) for r in X.score(df, model).collect())
    assert len(out) == 6 and all(0 <= s <= 1 and p == int(s >= 0.7) for _, s, p in out)
    assert out[0][1] == out[1][1] and out[3] == out[4] and [p for *_, p in out] == [0, 0, 1, 0, 0, 0]
    assert X.score(df.limit(0), model).count() == 0


def test_fit_without_labels(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1)], "doc_id long, text string, toxic int")
    assert X.fit(df).weights.tolist() == list(X.PRIOR)
