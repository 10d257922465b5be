import re
from collections import Counter

from junctura.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, n_words string, kept int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    hit = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 8)}
    base = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), base


def test_counts_against_brute_force(spark):
    run = " ".join(f"the w{i}" for i in range(12))
    texts = [None, "", " \t\n\x0b\x0c\r", "a", "ä ö ü 😀", run, f"{run}\n{run}\n{run} x", "x " * 40, "a#b *c|d\n\n a#b \na#b *c|d", "la " * 9 + "q " * 9]
    texts += [" ".join(str((i * i) % m) for i in range(300)) for m in (7, 50, 97)] + ["the long one " * 4000 + "z" * 50000]
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts + [run])]
    out = {r.doc_id: r for r in Q.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(rows)
    for i, t, *_ in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), i
        assert not (r.base_failed and r.kept)


def test_rules_name_their_failures(spark):
    good = "the cat and the dog of a house to be in that place was on it for all by now"
    rows = [(1, good), (2, " ".join(f"{w}#" for w in good.split())), (3, good.upper().replace(" ", "!! "))]
    out = {r.doc_id: r for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].kept and "symbol_ratio" in out[2].failed_rules and "bang_ratio" in out[3].failed_rules


def test_empty_table_and_repeated_rows(spark):
    assert Q.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert Q.quality(spark.createDataFrame([(1, "a")] * 3, "doc_id long, text string")).count() == 3


def test_no_python_in_the_plan(spark):
    df = Q.quality(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
