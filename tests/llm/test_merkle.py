import random
import zlib
from hashlib import sha256

import duckdb
from pyspark.sql import functions as F

from junctura.llm import merkle as M

SF = "/root/testdata/sf0.001"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """The root, and each leaf's siblings as (left, right) texts."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, path in enumerate(paths):
            run, i = runs[at[k] // 8], at[k] % 8
            path.append(("".join(run[:i]), "".join(run[i + 1 :])))
            at[k] //= 8
        level = [h(*r) for r in runs]
    return level[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    fold = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    made = [(r, h(*map(field, r)), h(*map(field, (*r[:4], fold(r[4]))))) for r in rows]
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {lang: sorted((m for m in made if m[0][2] == lang), key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1])) for lang in langs}
    trees = {lang: tree([m[1] for m in g]) for lang, g in groups.items()}
    root, tops = tree([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for (r, leaf, other), path in zip(groups[lang], trees[lang][1], strict=True):
            folded = other if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf
            for left, right in path + top:
                folded = h(left, folded, right)
            out.append((r[0], leaf, trees[lang][0], root, h(*(x for step in path + top for x in step)), folded, folded == root))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    leaves = M.leaves_of(df.withColumn("pos", F.lit("clash")), tampered={"text": F.translate("text", M.UPPER, M.LOWER)}, when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    return sorted((tuple(r) for r in M.manifest(leaves).collect()), key=str)


def test_rows_of_every_shape(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, "a", ""]), rnd.choice([None, "", "en", "de", "é"]), rnd.choice([None, 7]), rnd.choice([None, "", "Ab É", "x:1-", "Z" * 5000])) for _ in range(150)]
    rows += [rows[0]] * 20 + [(5, "s", "alone", 1, "T")]
    assert run(spark, rows) == brute(rows)
    for n in (1, 8, 9):
        few = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
        assert run(spark, few) == brute(few)
    assert run(spark, []) == []


def test_more_rounds_than_one(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, "s", "en" if rnd.random() < 0.95 else "de", i, f"T{i}") for i in range(4700)]
    assert run(spark, rows) == brute(rows)  # two buckets of the one language
    assert len(M.build(M.numbered(M.leaves_of(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")), ["doc_id", "h"]))[0]) == 2


def test_query_against_the_levels_in_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    res = con.execute(M.ORACLE_SQL)
    names = [c[0] for c in res.description]
    want = sorted(res.fetchall())
    got = sorted(tuple(r) for r in M.query(spark, SF).select(*names).collect())
    assert got == want and len({r[-1] for r in got}) == 2


def test_texts_stay_where_they_are(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "T")], "doc_id long, source string, lang string, n_chars long, text string")
    plan = M.leaves_of(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
