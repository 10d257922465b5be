import random

import sentencepiece

import corpus_pipeline as C
from junctura.llm import piece_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(4)
    kinds = {"en": ["th", "ing", "and", "ou", "er", "wh"], "de": ["ung", "sch", "ein", "ä", "keit", "pf"]}
    make = lambda lang, n: " ".join("".join(rnd.choices(kinds[lang], k=rnd.randrange(1, 4))) for _ in range(n))
    rows, passage = [], make("en", 120)
    for i in range(120):
        lang = ["en", "de"][i % 2]
        text = make(lang, rnd.randrange(60, 120))
        if i % 10 == 0:
            text += " " + passage
        rows.append([i, text, lang, f"src{i % 5}"])
    for i in range(6):  # copies and near copies
        base = rows[2 * i + 1][1].split()
        rows.append([200 + i, " ".join(base), "de", "src1"])
        base[len(base) // 2] = "sch"
        rows.append([300 + i, " ".join(base), "de", "src1"])
    rows += [[400, None, None, None], [401, "123 456", "en", "src0"], [402, "", "en", "src0"]]
    return [(*r, len(r[1] or "")) for r in rows], passage


def test_stages_and_run(spark, tmp_path):
    rows, passage = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    one = C.identify_language(spark, docs, "").cache()
    assert {r.doc_id for r in one.collect()} == {r[0] for r in rows} - {400, 401, 402}
    two = C.drop_near_duplicates(spark, one, "").cache()
    assert {r.doc_id for r in two.collect()} == set(range(120))
    three = C.drop_repeats(spark, two, "").cache()
    cut = {r.doc_id: r for r in three.collect()}
    assert len(cut) == 120 and not any(passage in r.text for r in cut.values()) and all(r.n_chars == len(r.text) for r in cut.values())
    assert all(cut[i].text == rows[i][1] for i in range(120) if i % 10)
    four = C.mix_sources(spark, three, "").cache()
    assert four.columns == list(C.COLUMNS) and 60 < four.count() <= 120
    out = C.run(spark, str(tmp_path)).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_file())
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in four.collect())
    assert all(r.ids == sp.encode(r.text, add_eos=True) and r.n_tokens == len(r.ids) for r in out)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
