from junctura.llm import license_scan as L


GRAMS = {name: L.bigrams(L.normalised(t)) for name, t in L.TEMPLATES.items()}


def brute(text, threshold=L.THRESHOLD):
    units = (text or "").split("\n") + L.re.split(L.BLANK_LINE, text or "") + [text or ""]
    hits = []
    for u in units:
        a = L.bigrams(L.normalised(u))
        for name, b in GRAMS.items():
            if a and 2 * len(a & b) / (len(a) + len(b)) >= threshold:
                hits.append((-2 * len(a & b) / (len(a) + len(b)), name))
    return (min(hits)[1], -min(hits)[0], len(hits)) if hits else (None, 0.0, 0)


def texts():
    mit, apache = L.TEMPLATES["MIT-text"], L.TEMPLATES["Apache-2.0-header"]
    wrapped = "\n".join(" ".join(mit.split()[i : i + 8]) for i in range(0, len(mit.split()), 8))
    out = [None, "", "\n\n", "one", "All rights reserved.", "ALL   RIGHTS, reserved", "all rights", mit, wrapped, f"text\n\n{wrapped}\n \nmore text here", apache.replace("file", "work"), "ä ö " * 30]
    out += [f"some words of a text\n{t}\nand more" for t in L.TEMPLATES.values()] + ["Released under MIT License", "word " * 60_000]
    return out


def test_equals_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    out = {r.doc_id: (r.license, r.dice, r.n_hits) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    assert out == {i: brute(t) for i, t, _ in rows}
    assert out[4][0] == "All-Rights-Reserved" and out[9][0] == "MIT-text"


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "All rights reserved.")] * 3, "doc_id long, text string")
    assert L.scan(df).count() == 3 and L.scan(df.limit(0)).count() == 0
    assert {r.license for r in L.scan(df, templates={}).collect()} == {None}


def test_whole_licences_in_documents(spark):
    whole = {n: L.TEMPLATES[n] for n in ("Apache-2.0-text", "GPL-2.0-text", "GPL-3.0-text", "LGPL-2.1-text", "MPL-2.0-text", "CC0-1.0-text")}
    cut = {n: " ".join(w for i, w in enumerate(t.split()) if i % 40) for n, t in whole.items()}  # a word in forty is lost
    rows = [(n, t) for n, t in whole.items()] + [(n, t) for n, t in cut.items()] + [(n, f"A heading\n\n{t}\n\nand a last line") for n, t in whole.items()]
    got = L.scan(spark.createDataFrame(rows, "name string, text string"), keep=["name"]).collect()
    assert len(got) == 18 and all(r.license == r.name and r.dice >= 0.9 for r in got)
