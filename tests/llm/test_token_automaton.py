import random

import pytest
import tokenizers

from junctura.llm import token_automaton as A

LIBRARY = tokenizers.Tokenizer.from_file(A.tokenizer_file())
SF = "/root/testdata/sf0.001"


def counted(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def texts_of(seed, n, letters="aabcdeestrvlm' ''!?.,129\n\t éß世界АΣσÀİ<|endoftext|>😀‍ॐि½²́"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [128, 7, 1])
def test_counts_equal_those_of_the_library(monkeypatch, chunk):
    monkeypatch.setattr(A, "CHUNK", chunk)
    texts = texts_of(chunk, 3000) + ["a" * n for n in range(40)] + ["ab" * 500, "xyz " * 400, "don't we'll they're i'm x'rx 'rr 'lx 'l 's's ''s", "ΑΣ ΣΑΣ", "<|ENDOFTEXT|>", "", None, " \n", "<|startoftext|>x<|endoftext|>y"]
    assert A.token_counts(A.tokenizer_of(A.tokenizer_file()), texts).tolist() == counted(texts)


def test_characters_new_to_this_python():
    texts = [f"{a}{chr(c)}{b}" for c in (0x1C89, 0x10D50, 0x1E5F1, 0xA7CB, 0x0378) for a, b in (("a", "b"), (".", "."), ("1", "2"), ("", ""))]
    assert A.token_counts(A.Tokenizer(A.tokenizer_file()), texts).tolist() == counted(texts)


def test_every_character_has_the_librarys_class():
    made, split = A.tokenizer_of(A.tokenizer_file()), LIBRARY.pre_tokenizer
    for c in [*range(1, 0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 11)]:
        if not made.unknown[c] and chr(c) not in A.CONTRACTIONS:
            words = len(split.pre_tokenize_str(f"a{chr(c)}a")), len(split.pre_tokenize_str(f".{chr(c)}."))
            want = A.LETTER if words[0] == 1 else A.OTHER if words[1] == 1 else A.NUMBER if words[0] == 3 else A.SPACE
            assert made.classes[c] == want, hex(c)


def test_the_scan_gives_each_chunk_its_first_state():
    import numpy as np

    scanner, rnd = A.Scanner(), np.random.default_rng(1)
    columns = rnd.integers(0, A.UNKNOWN, (5, 300)).astype(np.uint8)
    state, want = 0, []
    for chunk in columns.T:
        want.append(state)
        for c in chunk:
            state = scanner.next[state, c]
    assert scanner.first_states(columns).tolist() == want


def test_states_that_are_forgotten_and_pieces(monkeypatch):
    monkeypatch.setattr(A, "MAX_STATES", 50)
    monkeypatch.setattr(A, "PIECE", 100)
    texts = [*texts_of(9, 300), " ".join(texts_of(8, 40)), "q" * 900]
    assert A.token_counts(A.Tokenizer(A.tokenizer_file()), texts).tolist() == counted(texts)
    whole = "".join(A.pieces("ab " * 100 + "c" * 300 + " d", 10))
    assert whole == "ab " * 100 + "c" * 300 + " d"


def test_columns_and_empty_tables(spark):
    rows = [(1, "two words", "x", 5), (1, "two words", "x", 5), (None, None, None, None), (2, "", "y", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch string, n_tokens long")
    got = A.count_tokens(df, A.tokenizer_file())
    assert got.columns == ["doc_id", "text", "batch", "n_tokens"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "two words", "x", 2)] * 2 + [(None, None, None, 0), (2, "", "y", 0)]))
    assert A.count_tokens(df.limit(0), A.tokenizer_file()).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in A.query(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    n = counted([r.text for r in rows])
    assert len(got) == len(rows)
    for r, tokens in zip(rows, n, strict=True):
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), tokens, tokens > 2048)
