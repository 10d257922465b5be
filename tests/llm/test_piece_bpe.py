import random

import sentencepiece
from pyspark.sql import functions as F

from junctura.llm import piece_bpe as P


def texts():
    rnd = random.Random(5)
    odd = ["", " ", "  ", "a", "  a  b ", "\n", "\n\n \n a\r\n\tb", "▁x", " ▁▁ y", "\x00a", "</s> <s> <unk> <0x0A>", "日本語テスト 😀😀", "　x\xa0y", "ﬁ ½ é á", "x" * 700, "ab" * 900 + " c", " " * 300, "12345 678.90", "The quick brown fox", "don't  stop​"]
    alphabet = "abcdefghijklmnopqrstuvwxyzäöüñé   \n.,-0123456789ABC▁日😀"
    return odd + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 500))) for _ in range(150)] + ["thetionandere" * 60 + " ok"]


def test_equals_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=P.model_file())
    encoder = P.Encoder(P.PieceModel(P.model_file()))
    for group in (texts(), texts()[::-1]):
        flat, counts = encoder.encode(group)
        at = 0
        decoded = encoder.model.decode(flat, counts)
        for t, n, d in zip(group, counts, decoded, strict=True):
            ids = flat[at : at + n].tolist()
            at += n
            assert ids == sp.encode(t, add_eos=True), t[:80]
            assert d == sp.decode(ids), t[:80]


def test_heap_and_rounds_agree():
    model = P.PieceModel(P.model_file())
    words = ["▁thetionandere" * 9, "in" * 60, "aaab" * 30, "▁" * 77]
    for w, made in zip(words, model.encode_words(words), strict=True):
        assert made.tolist() == model._finish(model._by_heap([int(model.symbol_of[ord(c)]) for c in w])).tolist()


def test_long_words_in_parts_and_in_the_heap(monkeypatch):
    rnd = random.Random(6)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.model_file())
    words = ["".join(rnd.choices("abcdefghij", k=3000)), "".join(rnd.choices("日本語テスト😀ab", k=900)), "the" * 700, "w" * 2000, "q" * 64 + "x" * 65]
    model = P.PieceModel(P.model_file())
    assert all("".join(model.parts(w)) == w for w in words) and max(len(model.parts(w)) for w in words) > 1
    for part in (4096, 50):
        monkeypatch.setattr(P, "LONG_PART", part)
        flat, counts = P.Encoder(model).encode(words)
        cuts = [0, *counts.cumsum().tolist()]
        assert [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [sp.encode(w, add_eos=True) for w in words]


def test_operator(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.model_file())
    rows = [(i, t, "clash") for i, t in enumerate([None, *texts(), "a", "a", "the quick fox " * 20_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = {r.doc_id: r for r in P.encode_decode(df, P.model_file()).collect()}
    assert len(out) == len(rows)
    for i, t, _ in rows:
        assert out[i].ids == sp.encode(t or "", add_eos=True) and out[i].decoded == sp.decode(out[i].ids)
    assert P.encode_decode(df.filter(F.lit(False)), P.model_file()).count() == 0
