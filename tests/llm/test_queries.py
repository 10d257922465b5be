"""The contracts' columns of queries that no SQL can express, against plain Python and the libraries."""

import re
import zlib
from hashlib import sha256

from junctura.llm import minhash_forest, piece_bpe, toxicity, transport_stream

SF = "/root/testdata/sf0.001"


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def test_pieces_equal_those_of_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_file())
    got = {r.doc_id: r for r in piece_bpe.query(spark, SF).collect()}
    for r in documents(spark):
        ids = [*library.encode(r.text or ""), library.eos_id()]
        hashes = sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), *hashes)


def test_toxic_rows_that_were_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.query(spark, sf).collect()}
    assert set(got) == {r.doc_id for r in documents(spark, sf)}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None and got[r.doc_id].held_out]
    hits = sum(got[r.doc_id].predicted and r.toxic for r in labels)
    assert hits >= 0.95 * sum(got[r.doc_id].predicted for r in labels) and hits >= 0.8 * sum(r.toxic for r in labels) > 0


def test_payloads_of_transport_streams(spark):
    got = {r.doc_id: r for r in transport_stream.query(spark, SF).collect()}
    for r in documents(spark):
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        o = got[r.doc_id]
        assert (o.n_bytes, o.payload_bytes, o.payload_sha256, o.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert o.media_bytes % 188 == 0 and re.fullmatch("[0-9a-f]{64}", o.media_sha256)


def test_components_of_near_copies(spark):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}

    sets = {r.doc_id: shingles(r.text) for r in documents(spark)}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_forest.query(spark, SF).collect()}
    assert got == {i: (len(s), label[i], label[i] == i) for i, s in sets.items()} and len(set(label.values())) < len(label)
