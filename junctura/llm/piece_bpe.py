"""SentencePiece encoding and decoding of BPE models, by vectorised merge rounds.

The words of a batch that were not met before are laid out as one flat numpy array of symbols. A round looks up the
rank of every neighbouring pair, takes the least (rank, position) of each word by a segmented minimum, merges these
leftmost pairs of all words at once and compacts the array; words without a pair leave it. The model file gives pieces
and scores only.

Words can be treated apart because no piece holds a blank mark behind another character (checked on loading). For the
same reason a long word is cut wherever its two neighbouring characters stand side by side in no piece, as no merge can
cross such a place. A part that is still longer than LONG_PART symbols takes the same merges from a heap, since a round
for each of its merges would cost the square of its length: this is for runs of thousands of letters without a blank.

Cases: a null or empty text gives the end id alone and decodes to an empty text, and an empty table gives an empty one.
Very long texts are encoded whole, a few MB of them in a batch. Characters outside the vocabulary
become byte pieces. Repeated rows give equal rows. Columns named ids or decoded are replaced, others are carried along.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, pieces_of, small_batches, spread

NAME = "op5_sentencepiece"
MARK = "▁"
#: Words longer than this are cut where no piece can span, and parts longer than that go to the heap.
LONG_WORD, LONG_PART = 64, 4096
#: Words that a Python worker remembers at most; beyond it the memory starts afresh.
CACHE_WORDS = 200_000
NO_PAIR = np.int64(1) << 62


class PieceModel:
    """Vocabulary and pair table of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.eos = sp.eos_id()
        self.bytes_id = np.zeros(256, np.int64)
        special = set()
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.bytes_id[int(p[3:5], 16)] = i
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                special.add(i)
        normal = {p: i for i, p in enumerate(pieces) if i not in special}
        if any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in normal):
            raise ValueError("pieces across words are not supported")
        self.surface = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for b in range(256):
            self.surface[self.bytes_id[b]] = bytes([b])
        self.piece_len = np.array([len(s) for s in self.surface], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        # symbols: piece ids, then size + code point for characters without a piece
        self.size = size
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + size
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        scores = {p: sp.get_score(i) for p, i in normal.items()}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbol = lambda s: normal.get(s, size + ord(s) if len(s) == 1 else None)
        table = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbol(p[:cut]), symbol(p[cut:])
                if a is not None and b is not None:
                    table[(a << 21) | b] = (ranks[scores[p]], i)
        self.table = table
        self.joined = np.array(sorted({ord(p[k]) << 21 | ord(p[k + 1]) for p in normal for k in range(len(p) - 1)}), np.int64)
        self.keys = np.array(sorted(table), np.int64)
        found = [table[k] for k in self.keys.tolist()]
        self.rank = np.array([x[0] for x in found], np.int64)
        self.merged = np.array([x[1] for x in found], np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 21) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NO_PAIR >> 32), self.merged[at]

    def parts(self, word: str) -> list[str]:
        """The word cut wherever no piece holds the two characters at the cut."""
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = points[:-1] << 21 | points[1:]
        apart = self.joined[np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)] != pairs
        cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        split = [self.parts(w) if len(w) > LONG_WORD else [w] for w in words]
        flat = [x for ps in split for x in ps]
        made: list = [None] * len(flat)
        short = [i for i, x in enumerate(flat) if len(x) <= LONG_PART]
        symbols, owner = self._rounds([flat[i] for i in short])
        ids, owner = self._bytes(symbols, owner)
        cuts = np.searchsorted(owner, np.arange(len(short) + 1)).tolist()
        for k, i in enumerate(short):
            made[i] = ids[cuts[k] : cuts[k + 1]]
        for i, x in enumerate(flat):
            if made[i] is None:
                made[i] = self._finish(self._by_heap([int(self.symbol_of[ord(c)]) for c in x]))
        ends = np.cumsum([len(ps) for ps in split]).tolist()
        return [made[e - 1] if len(ps) == 1 else np.concatenate(made[e - len(ps) : e]) for e, ps in zip(ends, split, strict=True)]

    def _rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym, word = self.symbol_of[points], np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        rank = into = None
        while len(sym):
            if rank is None:
                rank, into = np.full(len(sym), NO_PAIR >> 32), np.zeros(len(sym), np.int64)
                same = np.flatnonzero(word[:-1] == word[1:])
                rank[same], into[same] = self._lookup(sym[same], sym[same + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), starts)
            live = best < NO_PAIR
            if not live.all():  # words without a pair leave
                stay = np.repeat(live, np.diff(np.r_[starts, len(sym)]))
                done_sym.append(sym[~stay])
                done_word.append(word[~stay])
                shift = np.cumsum(~stay)
                at = best[live] & 0xFFFFFFFF
                at -= shift[at]
                sym, word, rank, into = sym[stay], word[stay], rank[stay], into[stay]
            else:
                at = best & 0xFFFFFFFF
            if not len(sym):
                break
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = NO_PAIR >> 32
            sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
            at -= np.arange(len(at))  # one symbol less for each word before
            touched = np.unique(np.r_[at, at[at > 0] - 1])
            touched = touched[touched + 1 < len(sym)]
            joined = word[touched] == word[touched + 1]
            rank[touched[~joined]] = NO_PAIR >> 32
            touched = touched[joined]
            rank[touched], into[touched] = self._lookup(sym[touched], sym[touched + 1])
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _by_heap(self, sym: list[int]) -> np.ndarray:
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (hit := self.table.get((sym[i] << 21) | sym[j])):
                heap.append((hit[0], i, sym[i], sym[j], hit[1])) if not ready else heapq.heappush(heap, (hit[0], i, sym[i], sym[j], hit[1]))

        ready = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = merged, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([s for s in sym if s >= 0], np.int64)

    def _bytes(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become byte pieces."""
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym, owner
        coded = [chr(c - self.size).encode() for c in sym[odd].tolist()]
        times = np.ones(len(sym), np.int64)
        times[odd] = [len(c) for c in coded]
        ids, at = np.repeat(sym, times), np.cumsum(times) - times
        flat = self.bytes_id[np.frombuffer(b"".join(coded), np.uint8)]
        ids[spread(at[odd], times[odd])] = flat
        return ids, np.repeat(owner, times)

    def _finish(self, sym: np.ndarray) -> np.ndarray:
        return self._bytes(sym, np.zeros(len(sym), np.int64))[0]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids: surfaces joined, without the blank of the dummy prefix."""
        lengths = self.piece_len[ids]
        flat = self.piece_bytes[spread(self.piece_at[ids], lengths)].tobytes()
        total = np.r_[0, np.cumsum(lengths)]
        ends = np.cumsum(counts)
        out = []
        for a, b in zip((total[ends - counts]).tolist(), total[ends].tolist(), strict=True):
            a += flat[a : a + 1] == b" " and a < b
            out.append(flat[a:b].decode("utf-8", "replace"))
        return out


class Encoder:
    """Encodes texts word by word, remembering words."""

    #: Blank marks and the characters behind them; a line feed has no piece, so it stands alone.
    WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")

    def __init__(self, model: PieceModel):
        self.model, self.known, self.ids, self.fill = model, {}, np.zeros(1 << 16, np.int64), 0
        self.at, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _learn(self, words: list[str]) -> None:
        made = self.model.encode_words(words)
        lengths = np.array([len(x) for x in made], np.int64)
        k, n = len(self.known), int(lengths.sum())
        while len(self.ids) < self.fill + n:
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while len(self.at) < k + len(words):
            self.at, self.count = np.resize(self.at, 2 * len(self.at)), np.resize(self.count, 2 * len(self.count))
        self.ids[self.fill : self.fill + n] = np.concatenate(made)
        self.at[k : k + len(words)] = self.fill + np.cumsum(lengths) - lengths
        self.count[k : k + len(words)] = lengths
        self.fill += n
        self.known.update(zip(words, range(k, k + len(words)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, each text's closed by the end id, and the number of ids of each text."""
        split = [self.WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.__init__(self.model)
        if new := list({w for ws in split for w in ws} - self.known.keys()):
            self._learn(new)
        get = self.known.__getitem__
        codes = np.array([get(w) for ws in split for w in ws], np.int64)
        per_word = self.count[codes]
        flat = self.ids[spread(self.at[codes], per_word)]
        n_words = np.array([len(ws) for ws in split], np.int64)
        word_ends = np.r_[0, np.cumsum(per_word)][np.cumsum(n_words)]
        counts = np.diff(np.r_[0, word_ends])
        return np.insert(flat, word_ends, self.model.eos), counts + 1


def encode_decode(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all, if not given), ids array<int> with the end id, and decoded string."""
    columns = [c for c in (keep if keep is not None else df.columns) if c not in ("ids", "decoded")]
    source = df.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(PieceModel(model_path))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in pieces_of(texts, 2_000_000):
                flat, counts = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat.astype(np.int32)))
                decoded = pa.array(encoder.model.decode(flat, counts), pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(columns))], lists, decoded], [*columns, "ids", "decoded"])

    return source.mapInArrow(run, schema)


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    made = encode_decode(documents(spark, sf_dir), model_file(), keep=["doc_id"])
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
