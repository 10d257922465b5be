"""Token counts by finite-state transducers compiled from a word-level byte-pair tokenizer.

Two deterministic machines read a normalised text. The scanner (six states over ten classes of characters) marks where
the words of the tokenizer's pattern start. The counter reads the bytes of the words, the last byte of a word as a symbol
of its own, and each of its transitions is annotated with the change of the number of tokens of what has been read.

The counter's states: the merges of a prefix give it one last token, and a token v ends a prefix if and only if it spells
the end of it and v stays apart from the last token of what comes before (two neighbours stay apart if the merges of both
together give these two). So a state holds, for every place at which a token may still be under way, the node in the trie of
tokens, the last token before the place, and the number of tokens there less the number now. Equal states are one; states
and transitions are made when a text first reaches them and kept by the worker.

Texts are put together, a bounded number of characters at a time, and cut into chunks of fixed length which advance in
step, one gather a position for all chunks. A chunk of the scanner has a map from states to states, an element of the
finite monoid the classes generate; maps are composed along the chunks by a parallel prefix scan over the monoid's table,
which gives each chunk its first state. A chunk of the counter has a map that is constant behind the first end of a word,
as a word starts in the initial state: what lies behind is counted at once for all chunks, then the pieces before it from
the states that the chunks before have ended in. Counts are the sums of the annotations.

Special strings inside a text are one token each and split it, as is the tokenizer library's default. Characters that this
Python's Unicode tables do not know are normalised and classed by the library.

Cases: an empty table gives an empty one; null and empty texts, or white space alone, have no tokens. Very long texts are
read whole, cut at white space into pieces of bounded length (a longer run without white space stays whole). Repeated
rows give equal rows. An input column n_tokens is replaced, others are carried along.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches

NAME = "op11_token_counts"
TOKEN_LIMIT = 2048
#: Characters that are put together at a time.
PIECE = 1_000_000
#: Positions in a chunk.
CHUNK = 128
#: States a worker keeps; with more it starts anew, between two pieces.
MAX_STATES = 150_000
#: Symbols are bytes, and LAST + byte for the last byte of a word.
LAST = 256

SPACE, LETTER, NUMBER, OTHER, QUOTE, ALONE, R_OR_V, EL, EE, UNKNOWN = range(10)
#: White space as the tokenizer's patterns see it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The letters of the contractions 's 't 'm 'd 're 've 'll.
CONTRACTIONS = {"s": ALONE, "t": ALONE, "m": ALONE, "d": ALONE, "r": R_OR_V, "v": R_OR_V, "l": EL, "e": EE, "'": QUOTE}
LETTERS = (LETTER, ALONE, R_OR_V, EL, EE)


class Scanner:
    """Marks the starts of words: 's|'t|'re|'ve|'m|'ll|'d|letters|one number|neither letters, numbers nor white space."""

    FREE, WORD, SIGNS, QUOTED, AWAITS_E, AWAITS_L = range(6)

    def __init__(self):
        free, word, signs, quoted, awaits_e, awaits_l = range(6)
        n = 6
        self.next = np.zeros((n, UNKNOWN), np.uint8)
        # 1: a word starts here, 2: one started at the character before
        self.marks = np.zeros((n, UNKNOWN), np.uint8)
        for state in range(n):
            pending = 2 if state in (awaits_e, awaits_l) else 0
            for c in range(UNKNOWN):
                if c == SPACE:
                    to, mark = free, 0
                elif c in LETTERS:
                    to, mark = word, int(state not in (word, awaits_e, awaits_l))
                elif c == NUMBER:
                    to, mark = free, 1
                elif c == OTHER:
                    to, mark = signs, int(state not in (signs, quoted))
                else:
                    to, mark = (signs, 0) if state in (signs, quoted) else (quoted, 1)
                self.next[state, c], self.marks[state, c] = to, mark | pending
        for state, c, to in ((quoted, ALONE, free), (quoted, R_OR_V, awaits_e), (quoted, EL, awaits_l), (awaits_e, EE, free), (awaits_l, EL, free)):
            self.next[state, c], self.marks[state, c] = to, 0
        # the monoid of maps from states to states
        maps, order = {tuple(range(n)): 0}, [tuple(range(n))]
        for m in order:
            for c in range(UNKNOWN):
                made = tuple(int(self.next[s, c]) for s in m)
                if made not in maps:
                    maps[made] = len(order)
                    order.append(made)
        self.maps = np.array(order, np.uint8)
        self.step = np.array([[maps[tuple(int(self.next[s, c]) for s in m)] for c in range(UNKNOWN)] for m in order], np.uint16)
        self.product = np.array([[maps[tuple(b[s] for s in a)] for b in order] for a in order], np.uint16)

    def first_states(self, columns: np.ndarray) -> np.ndarray:
        """The state in which each chunk starts; columns holds the classes, a column a chunk."""
        maps = np.zeros(columns.shape[1], np.uint16)
        for row in columns:
            maps = self.step[maps, row]
        reach = 1
        while reach < len(maps):
            maps[reach:] = self.product[maps[:-reach], maps[reach:]]
            reach *= 2
        return np.r_[np.uint8(self.FREE), self.maps[maps[:-1], self.FREE]]

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character; the last one is white space."""
        n = -(-len(classes) // CHUNK)
        padded = np.zeros(n * CHUNK, np.uint8)
        padded[: len(classes)] = classes
        columns = np.ascontiguousarray(padded.reshape(n, CHUNK).T)
        state, marks = self.first_states(columns), np.empty_like(columns)
        for i, row in enumerate(columns):
            marks[i] = self.marks[state, row]
            state = self.next[state, row]
        marks = marks.T.reshape(-1)[: len(classes)]
        out = (marks & 1).astype(bool)
        out[:-1] |= marks[1:] > 1
        return out


class Counter:
    """The counting transducer of a vocabulary of merges, made state by state as texts need it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # byte-level vocabularies write a byte as a printable character: the printable bytes as themselves, the others from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        end = model["end_of_word_suffix"]

        def symbols(token: str) -> tuple[int, ...]:
            closed = token.endswith(end)
            out = [letters[c] for c in (token[: -len(end)] if closed else token)]
            return (*out[:-1], out[-1] + LAST) if closed else tuple(out)

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = model["vocab"]
        self.spelt: dict[int, tuple[int, ...]] = {}
        self.base: dict[int, int] = {}
        for token, i in ids.items():
            if token in ("<|startoftext|>", "<|endoftext|>"):
                continue
            self.spelt[i] = symbols(token)
            if len(self.spelt[i]) == 1:
                self.base[self.spelt[i][0]] = i
        self.rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(merges)}
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.inner = {0}
        nodes = 1
        for i, spelling in self.spelt.items():
            at = 0
            for s in spelling:
                self.inner.add(at)
                to = self.child.get(at << 9 | s)
                if to is None:
                    to = self.child[at << 9 | s] = nodes
                    nodes += 1
                at = to
            self.token_at[at] = i
        self.apart_known: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forgets all states; the initial one holds a token that may start here, none before it."""
        first = ((0, -1, 0),)
        self.states, self.number = [first], {first: 0}
        self.size, self.filled = 1 << 16, 0
        self._fresh()

    def _fresh(self) -> None:
        self.keys = np.full(self.size, -1, np.int64)
        self.to, self.change = np.zeros(self.size, np.int32), np.zeros(self.size, np.int16)
        self.shift = np.uint64(64 - self.size.bit_length() + 1)

    def merged(self, spelling) -> list[int]:
        """Tokens of a short run of symbols: the pair of least rank first, the leftmost of equal ones."""
        out, none = [self.base[s] for s in spelling], (1 << 60, -1)
        while len(out) > 1:
            (rank, new), at = min((self.rank.get((a, b), none), i) for i, (a, b) in enumerate(zip(out, out[1:], strict=False)))
            if new < 0:
                break
            out[at : at + 2] = [new]
        return out

    def apart(self, before: int, token: int) -> bool:
        """Whether a token can follow another one (-1: the start of a word)."""
        known = self.apart_known.get((before, token))
        if known is None:
            want = [token] if before < 0 else [before, token]
            known = self.merged([s for t in want for s in self.spelt[t]]) == want
            if len(self.apart_known) > 4 * MAX_STATES:
                self.apart_known.clear()
            self.apart_known[before, token] = known
        return known

    def transition(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the change of the number of tokens."""
        last, alive = None, []
        for node, before, count in self.states[state]:
            node = self.child.get(node << 9 | symbol, -1)
            if node < 0:
                continue
            if last is None and node in self.token_at and self.apart(before, self.token_at[node]):
                last, change = self.token_at[node], count + 1
            if node in self.inner:
                alive.append((node, before, count))
        if symbol >= LAST:
            return 0, change
        made = (*((node, before, count - change) for node, before, count in alive), (0, last, 0))
        number = self.number.get(made)
        if number is None:
            number = self.number[made] = len(self.states)
            self.states.append(made)
        return number, change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _put(self, keys: np.ndarray, to: np.ndarray, change: np.ndarray) -> None:
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[at] < 0
            # of several keys that want one place the last one written has it, the others go on
            self.keys[at[free]] = keys[left[free]]
            own = self.keys[at] == keys[left]
            self.to[at[own]], self.change[at[own]] = to[left[own]], change[left[own]]
            left, at = left[~own], (at[~own] + 1) & (self.size - 1)

    def _learn(self, keys: np.ndarray) -> None:
        made = [self.transition(int(k) >> 9, int(k) & 511) for k in keys]
        self.filled += len(keys)
        if 2 * self.filled > self.size:
            old = self.keys >= 0
            kept = self.keys[old], self.to[old], self.change[old]
            while 2 * self.filled > self.size:
                self.size *= 4
            self._fresh()
            self._put(*kept)
        self._put(keys, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int16))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the table of transitions, those new to it made first."""
        while True:
            at = self._slots(keys)
            found = self.keys[at]
            wrong = np.flatnonzero(found != keys)
            new = []
            while len(wrong):
                empty = found[wrong] < 0
                new.append(wrong[empty])
                wrong = wrong[~empty]
                at[wrong] = (at[wrong] + 1) & (self.size - 1)
                found[wrong] = self.keys[at[wrong]]
                wrong = wrong[found[wrong] != keys[wrong]]
            missing = np.concatenate(new) if new else wrong
            if not len(missing):
                return at
            self._learn(np.unique(keys[missing]))

    def _run(self, symbols, begin, end, state, changes) -> np.ndarray:
        """Runs lanes over [begin, end) from their states; fills changes and gives the last states."""
        order = np.argsort(begin - end, kind="stable")
        at, lengths, current = begin[order].copy(), (end - begin)[order], state[order].astype(np.int64)
        steps = int(lengths[0]) if len(lengths) else 0
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
        for n in active:
            here = at[:n]
            place = self._find(current[:n] << 9 | symbols[here])
            changes[here] = self.change[place]
            current[:n] = self.to[place]
            at[:n] += 1
        out = np.empty_like(current)
        out[order] = current
        return out

    def changes(self, symbols: np.ndarray) -> np.ndarray:
        """The annotation of the transition at each symbol; the sequence ends with a word."""
        if len(self.states) > MAX_STATES:
            self.clear()
        changes, n = np.zeros(len(symbols), np.int16), -(-len(symbols) // CHUNK)
        first, stop = np.arange(n) * CHUNK, np.minimum(np.arange(1, n + 1) * CHUNK, len(symbols))
        ends = np.flatnonzero(symbols >= LAST)
        chunk_of, at = np.unique(ends // CHUNK, return_index=True)
        # a chunk's head reaches up to its first word end; none: the whole chunk is head
        head = stop.copy()
        head[chunk_of] = ends[at] + 1
        after = np.full(n, -1, np.int64)
        after[chunk_of] = self._run(symbols, head[chunk_of], stop[chunk_of], np.zeros(len(chunk_of), np.int64), changes)
        waiting = np.arange(n)
        while len(waiting):
            before = np.where(waiting > 0, after[waiting - 1], 0)
            ready = waiting[before >= 0]
            made = self._run(symbols, first[ready], head[ready], before[before >= 0], changes)
            open_ = after[ready] < 0
            after[ready[open_]] = made[open_]
            waiting = waiting[before < 0]
        return changes


class Tokenizer:
    """Normalisation, scanner and counter of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.path, self.library = path, None
        self.scanner, self.counter = Scanner(), Counter(path)
        kinds = {"L": LETTER, "N": NUMBER, "C": OTHER}
        self.classes = np.array([UNKNOWN if (k := unicodedata.category(chr(c))) == "Cn" else kinds.get(k[0], OTHER) for c in range(0x110000)], np.uint8)
        self.unknown = self.classes == UNKNOWN
        for c in WHITE:
            self.classes[ord(c)] = SPACE
        for c, k in CONTRACTIONS.items():
            self.classes[ord(c)] = k

    def _library(self):
        if self.library is None:
            import tokenizers

            self.library = tokenizers.Tokenizer.from_file(self.path)
        return self.library

    def _learn_class(self, c: int) -> None:
        words = lambda s: len(self._library().pre_tokenizer.pre_tokenize_str(s))
        between_letters, between_signs = words(f"a{chr(c)}a"), words(f".{chr(c)}.")
        self.classes[c] = LETTER if between_letters == 1 else OTHER if between_signs == 1 else NUMBER if between_letters == 3 else SPACE

    def _points(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)

    def normalised(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if self.unknown[self._points(text)].any():
            return self._library().normalizer.normalize_str(text)
        # the letters of a word's end have no forms of their own
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text (texts without special strings)."""
        made = [self.normalised(t) for t in texts]
        joined = "\n".join(made) + "\n"
        points = self._points(joined)
        classes = self.classes[points]
        while (classes == UNKNOWN).any():
            for c in np.unique(points[classes == UNKNOWN]):
                self._learn_class(int(c))
            classes = self.classes[points]
        starts, spaces = self.scanner.starts(classes), classes == SPACE
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        # the number of bytes of each character, and the character of each byte by its first one
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        closes = ~spaces
        closes[:-1] &= starts[1:] | spaces[1:]
        ends = np.cumsum(sizes) - 1
        symbols = raw.astype(np.int64)
        symbols[ends[closes]] += LAST
        symbols = symbols[np.repeat(~spaces, sizes)]
        sums = np.r_[0, np.cumsum(self.counter.changes(symbols).astype(np.int64))] if len(symbols) else np.zeros(1, np.int64)
        # characters, then symbols, up to the end of each text
        reach = np.cumsum([len(t) + 1 for t in made])
        read = np.r_[0, np.cumsum(np.where(spaces, 0, sizes))][reach]
        return np.diff(np.r_[0, sums[read]])


def pieces(text: str, limit: int = PIECE):
    """A text in pieces of about limit characters, cut behind white space."""
    start = 0
    while len(text) - start > limit:
        cut = re.compile(f"[{WHITE}]").search(text, start + limit - 1)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def segments(tokenizer: Tokenizer, texts: list[str | None]):
    """(text's number, piece) of the parts between special strings; the number of special strings of each text."""
    out, specials = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        if "<|" in text:
            parts = tokenizer.cut.split(text)
            specials[i] = len(parts) - 1
        else:
            parts = [text]
        out += [(i, p) for part in parts if part for p in pieces(part)]
    return out, specials


_KEPT: dict[str, Tokenizer] = {}


def tokenizer_of(path: str) -> Tokenizer:
    """The worker's tokenizer of a file."""
    if path not in _KEPT:
        _KEPT[path] = Tokenizer(path)
    return _KEPT[path]


def token_counts(tokenizer: Tokenizer, texts: list[str | None]) -> np.ndarray:
    """The number of tokens of each text."""
    found, counts = segments(tokenizer, texts)
    group, size = [], 0
    for k, (i, piece) in enumerate(found):
        group.append((i, piece))
        size += len(piece)
        if size >= PIECE or k == len(found) - 1:
            np.add.at(counts, [g for g, _ in group], tokenizer.counts([p for _, p in group]))
            group, size = [], 0
    return counts


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all, if not given) and n_tokens long, by the tokenizer file at a path that workers can read."""
    columns = [c for c in (keep if keep is not None else df.columns) if c != "n_tokens"]
    source = df.select(*columns, F.col(text).alias("__text"))
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField("n_tokens", T.LongType())])

    def run(batches):
        import pyarrow as pa

        tokenizer = tokenizer_of(path)
        for batch in batches:
            counts = token_counts(tokenizer, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*columns, "n_tokens"])

    return source.mapInArrow(run, schema)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    made = count_tokens(docs, tokenizer_file(), keep=["doc_id", "n_bytes"])
    return made.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
