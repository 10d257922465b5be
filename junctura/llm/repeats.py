"""Removal of repeated passages: every symbol covered by a string of `least` symbols that starts twice or more in the corpus.

Symbols are the bytes of a text or its words: with unit "byte" a repeat has at least `least` bytes (op2: LEAST), with
"word" at least `least` words (PASSAGE: over 50), whatever blanks stand between them; words are held as 64-bit hashes.
Several searches (least, unit) go through one scan and the same tables, column u telling them apart; their anchors have
hashes of their own.

Distribution: copies of a text are one text with a count. Each window of `least` symbols belongs to one anchor, the
leftmost least hash of a shorter string inside it, so equal windows have equal anchors at equal offsets. An anchor owns
a run of windows, its segment. Segments are dealt out by the anchor's hash; those whose anchor occurs once can hold no
repeat and fall away before any text is moved. Equal segments are combined to one with a count, so that thousands of
places of one passage cost one row.

Search: the different segments of an anchor's group meet in one task, whose segments form one text. Its suffixes are
sorted to `least` symbols, and breadth-first backward extension on the Burrows-Wheeler transform finds all common
prefixes by increasing length: an interval of suffixes that share a string is extended to the left by each symbol
before it, and the borders that are new at this length have a common prefix of exactly that length. It stops at
`least`; borders without a value then join windows that share `least` symbols. Work is on runs of the transform, so
groups of copies cost few steps.

The suffixes of a group with more than GROUP different segments are split into ranges that each can hold all equal
windows: by the offset of the anchor and by the symbols that all windows of the range share. Ranges narrow until GROUP
segments are left, and are then searched; equal segments meet on the way and are combined. At one offset that key is the
whole window; no group is left out or cut. Strings are compared by 64-bit hashes when they are combined.

Cases: a null text is empty. Texts under `least` symbols keep all. Equal rows, even with equal ids, repeat each other,
so of copies none is kept. Further columns are carried along by remove_repeats().
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, pieces_of, small_batches, spread, staged_alone

NAME = "op2_repeats"
#: Least bytes of a repeat, least words of a passage, and most symbols of an anchor's hash.
LEAST, PASSAGE, GRAM = 400, 51, 128
#: Different segments of one anchor that meet in one task; larger groups are split by offset.
GROUP = 1024
#: Symbols of the segments that are searched at once, unless one group has more.
CHUNK = 1_000_000
#: The searches of the query; remove_repeats() takes one.
SEARCHES = ((LEAST, "byte"), (PASSAGE, "word"))
EMPTY_SHA = sha256(b"").hexdigest()

_RND = np.random.default_rng(2)
_TABLE = _RND.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
#: Sets the anchors of one search apart from the next one's.
_SALT = 0x2545F4914F6CDD1D
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _sizes(least: int) -> tuple[int, int]:
    """Symbols of an anchor's hash, and the number of offsets it can have in a window."""
    gram = min(GRAM, (least + 1) // 2)
    return gram, least - gram + 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substrings of an array of symbols, from prefix sums."""

    _powers: tuple = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def __init__(self, symbols: np.ndarray):
        n = len(symbols) + 1
        if len(Hashes._powers[0]) < n:
            up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            Hashes._powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, self.down = Hashes._powers
        self.total = np.zeros(n, np.uint64)
        np.cumsum((_TABLE[symbols] if symbols.dtype == np.uint8 else symbols) * up[: n - 1], out=self.total[1:])

    def of(self, a, b) -> np.ndarray:
        return _mix((self.total[b] - self.total[a]) * self.down[a])


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    blank = _SPACE[np.frombuffer(raw + b" ", np.uint8)]
    before = np.r_[True, blank[:-1]]
    return np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)


def symbols_of(raw: list[bytes], unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in one array, and the number of each text's."""
    if unit == "byte":
        return np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
    flat = b"\n".join([*raw, b""])
    first, last = word_places(flat)
    borders = np.cumsum([0] + [len(r) + 1 for r in raw])
    return Hashes(np.frombuffer(flat, np.uint8)).of(first, last) | np.uint64(1), np.diff(np.searchsorted(first, borders))


def _dtype(unit: str):
    return np.uint8 if unit == "byte" else np.uint64


def anchors(symbols: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> list[tuple]:
    """For each of the texts, arrays q (anchor), lo and hi (offsets q - start of its windows), key and th."""
    gram, span = _sizes(least)
    empty = (np.zeros(0, np.int32), np.zeros(0, np.int16), np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not (lengths >= least).any():
        return [empty] * len(lengths)
    n, hashes = len(symbols), Hashes(symbols)
    grams = _mix((hashes.total[gram:] - hashes.total[:-gram]) * hashes.down[: n - gram + 1])
    bits = np.uint64(n.bit_length())
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(packed) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(packed)] = packed
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(back[: n - least + 1], ahead[span - 1 : span + n - least])
    starts = np.cumsum(lengths) - lengths
    owned = np.maximum(lengths - least + 1, 0)
    p = spread(starts, owned)
    q = (lowest[p] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    last = np.r_[first[1:], len(q)] - 1
    anchor, hi, lo = q[first], q[first] - p[first], q[first] - p[last]
    th = _mix(hashes.of(p[first], p[last] + least) + (hi * 1024 + lo).astype(np.uint64))
    key = grams[anchor]
    cuts = np.searchsorted(p[first], np.r_[starts, n])
    out = []
    for i, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
        out.append((anchor[a:b] - starts[i], lo[a:b], hi[a:b], key[a:b].view(np.int64), th[a:b].view(np.int64)) if b > a else empty)
    return out


def suffix_order(symbols: np.ndarray, least: int) -> np.ndarray:
    """Suffixes of the symbols (from 1), the empty one first, sorted by their first least symbols or more."""
    n = len(symbols)
    bits = int(symbols.max(initial=1)).bit_length()
    depth = 63 // bits
    wide = np.zeros(n + depth + 1, np.uint64)
    wide[:n] = symbols
    key = np.zeros(n + 1, np.uint64)
    for j in range(depth):
        key = (key << np.uint64(bits)) | wide[j : j + n + 1]
    order = np.argsort(key, kind="stable")
    head = np.r_[True, key[order[1:]] != key[order[:-1]]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n + 1), 0))
    while depth < least:
        # only suffixes that still share their place with others are sorted again
        open_ = ~(head & np.r_[head[1:], True])
        at = np.flatnonzero(open_)
        if not len(at):
            break
        own = order[at]
        after = np.minimum(own + depth, n)
        composed = (rank[own] << 32) | rank[after]
        inner = np.argsort(composed, kind="stable")
        own, composed = own[inner], composed[inner]
        order[at] = own
        head[at] |= np.r_[True, composed[1:] != composed[:-1]]
        rank[own] = np.maximum.accumulate(np.where(head, np.arange(n + 1), 0))[at]
        depth *= 2
    return order


def common_prefix_classes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of an array of symbols, and for each place the class of suffixes that share least of them."""
    n = len(text)
    symbols = (text.astype(np.int64) if text.dtype == np.uint8 else np.unique(text, return_inverse=True)[1]) + 1
    size = int(symbols.max(initial=1)) + 1
    order = suffix_order(symbols, least)
    before = np.where(order > 0, symbols[order - 1], 0)
    by_symbol = np.argsort(before, kind="stable")
    back = np.empty(n + 1, np.int64)  # the place of the suffix one to the left
    back[by_symbol] = np.arange(n + 1)
    # runs of equal symbols in the transform, and the nearest runs of the same symbol
    run_start = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
    run_end = np.r_[run_start[1:], n + 1] - 1
    run_of = np.repeat(np.arange(len(run_start)), run_end - run_start + 1)
    char = before[run_start]
    by_char = np.argsort(char, kind="stable")
    same = char[by_char][1:] == char[by_char][:-1]
    end_before, start_after = np.full(len(char), -1), np.full(len(char), n + 1)
    end_before[by_char[1:][same]] = run_end[by_char[:-1][same]]
    start_after[by_char[:-1][same]] = run_start[by_char[1:][same]]
    border = np.zeros(n + 2, bool)
    border[0] = border[1] = border[n + 1] = True
    lb, rb = np.array([0]), np.array([n])
    for length in range(least):
        if length == 1:  # the empty suffix stands for an end mark, a string of its own
            lb, rb = np.r_[0, lb], np.r_[0, rb]
        if not len(lb):
            break
        a, b = run_of[lb], run_of[rb]
        runs, which = spread(a, b - a + 1), np.repeat(np.arange(len(lb)), b - a + 1)
        low, high = lb[which], rb[which]
        last = start_after[runs] > high
        last &= char[runs] > 0
        to = np.where(last, back[np.minimum(run_end[runs], high)], 0)
        new = last & ~border[to + 1]
        first = end_before[runs] < low
        whole = new & first
        into = [back[np.maximum(run_start[runs[whole]], low[whole])]]
        out = [to[whole]]
        rest = np.flatnonzero(new & ~first)
        if len(rest):  # the symbol has several runs in the interval: find its first
            heads = np.flatnonzero(first & ~last)
            name = which[heads] * size + char[runs[heads]]
            sort = np.argsort(name, kind="stable")
            found = heads[sort[np.searchsorted(name[sort], which[rest] * size + char[runs[rest]])]]
            into.append(back[np.maximum(run_start[runs[found]], low[found])])
            out.append(to[rest])
        lb, rb = np.concatenate(into), np.concatenate(out)
        border[rb + 1] = True
    return order, np.cumsum(border[: n + 1])


def repeated_windows(segments: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each segment, which of its windows occur twice or more in all segments."""
    lengths = np.array([len(s) for s in segments], np.int64)
    order, group = common_prefix_classes(np.concatenate(segments), least)
    starts, counts = np.cumsum(lengths) - lengths, lengths - least + 1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    own = group[place[spread(starts, counts)]]
    twice = np.bincount(own)[own] > 1
    ends = np.cumsum(counts)
    return [twice[e - c : e] for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]


def _true_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _scan(rows: DataFrame, searches: tuple) -> DataFrame:
    """doc_id, h, u, n_symbols and the anchors as arrays, for each search of rows (doc_id, h, text)."""
    schema = "doc_id long, h long, u int, n_symbols long, q array<int>, lo array<smallint>, hi array<smallint>, key array<long>, th array<long>"

    def run(batches):
        import pyarrow as pa

        kinds = (np.int32, np.int16, np.int16, np.int64, np.int64)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in pieces_of(texts, 700_000):
                raw = [(t or "").encode() for t in texts[a:b]]
                for u, (least, unit) in enumerate(searches):
                    symbols, lengths = symbols_of(raw, unit)
                    made = anchors(symbols, lengths, least)
                    borders = pa.array(np.r_[0, np.cumsum([len(m[0]) for m in made])].astype(np.int32))
                    flat = [np.concatenate([m[i] for m in made]).astype(k) for i, k in enumerate(kinds)]
                    flat[3] = flat[3] ^ np.int64(u * _SALT)
                    lists = [pa.ListArray.from_arrays(borders, pa.array(x)) for x in flat]
                    own = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.full(b - a, u, np.int32)), pa.array(lengths)]
                    yield pa.RecordBatch.from_arrays([*own, *lists], ["doc_id", "h", "u", "n_symbols", "q", "lo", "hi", "key", "th"])

    return rows.mapInArrow(run, schema)


def _segments(texts: DataFrame, wanted: DataFrame, searches: tuple) -> DataFrame:
    """The symbols of wanted segments (h, q, u, key, th, c, d, lo, hi): k0, t0, key, th, c, d, u, q (in seg), lo, hi, seg."""
    packed = wanted.groupBy("h").agg(F.collect_list(F.struct("q", "u", "key", "th", "c", "d", "lo", "hi")).alias("w"))

    def run(batches):
        for batch in batches:
            for text, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                for u, (least, unit) in enumerate(searches):
                    mine = [w for w in some if w["u"] == u]
                    symbols = symbols_of([raw], unit)[0] if mine else None
                    for k in range(0, len(mine), 2000):
                        yield _batch([(w["key"], w["th"], w["key"], w["th"], w["c"], w["d"], u, w["hi"], w["lo"], w["hi"], symbols[w["q"] - w["hi"] : w["q"] - w["lo"] + least].tobytes()) for w in mine[k : k + 2000]])

    return texts.join(packed, "h").select("text", "w").mapInArrow(run, _SEGMENT)


_SEGMENT = "k0 long, t0 long, key long, th long, c long, d long, u int, q int, lo int, hi int, seg binary"


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int64()] * 6 + [pa.int32()] * 4 + [pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 11
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SEGMENT.split(", ")])


def _search(segments: DataFrame, searches: tuple) -> DataFrame:
    """k0, t0, o1, o2: offset ranges of repeated windows, from whole groups of segments with one key."""

    def solve(rows: list, u: int):
        import pyarrow as pa

        least, unit = searches[u]
        kind = _dtype(unit)
        found = [(k0, t0, hi - b, hi - a) for (k0, t0, _, _, hi, _), flags in zip(rows, repeated_windows([np.frombuffer(r[5], kind) for r in rows], least), strict=True) for a, b in _true_runs(flags)]
        columns = zip(*found, strict=True) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["k0", "t0", "o1", "o2"])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if last is not None and (row[2] != last[0] or size >= CHUNK and row[3] != last[1]):
                    yield solve(rows, last[0])
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5]) // np.dtype(_dtype(searches[row[2]][1])).itemsize
                last = row[2:4]
        if rows:
            yield solve(rows, last[0])

    dealt = segments.select("k0", "t0", "u", "key", "hi", "seg").repartition("key").sortWithinPartitions("u", "key")
    return dealt.mapInArrow(run, "k0 long, t0 long, o1 int, o2 int")


def _narrowed(segments: DataFrame, widths: list[int], searches: tuple) -> DataFrame:
    """Segments cut into offset ranges of their search's width, keyed by the symbols that all windows of a range share."""

    def run(batches):
        for batch in batches:
            rows = []
            for k0, t0, key, _, c, _, u, q, lo, hi, seg in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                (least, unit), width = searches[u], widths[u]
                symbols, cuts = np.frombuffer(seg, _dtype(unit)), []
                hashes = Hashes(symbols)
                for bin_ in range(lo // width, hi // width + 1):
                    b0, b1 = bin_ * width, bin_ * width + width - 1
                    cuts.append((max(lo, b0), min(hi, b1), b0, b1))
                x = np.array(cuts, np.int64)
                shared = hashes.of(q - x[:, 2], q - x[:, 3] + least)
                whole = hashes.of(q - x[:, 1], q - x[:, 0] + least)
                keys = _mix(shared + np.array([key], np.int64).view(np.uint64) + x[:, 2].astype(np.uint64)).view(np.int64).tolist()
                ths = _mix(whole + (x[:, 1] * 1024 + x[:, 0]).astype(np.uint64)).view(np.int64).tolist()
                for (a, b, _, _), k, t in zip(cuts, keys, ths, strict=True):
                    rows.append((k0, t0, k, t, c, 0, u, b, a, b, symbols[q - b : q - a + least].tobytes()))
            yield _batch(rows)

    return segments.mapInArrow(run, _SEGMENT)


def text_hash(text: str = "text"):
    """The hash by which texts are told apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def repeated_spans(docs: DataFrame, text: str = "text", searches: tuple = SEARCHES[:1]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(the texts that occur in several rows and have least symbols or more: h, u; of the others those with repeats: h,
    text, spans; the tables they are read from, for discard()). h is text_hash(), u the place of the search; spans are
    array<struct<u, a, b>> of repeated ranges [a, b) of its symbols, which may overlap."""
    if len(searches) > 4:
        raise ValueError("at most four searches go through one scan")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    least = F.get(F.array(*[F.lit(n) for n, _ in searches]), F.col("u"))
    scan = staged_alone(_scan(rows, searches), "scan")
    copied = staged_alone(scan.filter(F.col("n_symbols") >= least).groupBy("h", "u").agg(F.count("*").alias("n"), F.min("doc_id").alias("least_id")).filter("n > 1").drop("n"), "copied")
    # an anchor's place and kind are one number where all anchors are dealt out, which is once
    every = scan.filter(F.size("q") > 0).select("h", "u", "doc_id", F.explode(F.arrays_zip("q", "lo", "hi", "key", "th")).alias("x"))
    at = F.shiftleft(F.col("x.q").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("x.hi").cast("long"), 17)).bitwiseOR(F.shiftleft(F.col("x.lo").cast("long"), 2)).bitwiseOR(F.col("u"))
    every = every.select("h", "doc_id", "x.key", "x.th", at.alias("at"))
    keys = staged_alone(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "keys")
    places = staged_alone(every.join(keys.hint("shuffle_hash"), "key", "left_semi"), "places")
    discard(scan, keys)
    bits = lambda shift, width: F.shiftright("at", shift).bitwiseAND((1 << width) - 1)
    unpacked = places.select("h", bits(0, 2).cast("int").alias("u"), "doc_id", bits(32, 31).cast("int").alias("q"), bits(2, 15).cast("smallint").alias("lo"), bits(17, 15).cast("smallint").alias("hi"), "key", "th")
    # of copies one is searched, a repeat within it or with another text needs no more; only now, as few anchors are left
    found = staged_alone(unpacked.join(copied, ["h", "u"], "left").filter("least_id is null or least_id = doc_id").drop("least_id"), "anchors")
    discard(places)
    # one row of each text; the rows that repeat an id and a text meet by the keys of the join
    first = found.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    texts = staged_alone(rows.join(first, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).select("h", "text"), "texts")

    kinds = staged_alone(found.groupBy("key", "th").agg(F.count("*").alias("c"), F.min("u").alias("u"), F.min("lo").cast("int").alias("lo"), F.min("hi").cast("int").alias("hi"), F.min(F.struct("h", "q")).alias("at")), "kinds")
    sizes = staged_alone(kinds.groupBy("key").agg(F.count("*").alias("d"), F.min("c").alias("least")).filter("d > 1 and least = 1").select("key", "d"), "sizes")
    results = kinds.filter("c > 1").select(F.col("key").alias("k0"), F.col("th").alias("t0"), F.col("lo").alias("o1"), F.col("hi").alias("o2"))
    wanted = kinds.join(sizes, "key").select("at.*", "u", "key", "th", "c", "d", "lo", "hi")
    segments = staged_alone(_segments(texts, wanted, searches), "segments")
    results = results.unionByName(staged_alone(_search(segments.filter(F.col("d") <= GROUP), searches), "searched"))
    hot, widths, spent = segments.filter(F.col("d") > GROUP), [_sizes(n)[1] for n, _ in searches], [segments]
    while not hot.isEmpty():
        widths = [-(-w // 4) for w in widths]
        cut = staged_alone(_narrowed(hot, widths, searches).drop("d"), "cut")
        kinds_ = staged_alone(cut.groupBy("key", "th").agg(F.sum("c").alias("all"), F.min(F.struct("k0", "t0")).alias("at")), "cut-kinds")
        sizes_ = staged_alone(kinds_.groupBy("key").agg(F.count("*").alias("d"), F.min("all").alias("least")).filter("d > 1 and least = 1").select("key", "d"), "cut-sizes")
        both = cut.join(kinds_, ["key", "th"])
        whole = staged_alone(both.filter("all > 1").select("k0", "t0", F.col("lo").alias("o1"), F.col("hi").alias("o2")), "cut-found")
        single = both.filter((F.col("at.k0") == F.col("k0")) & (F.col("at.t0") == F.col("t0"))).join(sizes_, "key")
        left = staged_alone(single.select(*[x.split()[0] for x in _SEGMENT.split(", ")]), "cut-segments")
        results = results.unionByName(whole).unionByName(staged_alone(_search(left.filter(F.col("d") <= GROUP), searches), "searched"))
        hot = left.filter(F.col("d") > GROUP)
        discard(*spent, cut, kinds_, sizes_)
        spent = [left]
    # one row for each kind of segment, so that its places meet no other row
    ranges = staged_alone(results.groupBy("k0", "t0").agg(F.collect_list(F.struct("o1", "o2")).alias("o")), "ranges")
    discard(sizes, kinds, *spent)
    placed = found.join(ranges, (F.col("key") == F.col("k0")) & (F.col("th") == F.col("t0"))).select("h", "u", "q", F.explode("o").alias("o"))
    own = placed.join(copied.select("h", "u"), ["h", "u"], "left_anti")
    spans = own.groupBy("h").agg(F.collect_list(F.struct("u", (F.col("q") - F.col("o.o2")).alias("a"), (F.col("q") - F.col("o.o1") + least).alias("b"))).alias("spans"))
    return copied.select("h", "u"), texts.join(spans, "h"), [copied, found, texts, ranges]


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union of the spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(touched: DataFrame, searches: tuple) -> DataFrame:
    """h, u, n_removed (bytes), n_spans, kept_sha256, rest (the remaining bytes as text; split characters fall away)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for h, text, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = text.encode()
                for u in sorted({x["u"] for x in spans}):
                    runs, at, parts = merged([x for x in spans if x["u"] == u]), 0, []
                    if searches[u][1] == "word":
                        first, last = word_places(raw)
                        runs = [(int(first[a]), int(last[b - 1])) for a, b in runs]
                    for a, b in runs:
                        parts.append(raw[at:a])
                        at = b
                    rest = b"".join([*parts, raw[at:]])
                    out.append((h, u, len(raw) - len(rest), len(runs), sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if rest.strip() else ""))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h", "u", "n_removed", "n_spans", "kept_sha256", "rest"])

    return touched.select("h", "text", "spans").mapInArrow(run, "h long, u int, n_removed long, n_spans long, kept_sha256 string, rest string")


def outcomes(docs: DataFrame, text: str = "text", searches: tuple = SEARCHES[:1]) -> DataFrame:
    """A staged row for each text that loses something by a search: h, u, n_removed, n_spans, kept_sha256, rest. Of a text that occurs
    in several rows all is lost; n_removed is null then, as it is the text's length."""
    copied, touched, tables = repeated_spans(docs, text, searches)
    whole = copied.select("h", "u", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY_SHA).alias("kept_sha256"), F.lit("").alias("rest"))
    out = staged_alone(_cut(touched, searches).unionByName(whole), "outcomes")
    discard(*tables)
    return out


def remove_repeats(docs: DataFrame, least: int = LEAST, unit: str = "byte") -> DataFrame:
    """docs with repeats of least symbols or more cut out of text; rows of which no word is left fall away.

    In words a cut runs from the first word's first byte to the last one's last, so that no character is split."""
    rest = outcomes(docs, searches=((least, unit),)).select(F.col("h").alias("__h"), "rest")
    joined = docs.withColumn("__h0", text_hash()).join(rest, F.col("__h0") == F.col("__h"), "left")
    return joined.filter("rest is null or rest <> ''").select(*[F.coalesce("rest", "text").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns at LEAST bytes, and text: the document without its passages of PASSAGE words or more."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    made = outcomes(docs, searches=SEARCHES)
    passages = made.filter("u = 1").select("h", F.col("rest").alias("passages_rest"))
    removed = made.filter("u = 0").drop("u", "rest")
    body = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", F.col("text").alias("__text"), text_hash().alias("h"), F.octet_length(body).cast("long").alias("n_bytes"))
    none = F.lit(0).cast("long")
    cut = F.col("kept_sha256").isNotNull()
    return sized.join(removed, "h", "left").join(passages, "h", "left").select(
        "doc_id", "n_bytes", F.when(cut, F.coalesce("n_removed", "n_bytes")).otherwise(none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", F.sha2(F.coalesce("__text", F.lit("")), 256)).alias("kept_sha256"), F.coalesce("passages_rest", "__text").alias("text"),
    )
