"""Ranked lexical search over a bit-sliced index of impacts.

The index is a table of postings in blocks: each task of the scan closes a block after a bounded number of documents or
bytes, puts its documents in the order of their ids and writes, for every term of the block, the places and frequencies
of the documents that hold it (one row a term and block, so no term has an unbounded row). Documents of all terms are
indexed, whatever the queries; N, L and the number of documents of each term are aggregates of that table.

A search joins the terms of its items to their weights and these to the postings, and deals blocks to groups, with the
items beside them. For a block the impacts of a term (its share of the score, a whole number) are cut into bitmaps, one a
bit; they are added to the sums of all items that hold the term by bitwise carry-save arithmetic, 64 documents at a time. The
sums of an item are bitmaps as well; its k best documents are found from the most significant slice down: with G sure of a place
and E tied so far, a slice s keeps E & s if G and E & s hold more than k documents, and else moves E & s to G and keeps the
rest of E. The first of what is still tied, in the order of ids, fill the last places. k rows an item and block remain to be ranked.

Memory in a task: one block's bitmaps for one group of items, of a fixed number. The items meet every block, as
the stated query set of a search; a larger set is dealt to more groups, of which each meets every block.

Cases: an empty table or no items give an empty result; a null text has no terms, and neither has one without matches; they
count nowhere and are never found. Very long texts are read whole, in pieces cut between terms. Each row is a document: rows
that repeat an id are ranked as documents of their own. A null id comes after others of equal score. Rows of the items that
are equal in id and text are one item; different texts under one id are ranked apart. Items without terms, or with terms
that no document holds, have no rows. Input columns besides ids and texts are of no consequence.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, small_batches, staged

NAME = "op12_lexical_search"
TOP = 20
#: A block is closed after so many documents, or so many bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 8192, 1 << 25
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 22
#: Items that meet a block at a time.
GROUP_ITEMS = 1024
#: The bytes of terms are 0-9, A-Z, a-z and those of characters beyond ASCII.
TERM_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lower case for A-Z, a blank for what separates terms.
FOLDED = bytes((b | 32 if 0x41 <= b <= 0x5A else b) if b in TERM_BYTES else 32 for b in range(256))
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

POSTINGS = "block long, term string, docs long, terms long, slots binary, counts binary, ids array<long>"


def terms_of(text: Column) -> Column:
    """The terms of a text, with repeats."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda x: x != "")


def _terms(raw: bytes):
    """Lists of the terms of a text, piece by piece."""
    folded, start = raw.translate(FOLDED), 0
    while len(folded) - start > PIECE and (cut := folded.find(b" ", start + PIECE)) >= 0:
        yield folded[start:cut].split()
        start = cut
    yield folded[start:].split()


class Block:
    """Documents of a task, up to the bounds of a block."""

    def __init__(self):
        self.ids, self.lengths, self.codes, self.number, self.bytes = [], [], [], {}, 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        raw, n = (text or "").encode(), 0
        for found in _terms(raw):
            number = self.number
            for t in set(found):
                number.setdefault(t, len(number))
            self.codes.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
            n += len(found)
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.bytes += len(raw)

    def full(self, most_bytes: int) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.bytes >= most_bytes

    def batches(self, block: int):
        """The block's rows: its documents under a null term (lengths as counts), then its terms."""
        import pyarrow as pa

        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i]))
        lengths = np.array(self.lengths, np.int64)[order]
        names = [f.split()[0] for f in POSTINGS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        head = [[block], [None], [int((lengths > 0).sum())], [int(lengths.sum())], [None], [lengths.tobytes()], [[self.ids[i] for i in order]]]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(head, kinds, strict=True)], names)
        if not self.number:
            return
        slot = np.empty(len(order), np.int64)
        slot[order] = np.arange(len(order))
        codes = np.concatenate(self.codes).astype(np.int64)
        keys, counts = np.unique(codes * BLOCK_DOCS + np.repeat(slot, self.lengths), return_counts=True)
        slots, counts = (keys % BLOCK_DOCS).astype(np.uint16), counts.astype(np.uint32)
        bounds = np.searchsorted(keys, np.arange(len(self.number) + 1) * BLOCK_DOCS)
        terms = list(self.number)
        for a in range(0, len(terms), 8192):
            part = bounds[a : a + 8193]
            n, first, last = len(part) - 1, part[0], part[-1]
            columns = [pa.array(np.full(n, block)), pa.array([t.decode() for t in terms[a : a + n]], pa.string()), pa.array(np.diff(part)), pa.array(np.add.reduceat(counts, part[:-1]).astype(np.int64))]
            for values in (slots, counts):
                offsets = pa.py_buffer(((part - first) * values.itemsize).astype(np.int32).tobytes())
                columns.append(pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(values[first:last].tobytes())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, kinds[-1])], names)


def build(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index of docs (doc_id, text), staged. A row with a term has the number of documents (docs) and occurrences (terms)
    in the block, and the documents' places and frequencies; a row without one has the block's documents with terms, their
    terms, the lengths of all documents, and their ids, in the order of places."""

    def run(batches):
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc_id, text)
                if block.full(block_bytes):
                    yield from block.batches(number)
                    number, block = number + 1, Block()
        if block.ids:
            yield from block.batches(number)

    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, POSTINGS), "index")


# ---- bit slices


def sliced(slots: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of 64 documents that hold an impact, and for each bit of the impacts a word for each of the groups."""
    words, at = np.unique(slots >> 6, return_inverse=True)
    dense = np.zeros(len(words) * 64, np.int64)
    dense[at * 64 + (slots & 63)] = impacts
    bits = int(impacts.max()).bit_length()
    planes = (dense[None, :] >> np.arange(bits)[:, None] & 1).astype(np.uint8)
    return words, np.packbits(planes, axis=1, bitorder="little").view(np.uint64)


class Sums:
    """The sums of items over a block's documents, as bit slices in carry-save form: the sum of an item and a document is that
    of the numbers whose bits are parts[b, item, group of 64 documents] and carries[b, ...]. A term changes both by a few
    operations over all bits at once; the carries run through the slices once, when a block is complete."""

    def __init__(self, items: int, docs: int, bits: int):
        self.shape = (items, -(-docs // 64))
        self.parts, self.carries = np.zeros((2, bits, *self.shape), np.uint64)

    def add(self, items: np.ndarray, words: np.ndarray, planes: np.ndarray, shift: int = 0) -> None:
        """Adds a term's planes, times 2 to the power of shift, to the items' sums."""
        whole = len(words) == self.shape[1]
        at = (slice(shift, None), items) if whole else (slice(shift, None), items[:, None], words)
        part, carry = self.parts[at], self.carries[at]
        own = planes[:, None, :]
        # the bits of a part, a carry and the term: their parity stays, their majority goes one bit up
        both = part & carry
        either = part ^ carry
        n = len(planes)
        both[:n] |= either[:n] & own
        either[:n] ^= own
        self.parts[at] = either
        carry[1:] = both[:-1]
        carry[0] = 0
        self.carries[at] = carry

    def slices(self) -> list[np.ndarray]:
        """The bits of the sums, the least first."""
        out, over = [], np.zeros(self.shape, np.uint64)
        for part, carry in zip(self.parts, self.carries, strict=True):
            half = part ^ carry
            out.append(half ^ over)
            over = part & carry | half & over
        return out

    def top(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place and sum of the k highest sums above 0 of each item, the first places of equal sums."""
        slices = self.slices()
        tied = np.bitwise_or.reduce(slices)
        sure = np.zeros(self.shape, np.uint64)
        for s in reversed(slices):
            with_bit = tied & s
            together = sure | with_bit
            crowded = (np.bitwise_count(together).sum(axis=1) > k)[:, None]
            sure, tied = np.where(crowded, sure, together), np.where(crowded, with_bit, tied & ~s)
        item, place = self._places(sure)
        more, at = self._places(tied)
        # the first ties of an item fill what it has left
        room = k - np.bitwise_count(sure).sum(axis=1).astype(np.int64)
        nth = np.arange(len(more)) - np.searchsorted(more, more)
        item, place = np.r_[item, more[nth < room[more]]], np.r_[place, at[nth < room[more]]]
        score = np.zeros(len(item), np.int64)
        for b, s in enumerate(slices):
            score |= (s[item, place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
        return item, place, score

    def _places(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        item, word = np.nonzero(chosen)
        bits = np.unpackbits(chosen[item, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return item[at], word[at] * 64 + bit


def impacts(weight: int, counts: np.ndarray, pace: np.ndarray) -> np.ndarray:
    """A term's share of the scores of documents with so many occurrences."""
    counts = counts.astype(np.int64)
    return weight * (1_000_000_000 * counts // (1000 * counts + 12 * pace))


# ---- search


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item (item_id, text)."""
    index_docs, index_terms = index.filter("term is null"), index.filter("term is not null")
    asked = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    asked = staged(asked.select("item_id", F.monotonically_increasing_id().alias("item"), terms_of(F.col("text")).alias("terms")).filter(F.size("terms") > 0), "items")
    # a block's number: the scan's partition in the upper bits, a count below
    lane, turn = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    n, total, blocks, lanes = index_docs.agg(F.sum("docs"), F.sum("terms"), F.count("*"), F.max(lane) + 1).first()
    count = asked.count()
    if not n or not count:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    df = index_terms.join(wanted, "term").groupBy("term").agg(F.sum("docs").alias("df"))
    weights = staged(df.select("term", F.floor(1000 * F.log((2.0 * F.lit(n) + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("weight")), "weights")
    # groups: blocks are dealt to parts, and the items, cut into sets of a bounded number, meet each part
    sets, parts = -(-count // GROUP_ITEMS), max(-(-blocks // 16), min(blocks, 256))
    part_of = F.pmod(turn * lanes + lane, F.lit(parts))
    each_set = F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))
    hits = index_terms.join(weights, "term").filter("weight > 0").select("block", "term", "weight", "slots", "counts")
    heads = index_docs.select("block", "counts", "ids")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = hits.select("block", F.lit(2).alias("kind"), "term", "weight", "slots", "counts", none("array<long>", "ids"), none("array<string>", "terms")).unionByName(
        heads.select("block", F.lit(1).alias("kind"), none("string", "term"), none("long", "weight"), none("binary", "slots"), "counts", "ids", none("array<string>", "terms"))
    )
    rows = rows.withColumn("part", part_of).withColumn("set", each_set)
    queries = asked.select(
        F.lit(-1).cast("long").alias("block"), F.lit(0).alias("kind"), none("string", "term"), F.col("item").alias("weight"), none("binary", "slots"), none("binary", "counts"),
        F.array("item_id").alias("ids"), "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("item"), F.lit(sets)).cast("int").alias("set"),
    )
    dealt = rows.unionByName(queries).repartitionById(sets * parts, (F.col("part") * sets + F.col("set")).cast("int")).sortWithinPartitions("part", "set", "block", "kind", "term")

    # no impact reaches a million times the weight of a term that one document holds
    most = asked.agg(F.max(F.size("terms"))).first()[0]
    bits = (most * 1_000_000 * int(1000 * math.log(2 * n + 2) + 1)).bit_length()
    if bits > 63:
        raise ValueError("an item has too many terms for 64-bit scores")

    def run(batches):
        import pyarrow as pa

        group, items, holders, block, pace, ids, sums = None, [], {}, None, None, None, None

        def found():
            at, place, score = sums.top(k)
            if not len(at):
                return
            numbers, names = np.array([i[0] for i in items], np.int64), [i[1] for i in items]
            columns = [pa.array(numbers[at]), pa.array([names[i] for i in at], pa.int64()), pa.array([ids[p] for p in place], pa.int64()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                part, which, at, kind = (c[i].as_py() for c in columns[:4])
                if (part, which) != group:
                    if sums is not None:
                        yield from found()
                    group, items, holders, sums = (part, which), [], {}, None
                if kind == 0:
                    for term in columns[9][i].as_py():
                        of = holders.setdefault(term, {})
                        of[len(items)] = of.get(len(items), 0) + 1
                    items.append((columns[5][i].as_py(), columns[8][i].as_py()[0]))
                elif kind == 1:
                    if sums is not None:
                        yield from found()
                    lengths, ids = np.frombuffer(columns[7][i].as_py(), np.int64), columns[8][i].as_py()
                    pace, sums = 100 - 25 + 25 * lengths * n // total, Sums(len(items), len(ids), bits)
                elif of := holders.get(columns[4][i].as_py()):
                    slots, counts = np.frombuffer(columns[6][i].as_py(), np.uint16).astype(np.int64), np.frombuffer(columns[7][i].as_py(), np.uint32)
                    words, planes = sliced(slots, impacts(columns[5][i].as_py(), counts, pace[slots]))
                    who, times = np.array(list(of), np.int64), np.array(list(of.values()), np.int64)
                    for bit in range(int(times.max()).bit_length()):
                        if len(those := who[times >> bit & 1 == 1]):
                            sums.add(those, words, planes, bit)
        if sums is not None:
            yield from found()

    order = ["part", "set", "block", "kind", "term", "weight", "slots", "counts", "ids", "terms"]
    best = dealt.select(*order).mapInArrow(run, "item long, item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    index = build(documents(spark, sf_dir))
    out = staged(search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "ranked")
    discard(index)
    return out


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ts FROM documents),
s AS (SELECT count(*) AS docs, sum(len(ts))::bigint AS total FROM d WHERE len(ts) > 0),
tf AS (SELECT r, doc_id, n, term, count(*)::bigint AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) x GROUP BY ALL),
df AS (SELECT term, count(*)::bigint AS df FROM tf GROUP BY term),
i AS (SELECT row_number() OVER () AS item, item_id, ts FROM (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ts FROM benchmark) y),
q AS (SELECT item, item_id, term, count(*)::bigint AS times FROM (SELECT item, item_id, unnest(ts) AS term FROM i) z GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * df + 1)))::bigint AS w FROM df, s),
p AS (SELECT item, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::bigint AS score FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY ALL)
SELECT item_id, rank::int AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) o WHERE rank <= {TOP}
"""
