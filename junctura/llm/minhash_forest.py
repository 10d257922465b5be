"""Near-duplicate detection by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

Documents with equal shingle sets form a class; its least id stands for it. Every class representative has TREES
signatures of DEPTH MinHash values. Each tree is the table of its signatures in sorted order (one range-partitioned
sort for all trees); candidates of an entry are its neighbours with a common prefix of at least LEAST_DEPTH values. In
sparse regions that is everything that shares the least depth; in dense regions the nearest entries are those with the
longest common prefix, so the depth adapts to the region. Candidates at the border of two sort partitions are found
from the partitions' first and last entries.

Links are confirmed by Jaccard similarity of the full sets, in rounds. The first takes next neighbours. Each further
round sorts the entries with the components found so far, takes entries of one component in succession as one run, and
compares what lies at the borders of runs, NEIGHBOURS entries deep: a large group no longer fills the places beside an
entry. It takes only entries of regions of three or more, as both entries of a region of two have met. Rounds end when
one has confirmed nothing new.

The rounds are the quick way for regions of three or more; they follow only pairs whose sketches agree. What they leave
unmet there, an exact join settles, over all representatives that lie in such a region in some tree: shingles are
ordered by the number of those sets that hold them, rare ones first; two sets that reach the threshold share one of the
first n - ceil(0.75 n) + 1 of each, and at the first they share, what is left of both must suffice. Every pair that
passes, lies in two components and has not been tested is confirmed on the full sets. So a linked pair is missed only
if it shares the least depth in no tree, with a chance of about (1 - s**LEAST_DEPTH)**TREES at similarity s, under 2e-6
at 0.75: this is the forest's own approximation.

Cases: a null text and one without words have an empty set, no links, and stand alone as their own component. Equal
sets are always linked. Rows that repeat an id and text give equal rows. Of rows that repeat an id with different
texts, the set with the least hash is compared with others for that id; the further ones are linked to equal sets only.
Very long texts are read whole. Further columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, pieces_of, small_batches, staged
from .components import components

NAME = "op10_minhash_forest"
SHINGLE, PERCENT = 5, 75
TREES, DEPTH, LEAST_DEPTH = 16, 6, 2
#: Entries on each side of a border between components that are compared in each tree; the nearest have the longest
#: common prefixes.
NEIGHBOURS = 4
#: Share of equal two-bit sketches below which the rounds do not follow a pair of a crowded region: 0.8125 is expected at
#: the threshold, five standard deviations above. The exact join does not look at sketches.
LEAST_AGREEMENT = 0.61
#: Candidates of a representative that are confirmed before the rest.
FIRST = 2

_RND = np.random.default_rng(20)
_TABLE = _RND.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _RND.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RND.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RND.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    raw = [(t or "").encode().lower() for t in texts]  # bytes.lower() changes A-Z only
    flat = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    blank = _SPACE[flat]
    before = np.r_[True, blank[:-1]]
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(blank & ~before)
    n = len(flat)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[flat] * _powers(_BASE, n), out=total[1:])
    words = _mix((total[ends] - total[starts]) * _powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    borders = np.cumsum([0] + [len(r) + 1 for r in raw])
    cuts = np.searchsorted(starts, borders).tolist()
    full = max(0, len(words) - SHINGLE + 1)
    grams = np.zeros(full, np.uint64)
    for j in range(SHINGLE):
        grams += words[j : j + full] * _STEP[j]
    grams = _mix(grams)
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> bytes:
    """TREES * DEPTH MinHash values, four bytes each, most significant first."""
    best = np.full(TREES * DEPTH, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(shingles), 4096):
        x = shingles[a : a + 4096]
        best = np.minimum(best, ((x[None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    return (best >> np.uint64(32)).astype(">u4").tobytes()


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set; null if empty), sig."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pieces_of(texts, 1_000_000):
                sets = shingle_sets(texts[a:b])
                rows = [(len(s), set_hash(s), signature(s) if len(s) else None) for s in sets]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)]], ["doc_id", "n_shingles", "set_hash", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sig binary")


def sketch(sig: bytes) -> bytes:
    """The two lowest bits of each MinHash value."""
    return np.packbits(np.unpackbits(np.frombuffer(sig, np.uint8)[3::4, None], axis=1)[:, 6:]).tobytes()


def _near(trees: list[int], keys: list[bytes], ids: list[int], parts: list[int], sketches: list[bytes], own: int, lags: int):
    """Candidate pairs among sorted entries, only those whose later entry is at own or behind; and for each entry from
    own on, whether its region may hold three entries or more.

    Entries of one component in succession form a run. The first lags entries of a run meet the last lags entries
    before it; entries of one component never meet, nor, where a region may hold three or more, do those whose sketches
    differ too much."""
    n = len(ids)
    sig = np.frombuffer(b"".join(keys), np.uint8).reshape(n, DEPTH * 4)[:, : LEAST_DEPTH * 4]
    bits = np.frombuffer(b"".join(sketches), np.uint8).reshape(n, TREES * DEPTH // 4)
    tree, node, part = np.array(trees, np.int64), np.array(ids, np.int64), np.array(parts, np.int64)
    first = np.r_[True, (part[1:] != part[:-1]) | (tree[1:] != tree[:-1])]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    # what lies beyond the entries at hand counts as one of the region
    same = np.r_[True, True, (tree[1:] == tree[:-1]) & (sig[1:] == sig[:-1]).all(axis=1), True, True]
    here, after = same[1 : n + 1], same[2 : n + 2]
    crowded = (here & same[:n]) | (here & after) | (after & same[3 : n + 3])
    left, right = [], []
    for lag in range(1, lags + 1):
        i = np.flatnonzero((np.arange(n) >= own) & (np.arange(n) - start < lags) & (start >= lag))
        j = start[i] - lag
        near = (tree[i] == tree[j]) & (part[i] != part[j]) & (sig[i] == sig[j]).all(axis=1)
        i, j = i[near], j[near]
        x = np.unpackbits(bits[i] ^ bits[j], axis=1)
        near = ((x[:, ::2] | x[:, 1::2]).mean(axis=1) <= 1 - LEAST_AGREEMENT) | ~crowded[i]
        left.append(np.minimum(node[i], node[j])[near])
        right.append(np.maximum(node[i], node[j])[near])
    return np.concatenate(left), np.concatenate(right), crowded[own:]


def forest(reps: DataFrame) -> DataFrame:
    """The entries of all trees: tree, key, node, sketch, from reps (node, sig)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sketch(x) for x in batch.column(1).to_pylist()], pa.binary())], ["node", "sig", "sketch"])

    drawn = reps.select("node", "sig").mapInArrow(run, "node long, sig binary, sketch binary")
    keys = F.array(*[F.substring("sig", 1 + t * DEPTH * 4, DEPTH * 4) for t in range(TREES)])
    return drawn.select("node", "sketch", F.posexplode(keys).alias("tree", "key")).select(F.col("tree").cast("long").alias("tree"), "key", "node", "sketch")


def candidates(entries: DataFrame, lags: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct pairs a < b of neighbours among entries (tree, key, node, component, sketch) that lie in two
    components and may be similar; the entries of regions of three or more, without their components; the staged table
    both are read from)."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.select("tree", "key", "node", "component", "sketch").repartitionByRange(n, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    # what a later entry can still meet: a run's first entries and those before the run
    reach = 2 * lags
    names = ["a", "b", "part", "place", "tree", "key", "node", "component", "sketch"]

    def table(k: int, columns: dict):
        import pyarrow as pa

        kinds = dict(zip(names, [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.int64(), pa.binary()], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[x], kinds[x]) if x in columns else pa.nulls(k, kinds[x]) for x in names], names)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        tail: tuple[list, ...] = ([], [], [], [], [])
        head: tuple[list, ...] = ([], [], [], [], [])

        def border(rows, first: int):
            k = len(rows[0])
            return table(k, dict(zip(names[4:], rows, strict=True)) | {"part": [number] * k, "place": range(first, first + k)})

        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_pylist() for c in batch.columns]
            rows = [t + x for t, x in zip(tail, new, strict=True)]
            a, b, crowded = _near(*rows, own=len(tail[0]), lags=lags)
            if len(a):
                yield table(len(a), {"a": a, "b": b})
            at = np.flatnonzero(crowded).tolist()
            if at:
                yield table(len(at), {x: [c[i] for i in at] for x, c in zip(names[4:], new, strict=True) if x != "component"})
            if seen < reach:
                head = tuple((h + x)[:reach] for h, x in zip(head, new, strict=True))
            seen += len(new[0])
            tail = tuple(x[-reach:] for x in rows)
        if seen:
            yield border(head, 0)
        if seen > reach:
            k = min(reach, seen - reach)
            yield border(tuple(x[-k:] for x in tail), reach)

    found = staged(ordered.mapInArrow(run, "a long, b long, part long, place long, tree long, key binary, node long, component long, sketch binary"), "neighbours")

    def seam(batches):
        import pyarrow as pa

        # the borders of all partitions in order: 2 * reach entries each
        rows: list = []
        for batch in batches:
            rows += zip(*[c.to_pylist() for c in batch.columns], strict=True)
            if len(rows) > 20_000:
                a, b, _ = _near(*[list(c) for c in zip(*rows, strict=True)], own=0, lags=lags)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                rows = rows[-reach:]
        if rows:
            a, b, _ = _near(*[list(c) for c in zip(*rows, strict=True)], own=0, lags=lags)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # the filter runs on all partitions; only the borders meet in one task
    borders = found.filter("part is not null").repartition(1).sortWithinPartitions("part", "place").select("tree", "key", "node", "component", "sketch").mapInArrow(seam, "a long, b long")
    pairs = found.filter("a is not null").select("a", "b").unionByName(borders).distinct()
    return pairs, found.filter("tree is not null and part is null").select("tree", "key", "node", "sketch"), found


def set_hash(shingles: np.ndarray) -> bytes | None:
    return blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def sets_of(docs: DataFrame, ids: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and shingles (sorted 64-bit values as bytes) of the documents in ids; of several sets that with the least hash."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pieces_of(texts, 1_000_000):
                sets = shingle_sets(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([set_hash(s) for s in sets], pa.binary())], ["doc_id", "shingles", "set_hash"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(ids.hint("merge"), "doc_id", "left_semi")
    made = chosen.mapInArrow(run, "doc_id long, shingles binary, set_hash binary").filter("set_hash is not null")
    return made.groupBy("doc_id").agg(F.min_by("shingles", "set_hash").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= PERCENT * union of their full sets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                u, v = (u, v) if len(u) <= len(v) else (v, u)
                if 100 * len(u) < PERCENT * len(v):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both = int((v[at] == u).sum())
                keep.append(100 * both >= PERCENT * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    one, two = sets.withColumnsRenamed({"doc_id": "a", "shingles": "x"}), sets.withColumnsRenamed({"doc_id": "b", "shingles": "y"})
    return pairs.select("a", "b").join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def unmet(sets: DataFrame, found: DataFrame) -> DataFrame:
    """The distinct pairs a < b of sets (doc_id, shingles) that lie in two components of found (node, component) and can
    reach PERCENT by the prefix and position bounds; no pair that reaches it is left out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in pieces_of(raw):
                sizes = np.array([len(x) // 8 for x in raw[a:b]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.frombuffer(b"".join(raw[a:b]), np.int64))], ["node", "n", "shingle"])

    each = sets.mapInArrow(run, "node long, n long, shingle long")
    # counted before they are shuffled, so a shingle that very many hold is one row a partition
    counts = each.groupBy("shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    held = each.join(counts.hint("merge"), "shingle")
    listed = held.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("x"))
    # shingles that no other set holds come first and can meet nothing
    alone = F.col("n") - F.size("x")
    first = F.col("n") - F.expr(f"({PERCENT} * n + 99) div 100") + 1
    cut = listed.select("node", "n", alone.alias("alone"), F.slice("x", F.lit(1), F.greatest(first - alone, F.lit(0)).cast("int")).alias("x"))
    prefix = cut.select("node", "n", "alone", F.posexplode("x").alias("place", "x")).select("node", "n", F.col("x.shingle").alias("shingle"), (F.col("n") - F.col("alone") - F.col("place")).alias("left"))
    named = staged(prefix.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "prefixes")
    mixed = named.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("shingle")
    # sizes in a ratio of at least PERCENT lie in one bin or in two that touch
    sized = named.join(mixed.hint("merge"), "shingle", "left_semi").withColumn("bin", F.floor(F.log("n") / float(np.log(100 / PERCENT + 0.01))))
    one = sized.select("shingle", "bin", *[F.col(x).alias(f"{x}1") for x in ("node", "n", "left", "component")])
    two = sized.select("shingle", F.explode(F.array(*[F.col("bin") + k for k in (-1, 0, 1)])).alias("bin"), *[F.col(x).alias(f"{x}2") for x in ("node", "n", "left", "component")])
    apart = (F.col("node1") < F.col("node2")) & (F.col("component1") != F.col("component2"))
    enough = (100 + PERCENT) * F.least("left1", "left2") >= PERCENT * (F.col("n1") + F.col("n2"))
    alike = 100 * F.least("n1", "n2") >= PERCENT * F.greatest("n1", "n2")
    met = one.hint("merge").join(two, ["shingle", "bin"]).filter(apart & enough & alike)
    return met.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in two components of found (node, component)."""
    ca, cb = found.withColumnsRenamed({"node": "a", "component": "ca"}), found.withColumnsRenamed({"node": "b", "component": "cb"})
    both = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components of found (node, component) with further links (a, b)."""
    if links.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b")))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    made = staged(signatures(docs, text), "signatures")
    some = made.filter("set_hash is not null")
    classes = staged(some.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    own = some.join(classes.select(F.col("node").alias("doc_id"), F.col("set_hash").alias("h")).hint("merge"), "doc_id").filter("set_hash = h")
    reps = staged(own.groupBy(F.col("doc_id").alias("node")).agg(F.min_by("sig", "set_hash").alias("sig")), "representatives")
    pairs, crowded, first = candidates(forest(reps).withColumn("component", F.col("node")), 1)
    pairs = staged(pairs, "pairs")
    # a few pairs of each representative, spread by a hash; the order has no bearing on the result
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b"), "a"))
    ranked = staged(pairs.select("a", "b", rank.alias("rank")), "ranked")
    sets = staged(sets_of(docs, ends(pairs), text), "sets")
    links = staged(confirmed(ranked.filter(F.col("rank") <= FIRST), sets), "links")
    found = components(links)
    more = staged(confirmed(between(ranked.filter(F.col("rank") > FIRST), found), sets), "more")
    discard(sets, ranked, links, reps)
    found, tested, spent = merged(found, more), pairs.select("a", "b"), [pairs]
    while True:
        labelled = crowded.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        met, _, read = candidates(labelled)
        pairs = staged(met.join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        discard(read)
        spent.append(pairs)
        tested = tested.unionByName(pairs.select("a", "b"))
        sets = staged(sets_of(docs, ends(pairs), text), "sets")
        links = staged(confirmed(pairs, sets), "links")
        discard(sets)
        if links.isEmpty():
            break
        found = merged(found, links)
    sets = staged(sets_of(docs, crowded.select(F.col("node").alias("doc_id")).distinct(), text), "crowded-sets")
    pairs = staged(unmet(sets, found).join(tested.hint("merge"), ["a", "b"], "left_anti"), "unmet")
    found = merged(found, staged(confirmed(pairs, sets), "last-links"))
    discard(sets, pairs, first, *spent)
    # of sets that share an id only the compared one, with the least hash, takes the id's component
    compared = Window.partitionBy("node").orderBy("set_hash")
    named = classes.withColumn("__r", F.row_number().over(compared)).join(found, "node", "left")
    linked = staged(named.select("set_hash", F.coalesce(F.when(F.col("__r") == 1, F.col("component")), "node").alias("component")), "named")
    discard(classes)
    out = made.drop("sig").join(linked.hint("merge"), "set_hash", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
