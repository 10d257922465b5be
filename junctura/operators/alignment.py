"""Alignment kernels and clusters of alignments: small numpy helpers inside pandas functions over Spark's groups."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import BASES
from .checkpoints import stored


def local_score(a: str, b: str, match: int = 2, mismatch: int = -3, opening: int = 5, extending: int = 2) -> int:
    """Best local alignment score; a gap of n costs opening + (n - 1) * extending."""
    import numpy as np

    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    if not len(x) or not len(y):
        return 0
    steps = np.arange(len(y) + 1) * extending
    h, f, best = np.zeros(len(y) + 1, np.int64), np.full(len(y) + 1, -(10**6), np.int64), 0
    for c in x:
        f = np.maximum(h - opening, f - extending)
        g = np.zeros(len(y) + 1, np.int64)
        g[1:] = np.maximum(0, np.maximum(h[:-1] + np.where(y == c, match, mismatch), f[1:]))
        # gaps along the row: the best start to the left, by a running maximum
        run = np.maximum.accumulate(g + steps)[:-1] - opening + extending - steps[1:]
        g[1:] = np.maximum(g[1:], run)
        best = max(best, int(g.max()))
        h = g
    return best


def local_scores(a: str, windows, match: int = 2, mismatch: int = -3, opening: int = 5, extending: int = 2):
    """local_score of a with each row of a matrix of bytes, all rows side by side."""
    import numpy as np

    rows, m = windows.shape
    steps = np.arange(m + 1) * extending
    h, f, best = np.zeros((rows, m + 1), np.int32), np.full((rows, m + 1), -(10**6), np.int32), np.zeros(rows, np.int32)
    for c in a.encode():
        f = np.maximum(h - opening, f - extending)
        g = np.zeros((rows, m + 1), np.int32)
        g[:, 1:] = np.maximum(0, np.maximum(h[:, :-1] + np.where(windows == c, match, mismatch), f[:, 1:]))
        run = np.maximum.accumulate(g + steps, axis=1)[:, :-1] - opening + extending - steps[1:]
        g[:, 1:] = np.maximum(g[:, 1:], run)
        best = np.maximum(best, g.max(axis=1))
        h = g
    return best


def global_alignment(a: str, b: str, match: int = 1, mismatch: int = -2, opening: int = 5, extending: int = 2) -> tuple[float, str, str]:
    """Score and aligned strings of a global alignment; a gap of n costs opening + (n - 1) * extending, at an end nothing.

    Of equally good alignments the traceback takes pairs before gaps in b and those before gaps in a."""
    import numpy as np

    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    low = -(10**7)
    best, up, side = np.zeros((n + 1, m + 1), np.int64), np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low)
    for i in range(1, n + 1):
        up[i, 1:] = np.maximum(best[i - 1, 1:] - opening, up[i - 1, 1:] - extending)
        if m:
            up[i, m] = max(best[i - 1, m], up[i - 1, m])
        g = best[i].copy()
        g[1:] = np.maximum(best[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch), up[i, 1:])
        first, more = (0, 0) if i == n else (opening, extending)
        steps = np.arange(m + 1) * more
        # a gap along the row opens where no gap along it ends; opening twice never gains
        side[i, 1:] = np.maximum.accumulate(g + steps)[:-1] - first + more - steps[1:]
        best[i, 1:] = np.maximum(g[1:], side[i, 1:])
    i, j, p, q, state = n, m, [], [], "best"
    while i or j:
        if state == "best":
            if i and j and best[i, j] == best[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
                p.append(a[i - 1])
                q.append(b[j - 1])
                i, j = i - 1, j - 1
                continue
            state = "up" if i and (not j or best[i, j] == up[i, j]) else "side"
        if state == "up":
            first = opening if 0 < j < m else 0
            state = "best" if not j or up[i, j] == best[i - 1, j] - first else "up"
            i -= 1
            p.append(a[i])
            q.append("-")
        else:
            first = opening if 0 < i < n else 0
            state = "best" if not i or side[i, j] == best[i, j - 1] - first else "side"
            j -= 1
            p.append("-")
            q.append(b[j])
    return float(best[n, m]), "".join(reversed(p)), "".join(reversed(q))


#: Cells of the matrices of pairs that are aligned side by side.
CELLS = 1 << 24


def _by_shape(a: list[str], b: list[str], cells: int = CELLS):
    """(indices, codes of a's strings, codes of b's from the last to the first, lengths of both) of pairs whose strings have much
    the same two lengths, some at a time; a row of codes is one place of all of them. Shorter strings are filled up with codes
    that no letter has."""
    import numpy as np

    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        shapes.setdefault((-(-len(x) // 16) * 16, -(-len(y) // 16) * 16), []).append(i)

    def codes(strings, n, filler):
        return np.frombuffer("".join([s.ljust(n, filler) for s in strings]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), n).T

    for own in shapes.values():
        n, m = max(len(a[i]) for i in own), max(len(b[i]) for i in own)
        step = max(1, cells // ((n + m + 1) * (n + 1)))
        for k in range(0, len(own), step):
            some = own[k : k + step]
            x, y = [a[i] for i in some], [b[i] for i in some]
            sizes = lambda strings: np.fromiter(map(len, strings), np.int64, len(strings))
            yield some, np.ascontiguousarray(codes(x, n, "\ud800")), np.ascontiguousarray(codes(y, m, "\ud801")[::-1]), sizes(x), sizes(y)


def _scores(n: int, m: int, *costs: int):
    """(the type of scores of such strings, one that no path has)."""
    import numpy as np

    short = (n + m + 2) * max(map(abs, costs)) < 8000
    return (np.int16, -16000) if short else (np.int32, -(10**9))


#: Cells of the pairs that local_batch fills side by side; it holds a few diagonals of them, a byte or more a cell.
LOCAL_CELLS = 1 << 25


def _bytes(*codes):
    """Codes as bytes, if no letter needs more or has a code that a filler gets; else as they are."""
    if any(((c < 2) | ((c > 255) & (c >> 1 != 0xD800 >> 1))).any() for c in codes):
        return codes
    return [c.astype("uint8") for c in codes]


def local_batch(a: list[str], b: list[str], match: int = 2, mismatch: int = -3, opening: int = 5, extending: int = 2) -> list[int]:
    """local_score of each pair of strings, the matrices of many pairs filled side by side, one diagonal after another.

    Scores of short strings fit into a byte: none is over that of the shorter string with itself, none that counts is below
    the cost of a gap's start."""
    import numpy as np

    out = np.zeros(len(a), np.int64)
    for some, x, y, *ends in _by_shape(a, b, LOCAL_CELLS):
        (n, rows), m = x.shape, len(y)
        kind, low = _scores(n, m, match, mismatch, opening, extending)
        if (int(np.minimum(*ends).max()) + 1) * abs(match) + abs(mismatch) < 128 and max(abs(opening), abs(extending)) < 28:
            kind, low = np.int8, -100
        x, y = _bytes(x, y)
        more, other, first, further = kind(match - mismatch), kind(mismatch), kind(opening), kind(extending)
        # of the last two diagonals, by the place in a; the first row and column stay at 0
        h, h1, h2 = (np.zeros((n + 1, rows), kind) for _ in range(3))
        up, side, best = np.full((n + 1, rows), low, kind), np.full((n + 1, rows), low, kind), np.zeros((n + 1, rows), kind)
        opened, pair, same = np.empty((n + 1, rows), kind), np.empty((n + 1, rows), kind), np.empty((n + 1, rows), bool)
        zero = np.zeros((n + 1, rows), kind)  # numpy takes the maximum with a number much slower than with an array
        for d in range(2, n + m + 1):
            i, k = max(1, d - m), min(n, d - 1)
            if k < i:
                continue
            here, back, both = slice(i, k + 1), slice(i - 1, k), slice(i - 1, k + 1)
            got, now_up, now_side = pair[here], up[here], side[here]
            np.subtract(h1[both], first, out=opened[both])
            # a row's gap comes from the one above it on the diagonal before
            np.subtract(up[back], further, out=got)
            np.maximum(got, opened[back], out=now_up)
            np.subtract(now_side, further, out=now_side)
            np.maximum(now_side, opened[here], out=now_side)
            np.equal(x[back], y[m - d + i : m - d + k + 1], out=same[here])
            np.multiply(same[here].view(np.int8), more, out=got)
            np.add(got, other, out=got)
            np.add(got, h2[back], out=got)
            np.maximum(got, now_up, out=got)
            np.maximum(got, now_side, out=got)
            np.maximum(got, zero[here], out=h[here])
            np.maximum(best[here], got, out=best[here])
            # the cells of the edges
            h[0] = 0
            if d <= n:
                h[d], up[d], side[d] = 0, low, low
            h, h1, h2 = h2, h, h1
        out[some] = best.max(axis=0)
    return out.tolist()


#: Bits of a step back: one in a, one in b; the rest is the state after it (0: best, 1: gap in b, 2: gap in a).
_IN_A, _IN_B = 1, 2


def _step_table():
    """The step back for each state and cell: bit 1 for a pair, 2 for a gap in b, 4 and 8 for the start of a gap in b and in a,
    16 for the corner."""
    import numpy as np

    table = np.zeros((3, 32), np.uint8)
    for state in range(3):
        for cell in range(16):
            if state == 0 and cell & 1:
                table[state, cell] = _IN_A | _IN_B
            elif state == 1 or (state == 0 and cell & 2):
                table[state, cell] = _IN_A | (0 if cell & 4 else 1 << 2)
            else:
                table[state, cell] = _IN_B | (0 if cell & 8 else 2 << 2)
    return table.ravel()


def _steps_back(x, y, ends, match: int, mismatch: int, opening: int, extending: int):
    """Scores and the steps of global_alignment's traceback, from the last on (0 after the first), of pairs as _by_shape gives
    them; ends: the lengths of a's strings and of b's."""
    import numpy as np

    (n, rows), m = x.shape, len(y)
    kind, low = _scores(n, m, match, mismatch, opening, extending)
    more, other = kind(match - mismatch), kind(mismatch)
    h, h1, h2 = (np.zeros((n + 1, rows), kind) for _ in range(3))
    up, side = np.full((n + 1, rows), low, kind), np.full((n + 1, rows), low, kind)
    (last, width), every, total = ends, np.arange(rows), np.zeros(rows, np.int64)
    # by diagonal and place in a; at the edges only gaps lead back
    cells = np.full((n + m + 1, n + 1, rows), 2 | 4, np.uint8)
    cells[:, 0], cells[0, 0] = 8, 16
    for d in range(2, n + m + 1):
        i, k = max(1, d - m), min(n, d - 1)
        if k >= i:
            here, back = slice(i, k + 1), slice(i - 1, k)
            open_up, more_up = h1[back] - opening, up[back] - extending
            beyond = every[(d - width >= i) & (d - width <= k)]  # a gap beyond the end of b
            at = d - width[beyond]
            open_up[at - i, beyond], more_up[at - i, beyond] = h1[at - 1, beyond], up[at - 1, beyond]
            open_side, more_side = h1[here] - opening, side[here] - extending
            beyond = every[(last >= i) & (last <= k)]  # and one beyond the end of a
            at = last[beyond]
            open_side[at - i, beyond], more_side[at - i, beyond] = h1[at, beyond], side[at, beyond]
            up[here], side[here] = np.maximum(open_up, more_up), np.maximum(open_side, more_side)
            pair = np.multiply((x[back] == y[m - d + i : m - d + k + 1]).view(np.int8), more, dtype=kind)
            pair += other
            pair += h2[back]
            got = np.maximum(np.maximum(pair, up[here]), side[here], out=h[here])
            bits = (open_side >= more_side).view(np.uint8)
            for test in (open_up >= more_up, got == up[here], got == pair):
                bits += bits
                bits += test.view(np.uint8)
            cells[d, here] = bits
        h[0] = 0
        if d <= n:
            h[d], up[d], side[d] = 0, low, low
        done = every[last + width == d]
        total[done] = h[last[done], done]
        h, h1, h2 = h2, h, h1

    table, made = _step_table(), np.zeros((n + m, rows), np.uint8)
    step = np.arange(16)
    jump = (((step & _IN_A) + ((step & _IN_B) >> 1)) * (n + 1) + (step & _IN_A)) * rows
    after = ((step >> 2) * 32).astype(np.uint8)
    flat, at, state = cells.ravel(), ((last + width) * (n + 1) + last) * rows + every, np.zeros(rows, np.uint8)
    for t in range(n + m):
        one = table[state + flat[at]]
        if not one.any():
            break
        made[t] = one & 3
        at -= jump[one]
        state = after[one]
    return total, made


def global_batch(a: list[str], b: list[str], match: int = 1, mismatch: int = -2, opening: int = 5, extending: int = 2) -> list[tuple[float, str, str]]:
    """global_alignment of each pair of strings: matrices of many pairs side by side, and their tracebacks step by step."""
    import numpy as np

    out: list = [None] * len(a)
    for some, x, y, *ends in _by_shape(a, b):
        total, made = _steps_back(x, y, ends, match, mismatch, opening, extending)
        told = []
        for codes, size, bit in ((x[::-1], ends[0], _IN_A), (y, ends[1], _IN_B)):
            used = (made & bit) > 0
            letters = np.where(made > 0, np.uint32(ord("-")), np.uint32(0))
            if len(codes):
                place = np.minimum(np.cumsum(used, axis=0) - used + len(codes) - size, len(codes) - 1)
                letters = np.where(used, np.take_along_axis(codes, place, axis=0), letters)
            told.append([row.tobytes().decode("utf-32-le").replace("\0", "") for row in np.ascontiguousarray(letters[::-1].T)])
        for index, score, p, q in zip(some, total.tolist(), *told, strict=True):
            out[index] = (float(score), p, q)
    return out


def runs_batch(a: list[str], b: list[str], match: int = 1, mismatch: int = -2, opening: int = 5, extending: int = 2):
    """homology_run and inserted_run, as two arrays, of the global alignment of each pair of strings without "-"; no aligned
    string is made."""
    import numpy as np

    homology, inserted = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
    for some, x, y, *ends in _by_shape(a, b):
        _, made = _steps_back(x, y, ends, match, mismatch, opening, extending)
        run, gap, most, widest = (np.zeros(len(some), np.int32) for _ in range(4))
        based = np.zeros(len(some), bool)  # a base of b lies to the right, the last column left out
        for t, one in enumerate(made):
            run = (run + 1) * (one == (_IN_A | _IN_B))
            np.maximum(most, run, out=most)
            if t:
                base = (one & _IN_B) > 0
                np.maximum(widest, gap * base, out=widest)
                gap = (gap + based) * (one == _IN_A)
                based |= base
        homology[some], inserted[some] = most, widest
    return homology, inserted


@F.pandas_udf(T.DoubleType())
def local_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Local score over the first string's length: 0 to 2; 0 for a missing or empty string."""
    x, y = a.fillna("").tolist(), b.fillna("").tolist()
    return pd.Series([s / len(p) if p else 0.0 for p, s in zip(x, local_batch(x, y), strict=True)], dtype=float)


#: As reverse_complement() replaces letters.
TURNED = str.maketrans(*BASES)


@F.pandas_udf(T.DoubleType())
def context_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The better similarity of two windows, either way round; the second one is turned here, as Spark's translate() makes a
    string of every letter."""
    x, y = a.fillna("").tolist(), b.fillna("").tolist()
    back = [s[::-1].translate(TURNED) for s in y]
    return pd.Series([max(s, r) / len(p) if p else 0.0 for p, s, r in zip(x, local_batch(x, y), local_batch(x, back), strict=True)], dtype=float)


@F.pandas_udf(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))
def aligned_pair(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Both strings of a global alignment."""
    return pd.DataFrame([found[1:] for found in global_batch(a.fillna("").tolist(), b.fillna("").tolist())], columns=["a", "b"], dtype=object)


def homology_run(a: str, b: str) -> int:
    """The longest run of columns of two aligned strings in which neither has a gap."""
    both = "".join(" " if "-" in pair else "x" for pair in zip(a, b, strict=True))
    return max(map(len, both.split()), default=0)


def inserted_run(reference: str) -> int:
    """The longest run of gaps in an aligned reference that lies between bases, the last column left out."""
    return max(map(len, re.findall("(?<=[^-])-+(?=[^-])", reference[:-1])), default=0)


@F.pandas_udf(T.StructType([T.StructField("homology", T.IntegerType()), T.StructField("inserted", T.IntegerType())]))
def junction_runs(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """homology_run of two aligned strings and inserted_run of the second one."""
    return pd.DataFrame([(homology_run(x or "", y or ""), inserted_run(y or "")) for x, y in zip(a, b, strict=True)], columns=["homology", "inserted"], dtype="int32")


@F.pandas_udf(T.StructType([T.StructField("homology", T.IntegerType()), T.StructField("inserted", T.IntegerType())]))
def aligned_runs(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """junction_runs of the aligned pair, in one step."""
    homology, inserted = runs_batch(a.fillna("").tolist(), b.fillna("").tolist())
    return pd.DataFrame({"homology": homology, "inserted": inserted})


def cluster_pairs(df: DataFrame, by: list[str], eps: int) -> DataFrame:
    """2-D single-linkage clusters (Euclidean, inclusive eps, every point counts) of (pos, mate_pos) within by.

    Points of a grid cell whose diagonal is within eps are one cluster, so cells are linked instead of points. Two cells
    are linked if a point of one lies within eps of one of the other; for that the outermost points of each row of a
    cell suffice if the other lies beside it, and those of each column if it lies above. However many points there are,
    a cell shows twice its width of them at most. The cluster's id is its least point id."""
    from .graph import connected_components

    width = max(1, int(eps / math.sqrt(2)))
    grid = ["__cx", "__cy"]
    placed = df.withColumn("__cx", F.floor(F.col("pos") / width)).withColumn("__cy", F.floor(F.col("mate_pos") / width))
    # the rows are read once for their distinct places, the rest needs these alone
    points = stored(placed.groupBy(*by, *grid, "pos", "mate_pos").agg(F.min("point").alias("point")))
    cells = stored(points.groupBy(*by, *grid).agg(F.min("point").alias("cell")))

    def outermost(line: str, along: str) -> DataFrame:
        ends = points.groupBy(*by, *grid, line).agg(F.min(along).alias("lo"), F.max(along).alias("hi"))
        return ends.select(*by, *grid, line, F.explode(F.array_distinct(F.array("lo", "hi"))).alias(along)).join(cells, [*by, *grid])

    def links(shown: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
        other = shown.select(*by, F.col("pos").alias("__px"), F.col("mate_pos").alias("__py"), F.col("cell").alias("__cell"), F.explode(F.array(*[F.struct((F.col("__cx") - i).alias("__cx"), (F.col("__cy") - j).alias("__cy")) for i, j in offsets])).alias("__c"))
        other = other.select(*by, "__px", "__py", "__cell", "__c.__cx", "__c.__cy")
        dx, dy = F.col("pos") - F.col("__px"), F.col("mate_pos") - F.col("__py")
        return shown.join(other, [*by, *grid]).filter(dx * dx + dy * dy <= eps * eps).select(F.col("cell").alias("src"), F.col("__cell").alias("dst")).distinct()

    reach = -(-(eps + 1) // width)
    beside = links(outermost("mate_pos", "pos"), [(i, j) for i in range(1, reach + 1) for j in range(-reach, reach + 1)])
    above = links(outermost("pos", "mate_pos"), [(0, j) for j in range(1, reach + 1)])
    found = connected_components(beside.unionByName(above)).select(F.col("node").alias("cell"), "component")
    named = cells.join(found, "cell", "left").select(*by, *grid, F.coalesce("component", "cell").alias("cluster"))
    return placed.join(named, [*by, *grid]).drop(*grid)


def raw_clusters(points: DataFrame, by: list[str]) -> DataFrame:
    """Summary of clustered discordant pairs: pos1 is the least start of a reverse read's cluster, else the greatest,
    likewise pos2; reverse holds if both reads have one direction."""
    side = lambda pos, rev: F.when(F.first(rev), F.min(pos)).otherwise(F.max(pos))
    return points.groupBy(*by, "cluster").agg(
        side("pos", "is_reverse").alias("pos1"), F.min("pos").alias("left1"), F.max("pos").alias("right1"),
        side("mate_pos", "mate_is_reverse").alias("pos2"), F.min("mate_pos").alias("left2"), F.max("mate_pos").alias("right2"),
        F.count("*").alias("support"), (F.first("is_reverse") == F.first("mate_is_reverse")).alias("reverse"),
    )


def precise_breakpoints(clusters: DataFrame, reads: DataFrame, least_length: int = 15, least_score: float = 0.8) -> DataFrame:
    """The exact position of each cluster's end from its clipped reads.

    clusters: cluster, lo, hi and ref (the contig's bases from lo to hi). reads: cluster, row_id, clip (the clipped
    bases), right (True if the clip lies right of the breakpoint). Each candidate position's bases are compared with the
    clip; a position counts if its score over the length is above least_score and strictly better than those before.
    Reads are taken in row order, the first one with a position decides. Columns: cluster, pos, similarity, row_id."""

    def start():
        state: dict = {"ref": None, "lo": 0, "done": False}

        def step(r):
            import numpy as np

            if r.kind == 0:
                state["ref"], state["lo"] = (r.text, int(r.lo)) if state["ref"] is None else (state["ref"], state["lo"])
                return ()
            n = len(r.text)
            if state["done"] or state["ref"] is None or n <= least_length or n > len(state["ref"]):
                return ()
            # no window scores more than one that equals the clip, and the first of the best is taken
            where, score = state["ref"].find(r.text), 2.0
            if where < 0:
                windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(state["ref"].encode(), np.uint8), n)
                scores = np.concatenate([local_scores(r.text, windows[k : k + 4096]) for k in range(0, len(windows), 4096)]) / n
                where = int(scores.argmax())
                score = float(scores[where])
            if score <= least_score:
                return ()
            state["done"] = True
            return [(r.cluster, state["lo"] + where + (0 if r.right else n), score, r.row_id)]

        return step, lambda: ()

    from .order import sorted_groups

    none = F.lit(None)
    own = clusters.select(F.col("cluster").cast("long"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("row_id"), F.col("ref").alias("text"), F.col("lo").cast("long"), none.cast("boolean").alias("right"))
    rows = own.unionByName(reads.select(F.col("cluster").cast("long"), F.lit(1).alias("kind"), F.col("row_id").cast("long"), F.col("clip").alias("text"), none.cast("long").alias("lo"), "right"))
    return sorted_groups(rows, "cluster", ["kind", "row_id"], start, "cluster long, pos long, similarity double, row_id long")
