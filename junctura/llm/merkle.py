"""Merkle manifest of a table: a hash for every row, a tree over the rows of each language, a tree over the languages, and
for every row the siblings that lead from its leaf to the root.

Rows are hashed by Spark where they are read, so that no text is shuffled. Leaves are put in order by a range partitioning
on (language, id, leaf) and numbered by the counts of the partitions; 4096 = 8^4 consecutive leaves of a language, aligned
to the tree, are a bucket. DuckDB runs in the executors, over one bucket's Arrow table at a time: ordered string_agg and
sha256 make four levels of the tree, the text of a run of nodes gives each node its siblings, and a chain of sha256 folds a
leaf up. Spark combines the roots of the buckets, which are the leaves of the next round (one row for 4096), and joins the
outer proofs to the buckets, one row a bucket, on the way down. Languages are the leaves of one more tree of the same kind.

A bucket is a bounded group whatever the size of a language. A run that holds one node only is hashed too; what remains
alone at a level is the root.

Cases: an empty table gives an empty one. A null field is hashed as `-`; a null language is a group of its own, before all
others; null ids come first. Rows with equal ids are ordered by their leaves, so repeated rows are neighbours with equal
leaves and proofs of their own. Very long texts are hashed whole. Columns that are not hashed are of no consequence.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, fold, staged

NAME = "op13_merkle_manifest"
#: Nodes in a run, levels in a bucket, leaves in a bucket.
FAN, LEVELS = 8, 4
BUCKET = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODES = "key string, pos long, n long, h binary"
PATH = "array<struct<l: string, r: string>>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*fields: Column) -> Column:
    """sha256 (binary) of fields put together, each as its byte count, `:` and value, or `-` if null."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*told), 256))


def group_key(lang: Column) -> Column:
    """A text that orders like the language, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, the place within their key in the order of the columns, and n, the number of rows of the key."""
    sorted_ = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    placed = staged(sorted_.withColumns({"part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ordered")
    runs = placed.groupBy("key", "part").agg(F.min("__at").alias("first"), F.count("*").alias("c"))
    # one row a key and partition
    before = F.expr("sum(c) over (partition by key order by part rows between unbounded preceding and 1 preceding)")
    runs = runs.select("key", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.expr("sum(c) over (partition by key)").alias("n"))
    out = placed.join(runs, ["key", "part"]).withColumn("pos", F.col("__at") - F.col("first") + F.col("before"))
    out = staged(out.drop("part", "__at", "first", "before"), "numbered")
    discard(placed)
    return out


# ---- DuckDB over one bucket

_OPEN: dict[str, object] = {}


def _engine():
    """The worker's DuckDB, on one thread."""
    if "duckdb" not in _OPEN:
        import duckdb

        _OPEN["duckdb"] = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
    return _OPEN["duckdb"]


def _depth(n: int) -> int:
    """Levels that a bucket of a key with n nodes builds."""
    depth = 0
    while depth < LEVELS and FAN**depth < n:
        depth += 1
    return depth


@cache
def _levels(depth: int) -> str:
    """Tables l0, s0, l1, ...: nodes of each level, and the texts of their runs."""
    out = [f"l0 AS MATERIALIZED (SELECT pos % {BUCKET} AS pos, lower(hex(h)) AS h FROM bucket)"]
    for j in range(depth):
        out.append(f"s{j} AS MATERIALIZED (SELECT pos // {FAN} AS pos, string_agg(h, '' ORDER BY pos) AS s FROM l{j} GROUP BY ALL)")
        out.append(f"l{j + 1} AS (SELECT pos, sha256(s) AS h FROM s{j})")
    return "WITH " + ", ".join(out)


@cache
def _sides(depth: int) -> tuple[str, str]:
    """Left and right siblings of each node at each level, and the joins that give them."""
    columns, joins = [], []
    for j in range(depth):
        at = f"(b.pos % {BUCKET} // {FAN**j} % {FAN}) * 64"
        columns += [f"left(s{j}.s, ({at})::bigint) AS l{j}", f"substr(s{j}.s, ({at} + 65)::bigint) AS r{j}"]
        joins.append(f"JOIN s{j} ON s{j}.pos = b.pos % {BUCKET} // {FAN ** (j + 1)}")
    return ", ".join(["b.*", *columns]), " ".join(["FROM bucket b", *joins])


@cache
def _root_sql(depth: int) -> str:
    return f"{_levels(depth)} SELECT h FROM l{depth}"


@cache
def _path_sql(depth: int) -> str:
    columns, source = _sides(depth)
    steps = ", ".join(f"{{'l': l{j}, 'r': r{j}}}" for j in range(depth))
    return f"{_levels(depth)}, p AS (SELECT {columns} {source}) SELECT key, pos, [{steps}] AS path FROM p"


@cache
def _proof_sql(depth: int, outer: int) -> str:
    columns, source = _sides(depth)
    siblings = [x for j in range(depth) for x in (f"l{j}", f"r{j}")] + [x for j in range(outer) for x in (f"$ol{j}", f"$or{j}")]
    folded = "lower(hex(coalesce(t, h)))"
    for left, right in zip(siblings[::2], siblings[1::2], strict=True):
        folded = f"sha256({left} || {folded} || {right})"
    together = " || ".join(siblings) or "''"
    return f"{_levels(depth)}, p AS (SELECT {columns} {source}) SELECT doc_id, lower(hex(h)) AS leaf, sha256({together}) AS proof_sha256, {folded} AS folded_root FROM p"


def _run(sql: str, bucket, parameters: dict | None = None):
    engine = _engine()
    engine.register("bucket", bucket)
    try:
        return engine.sql(sql, params=parameters or {}).to_arrow_table()
    finally:
        engine.unregister("bucket")


def _in_bucket() -> Column:
    return F.floor(F.col("pos") / BUCKET).cast("long").alias("bucket")


def _by_bucket(above: DataFrame):
    return above.select(F.col("key").alias("up_key"), F.col("pos").alias("up_pos"), "top", "path").groupBy("up_key", "up_pos")


def bucket_roots(nodes: DataFrame) -> DataFrame:
    """The nodes four levels up: key, pos, n, h."""

    def run(key, table):
        import pyarrow as pa

        n = table.column("n")[0].as_py()
        root = _run(_root_sql(_depth(n)), table).column("h")[0].as_py()
        rows = [[key[0].as_py()], [key[1].as_py()], [-(-n // BUCKET)], [bytes.fromhex(root)]]
        return pa.table([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "pos", "n", "h"])

    return nodes.select("key", "pos", "n", "h").groupBy("key", _in_bucket()).applyInArrow(run, NODES)


def paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """key, pos, top and path (siblings level by level up to the root) of nodes; above has key, pos, top and path of the buckets."""

    def run(table, upper):
        import pyarrow as pa

        made = _run(_path_sql(_depth(table.column("n")[0].as_py())), table)
        top, rest = upper.column("top")[0], upper.column("path")[0].as_py()
        kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
        whole = pa.array([[*p, *rest] for p in made.column("path").to_pylist()], kind)
        return pa.table([made.column("key"), made.column("pos"), pa.array([top.as_py()] * len(made), pa.string()), whole], ["key", "pos", "top", "path"])

    left = nodes.select("key", "pos", "n", "h").groupBy("key", _in_bucket())
    return left.cogroup(_by_bucket(above)).applyInArrow(run, f"key string, pos long, top string, path {PATH}")


# ---- trees


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of a forest, from numbered nodes (key, pos, n, h) up, and the root of each key (key, h, round: the number
    of the round whose buckets gave it)."""
    rounds, roots = [nodes], []
    while True:
        made = staged(bucket_roots(rounds[-1]), "roots")
        roots.append(made.filter("n = 1").select("key", "h", F.lit(len(rounds) - 1).alias("round")))
        more = made.filter("n > 1")
        if more.isEmpty():
            break
        rounds.append(more)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return rounds, out


def outer_paths(rounds: list[DataFrame], roots: DataFrame, tops: DataFrame) -> DataFrame:
    """key, pos, top and path of the buckets of the first round; tops has key, top and the path of each key's root."""
    above = None
    for i in range(len(rounds) - 1, -1, -1):
        done = roots.filter(F.col("round") == i).join(tops, "key").select("key", F.lit(0).cast("long").alias("pos"), "top", "path")
        above = done if above is None else done.unionByName(staged(paths(rounds[i + 1], above), "paths"))
    return above


def manifest(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of leaves (key, doc_id, h: the leaf, t: the leaf as
    found later, null if it is the same; digests binary). The proof goes level by level to the root, a run's siblings left to
    right; folded_root is what t and the original siblings give."""
    base = numbered(leaves, ["doc_id", "h"])
    rounds, roots = build(base)
    top_base = numbered(roots.select(F.lit("").alias("key"), F.col("key").alias("lang"), "h"), ["lang", "h"])
    top_rounds, top_roots = build(top_base)
    root = top_roots.select(F.lower(F.hex("h")).alias("root")).first()
    if root is None:
        return leaves.sparkSession.createDataFrame([], RESULT)
    nothing = F.array().cast(PATH)
    top_above = outer_paths(top_rounds, top_roots, top_roots.select("key", F.lower(F.hex("h")).alias("top"), nothing.alias("path")))
    top_paths = staged(paths(top_base, top_above), "paths")
    # one row a language: its root and the siblings of that
    tops = top_base.select("lang", "pos", "h").join(top_paths, "pos").select(F.col("lang").alias("key"), F.lower(F.hex("h")).alias("top"), "path")
    above = outer_paths(rounds, roots, tops)

    def run(table, upper):
        import pyarrow as pa

        outer = upper.column("path")[0].as_py()
        sides = {f"o{side}{j}": step[side] for j, step in enumerate(outer) for side in ("l", "r")}
        made = _run(_proof_sql(_depth(table.column("n")[0].as_py()), len(outer)), table, sides)
        top = pa.array([upper.column("top")[0].as_py()] * len(made), pa.string())
        return made.append_column("subroot", top).select(["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    rows = base.select("key", "pos", "n", "h", "t", "doc_id").groupBy("key", _in_bucket())
    proven = rows.cogroup(_by_bucket(above)).applyInArrow(run, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    known = F.lit(root[0])
    return proven.select("doc_id", "leaf", "subroot", known.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == known).alias("verified"))


def leaves_of(rows: DataFrame, lang: str = "lang", tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """key, doc_id, h and t of rows with the fields; where `when` holds, the columns of tampered stand in for the fields in t."""
    found = digest(*[(tampered or {}).get(c, F.col(c)) for c in FIELDS])
    again = F.when(when, found) if when is not None and tampered else F.lit(None).cast("binary")
    return staged(rows.select(group_key(F.col(lang)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), digest(*map(F.col, FIELDS)).alias("h"), again.alias("t")), "leaves")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lowered = F.translate("text", UPPER, LOWER)
    leaves = leaves_of(docs, tampered={"text": lowered}, when=fold(F.col("doc_id"), 3) == 0)
    out = manifest(leaves)
    discard(leaves)
    return out


def _oracle() -> str:
    """The same in DuckDB: levels unrolled, up to 8^7 rows of a language and 8^3 languages."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = "sha256(" + " || ".join(map(field, FIELDS)) + ")"
    lowered = leaf.replace("text::varchar", f"translate(text, '{UPPER}', '{LOWER}')")
    # the table of crc32 of single bytes, by eight shifts
    ctes = ["c0 AS (SELECT i, i::bigint AS c FROM range(256) r(i))"]
    ctes += [f"c{k + 1} AS (SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) AS c FROM c{k})" for k in range(8)]
    ctes.append("crcs AS (SELECT list(c ORDER BY i) AS crc FROM c8)")
    digits = "list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint))"
    crc = f"xor(list_reduce({digits}, lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8)), 4294967295)"
    ctes.append(f"d AS (SELECT doc_id, lang, {leaf} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {lowered} ELSE {leaf} END AS t FROM documents, crcs)")
    ctes.append("a0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS h, '' AS p, t AS f FROM d)")
    # every row carries the node above it: runs are put together from one row a node
    depth = 7
    for j in range(depth):
        step = f"(pos // {FAN**j})"
        run = f"(PARTITION BY lang, pos // {FAN ** (j + 1)} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        first = f"CASE WHEN pos % {FAN**j} = 0 THEN h END"
        ctes.append(f"b{j} AS (SELECT *, string_agg({first}, '') OVER {run} AS s, ({step} % {FAN} * 64)::bigint AS o FROM a{j})")
        grows = f"(n + {FAN**j} - 1) // {FAN**j} > 1"
        ctes.append(
            f"a{j + 1} AS (SELECT doc_id, lang, leaf, t, pos, n, CASE WHEN {grows} THEN sha256(s) ELSE h END AS h, CASE WHEN {grows} THEN p || left(s, o) || substr(s, o + 65) ELSE p END AS p, CASE WHEN {grows} THEN sha256(left(s, o) || f || substr(s, o + 65)) ELSE f END AS f FROM b{j})"
        )
    ctes.append("g0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h, h AS subroot, []::struct(l varchar, r varchar)[] AS path FROM (SELECT DISTINCT lang, h FROM a7) x)")
    for j in range(3):
        run = f"(PARTITION BY pos // {FAN ** (j + 1)} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        ctes.append(f"h{j} AS (SELECT *, string_agg(CASE WHEN pos % {FAN**j} = 0 THEN h END, '') OVER {run} AS s, (pos // {FAN**j} % {FAN} * 64)::bigint AS o FROM g{j})")
        grows = f"(n + {FAN**j} - 1) // {FAN**j} > 1"
        ctes.append(f"g{j + 1} AS (SELECT lang, pos, n, CASE WHEN {grows} THEN sha256(s) ELSE h END AS h, subroot, CASE WHEN {grows} THEN list_append(path, {{'l': left(s, o), 'r': substr(s, o + 65)}}) ELSE path END AS path FROM h{j})")
    folded = "f"
    for j in range(3):
        folded = f"(CASE WHEN len(path) > {j} THEN sha256(path[{j + 1}].l || {folded} || path[{j + 1}].r) ELSE {folded} END)"
    siblings = "p || array_to_string(list_transform(path, lambda x: x.l || x.r), '')"
    ctes.append(f"o AS (SELECT doc_id, leaf, subroot, g3.h AS root, sha256({siblings}) AS proof_sha256, {folded} AS folded_root FROM a7 JOIN g3 ON a7.lang IS NOT DISTINCT FROM g3.lang)")
    return f"WITH {', '.join(ctes)} SELECT *, folded_root = root AS verified FROM o"


ORACLE_SQL = _oracle()
