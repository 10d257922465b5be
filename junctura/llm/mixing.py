"""Mixing sources to target weights: a token budget handed down a domain - language - source tree.

Every leaf can give max_epochs times its tokens; a node can give what its children can. The budget goes down level by
level: among siblings it is shared by weight, and what a child cannot take is shared among the others again, in one
pass over the siblings in order of tokens a weight unit (no iteration). As a node's capacity is that of its whole
subtree, a shortage is made good among siblings first and reaches other branches only when they cannot. Shares are
rounded down to whole tokens.

A leaf with budget b and t tokens gives b div t whole epochs and, of one more epoch in the seeded order of that epoch,
the documents whose running token count stays within b mod t. The running count is distributed: the order is a hash,
its leading digits are buckets of their own, and only sums of buckets are carried over, in two levels of 16 ** DIGITS
each, so a leaf of any size is never sorted by one task.

Cases: an empty table gives an empty mix. Ties of the order are settled by id and then by the text's hash. Very long
texts count as they are. A null domain, language or source is the leaf value `unknown`; a null or blank text has 0 tokens and comes with
every epoch whose budget reaches it. Nodes without a given weight weigh 1. Rows that repeat an id and text count each.
Input columns named epoch, n_tokens or domain are replaced, others are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import discard, documents, staged, words_of

NAME = "op3_mixing"
SEED = 3
#: Leading hex digits of the order that make a bucket of the upper level, and again one of the lower level in it.
DIGITS = 2
LEVELS = ("domain", "lang", "source")
#: Weights of children by level and name; others weigh 1.
WEIGHTS = {
    "domain": {"web": 4, "books": 3, "code": 2, "forum": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 2},
}
#: Of the corpus's tokens, in percent; and epochs of a leaf at most.
PERCENT, MAX_EPOCHS = 75, 2
DOMAINS = ("web", "books", "code", "forum")


def domain_of(source: Column) -> Column:
    """The domain of a source, by its number; sources without a number are `other`."""
    number = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("bigint")
    return F.when(number.isNull(), "other").otherwise(F.element_at(F.array(*map(F.lit, DOMAINS)), (number % len(DOMAINS) + 1).cast("int")))


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def _shared(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children with w, capacity and the parent's budget: each one's share as budget."""
    by = [F.col("capacity") / F.col("w"), F.col(name)]
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = group.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    used, gone, total = F.coalesce(F.sum("capacity").over(before), none), F.coalesce(F.sum("w").over(before), none), F.sum("w").over(group)
    ranked = children.select("*", used.alias("used"), (total - gone).alias("left"))
    full = F.col("capacity") * F.col("left") <= (F.col("budget") - F.col("used")) * F.col("w")
    marked = ranked.withColumn("full", full)
    taken = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(none)).over(group)
    open_w = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(none)).over(group)
    part = ((F.col("budget") - taken) * F.col("w") - F.pmod((F.col("budget") - taken) * F.col("w"), open_w)) / open_w
    shared = marked.select("*", F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(part)).cast("long").alias("share"))
    return shared.drop("budget", "used", "left", "full").withColumnRenamed("share", "budget")


def budgets(leaves: DataFrame, budget: Column, weights: dict, max_epochs: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Leaves (levels, tokens) with their budgets in tokens; budget may use the column total."""
    sized = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    node = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).select(budget.cast("long").alias("budget"))
    for k, level in enumerate(levels):
        up, own = list(levels[:k]), list(levels[: k + 1])
        children = sized.groupBy(*own).agg(F.sum("capacity").alias("capacity")).withColumn("w", _weight(level, weights))
        joined = children.join(node.select(*up, "budget"), up) if up else children.crossJoin(F.broadcast(node))  # one row
        node = _shared(joined, up, level).select(*own, "budget")
    return leaves.join(node, list(levels))


def mix(docs: DataFrame, domain: Column, weights: dict = WEIGHTS, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Chosen rows of docs, once for each epoch they are chosen in, with domain, n_tokens and epoch (from 0)."""
    carried = [c for c in docs.columns if c not in ("domain", "n_tokens", "epoch")]
    unknown = F.lit("unknown")
    rows = docs.select(
        *carried,
        F.coalesce(domain, unknown).alias("domain"),
        F.coalesce("lang", unknown).alias("__lang"),
        F.coalesce("source", unknown).alias("__source"),
        F.size(words_of(F.col(text))).cast("long").alias("n_tokens"),
    )
    leaves = staged(rows.groupBy("domain", F.col("__lang").alias("lang"), F.col("__source").alias("source")).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    plan = staged(
        budgets(leaves, F.floor(F.col("total") * percent / 100), weights, max_epochs)
        .filter("tokens > 0 and budget > 0")
        .select("domain", F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest")),
        "plan",
    )
    order = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("whole").cast("string"), F.col(key).cast("string")))
    leaf = ["domain", "__lang", "__source"]
    placed = rows.join(plan, leaf).withColumn("__order", order).withColumn("__upper", F.substring("__order", 1, DIGITS)).withColumn("__lower", F.substring("__order", 1 + DIGITS, DIGITS))
    none = F.lit(0).cast("long")
    earlier = lambda by, column: F.coalesce(F.sum("in").over(Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), none)
    lower = staged(placed.groupBy(*leaf, "__upper", "__lower").agg(F.sum("n_tokens").alias("in")), "buckets")
    upper = lower.groupBy(*leaf, "__upper").agg(F.sum("in").alias("in")).select(*leaf, "__upper", earlier(leaf, "__upper").alias("__before"))
    inner = lower.select(*leaf, "__upper", "__lower", earlier([*leaf, "__upper"], "__lower").alias("__inner"))
    offsets = staged(inner.join(upper, [*leaf, "__upper"]).select(*leaf, "__upper", "__lower", (F.col("__before") + F.col("__inner")).alias("__before")), "offsets")
    discard(lower)
    bucket = [*leaf, "__upper", "__lower"]
    running = Window.partitionBy(*bucket).orderBy("__order", key, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.join(offsets, bucket).withColumn("__upto", F.col("__before") + F.sum("n_tokens").over(running))
    whole = F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).otherwise(F.array().cast("array<long>"))
    partial = F.when((F.col("rest") > 0) & (F.col("__upto") <= F.col("rest")), F.array("whole")).otherwise(F.array().cast("array<long>"))
    return counted.select(*carried, "domain", "n_tokens", F.explode(F.concat(whole, partial)).alias("epoch"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return mix(docs, domain_of(F.col("source"))).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _oracle() -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{n}' THEN {w}" for n, w in WEIGHTS[level].items())
        return f"(CASE {level} {cases} ELSE 1 END)::bigint"

    ctes, parent = [], "node0"
    for k, level in enumerate(LEVELS):
        up, own = list(LEVELS[:k]), list(LEVELS[: k + 1])
        part = f"PARTITION BY {', '.join(up)}" if up else ""
        join = f"USING ({', '.join(up)})" if up else "ON true"
        ctes.append(f"""
    c{k} AS (SELECT *, {weight(level)} AS w FROM (SELECT {", ".join(own)}, sum(tokens * {MAX_EPOCHS})::bigint AS capacity FROM leaves GROUP BY {", ".join(own)}) x),
    r{k} AS (SELECT c{k}.*, budget,
      coalesce(sum(capacity) OVER o, 0)::bigint AS used, (sum(w) OVER ({part}) - coalesce(sum(w) OVER o, 0))::bigint AS lft
      FROM c{k} JOIN {parent} {join}
      WINDOW o AS ({part} ORDER BY capacity / w::double, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f{k} AS (SELECT *, capacity::hugeint * lft <= (budget - used)::hugeint * w AS fl FROM r{k}),
    g{k} AS (SELECT *, (sum(CASE WHEN fl THEN capacity ELSE 0 END) OVER ({part}))::bigint AS taken, (sum(CASE WHEN fl THEN 0 ELSE w END) OVER ({part}))::bigint AS open_w FROM f{k}),
    node{k + 1} AS (SELECT {", ".join(own)}, (CASE WHEN fl THEN capacity ELSE ((budget - taken) * w) // open_w END)::bigint AS budget FROM g{k})""")
        parent = f"node{k + 1}"
    names = ", ".join(f"'{d}'" for d in DOMAINS)
    number = "try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint)"
    return f"""
    WITH rows_ AS (
      SELECT doc_id, lang AS l0, source AS s0, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
        CASE WHEN {number} IS NULL THEN 'other' ELSE ([{names}])[({number} % {len(DOMAINS)} + 1)::int] END AS domain,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS n_tokens
      FROM documents),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::bigint AS tokens FROM rows_ GROUP BY ALL),
    node0 AS (SELECT floor(sum(tokens) * {PERCENT} / 100)::bigint AS budget FROM leaves),
    {",".join(ctes)},
    p AS (SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS rest FROM leaves JOIN {parent} USING (domain, lang, source) WHERE tokens > 0 AND budget > 0),
    q AS (SELECT rows_.*, whole, rest, md5('{SEED}:' || whole || ':' || doc_id) AS o FROM rows_ JOIN p USING (domain, lang, source)),
    u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q),
    e AS (SELECT *, unnest(range(0, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM u)
    SELECT doc_id, domain, l0 AS lang, s0 AS source, n_tokens, epoch::bigint AS epoch FROM e
    """


ORACLE_SQL = _oracle()
