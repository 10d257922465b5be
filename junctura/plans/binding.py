"""Domain views over the driver's tables, in one SQL text for Spark and for the oracle.

Base tables are written @name; STR is the string type, DIV the integer division of the dialect. A view is a chain of
common table expressions, so that filters and columns are pushed down to the Parquet scans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    # breakpoints of 40 samples between contigs of 97 genomes, all rows before cleaning
    "bkp_all": """
        SELECT l_orderkey * 8 + l_linenumber AS bkp_id, concat('S', cast(l_orderkey % 40 AS STR)) AS sample,
          concat('G', cast((l_partkey * l_partkey) % 97 AS STR), '_', cast(l_partkey % 2 + 1 AS STR)) AS from_ref,
          cast((cast(round(l_extendedprice * 100) AS bigint) % 12) * 900 + l_linenumber * 3 AS bigint) AS from_pos,
          CASE WHEN l_returnflag = 'R' THEN 'tail' ELSE 'head' END AS from_side,
          CASE WHEN l_quantity > 25 THEN '+' ELSE '-' END AS from_strand,
          concat('G', cast((l_suppkey * l_suppkey + 3) % 97 AS STR), '_', cast(l_suppkey % 2 + 1 AS STR)) AS to_ref,
          cast((cast(round(l_tax * 100) AS bigint) * 7 + cast(l_quantity AS bigint)) % 14 * 900 + l_linenumber * 5 AS bigint) AS to_pos,
          CASE WHEN l_linestatus = 'F' THEN 'tail' ELSE 'head' END AS to_side,
          CASE WHEN l_suppkey % 3 = 0 THEN '+' WHEN l_suppkey % 3 = 1 THEN '-' ELSE '.' END AS to_strand,
          CASE WHEN l_discount > 0.05 THEN 'True' ELSE 'False' END AS if_reverse,
          cast(l_linenumber AS bigint) AS cross_split_reads, cast(l_quantity AS bigint) AS pair_end
        FROM @lineitem""",
    "bkp": """
        SELECT *, regexp_replace(from_ref, '_[^_]*$', '') AS from_genome, regexp_replace(to_ref, '_[^_]*$', '') AS to_genome
        FROM bkp_all WHERE regexp_replace(from_ref, '_[^_]*$', '') <> regexp_replace(to_ref, '_[^_]*$', '')""",
    "reads_num": """
        SELECT sample, cast(1000000 + 250000 * (cast(substring(sample, 2, 9) AS bigint) % 9) AS bigint) AS reads_num
        FROM (SELECT DISTINCT sample FROM bkp_all) s""",
    "contigs": """
        SELECT ref AS contig, cast(9500 + 700 * (length(ref) % 3) + 400 * (cast(substring(ref, 2, 1) AS bigint) % 5) AS bigint) AS len
        FROM (SELECT from_ref AS ref FROM bkp_all UNION SELECT to_ref AS ref FROM bkp_all) c""",
    "tax": """
        SELECT genome, concat('d__B;p__P', cast(n % 5 AS STR), ';c__C', cast(n % 7 AS STR), ';o__O', cast(n % 11 AS STR), ';f__F', cast(n % 13 AS STR),
          ';g__', CASE WHEN n % 31 = 0 THEN '' ELSE concat('G', cast(n % 23 AS STR)) END, ';s__S', cast(n % 47 AS STR)) AS lineage,
          concat('p__P', cast(n % 5 AS STR)) AS phylum, CASE WHEN n % 31 = 0 THEN 'g__' ELSE concat('g__G', cast(n % 23 AS STR)) END AS genus,
          concat('s__S', cast(n % 47 AS STR)) AS species
        FROM (SELECT DISTINCT genome, cast(substring(genome, 2, 9) AS bigint) AS n
              FROM (SELECT regexp_replace(contig, '_[^_]*$', '') AS genome FROM contigs) g) t""",
    "phe": """
        SELECT sample, concat('C', cast(n % 4 AS STR)) AS cohort,
          CASE WHEN n % 3 = 0 THEN 'control' WHEN n % 3 = 1 THEN 'CRC' ELSE 'adenoma' END AS disease,
          CASE WHEN n % 3 = 0 THEN 'healthy' WHEN n % 7 = 1 THEN 'CRC;T2D' WHEN n % 3 = 1 THEN 'CRC' ELSE 'adenoma' END AS full_disease,
          cast(1000000000 * (3 + n % 6) + 7000000 * n AS bigint) AS bases, cast(30 + n AS bigint) AS age
        FROM (SELECT sample, cast(substring(sample, 2, 9) AS bigint) AS n FROM reads_num) s""",
    "genes": """
        SELECT p_partkey AS gene_id, concat('G', cast((p_partkey * p_partkey) % 97 AS STR), '_', cast(p_partkey % 2 + 1 AS STR)) AS contig,
          cast((p_partkey * 37) % 10000 AS bigint) AS g_start, cast((p_partkey * 37) % 10000 + p_size * 30 + 100 AS bigint) AS g_end,
          concat('ID=gene', cast(p_partkey AS STR), ';product=', CASE p_partkey % 14 WHEN 0 THEN 'phage tail protein' WHEN 1 THEN 'transposase IS200'
            WHEN 2 THEN 'plasmid relaxase' WHEN 3 THEN 'beta-lactamase class A' WHEN 4 THEN 'glycosyl hydrolase' WHEN 5 THEN 'DNA topoisomerase' WHEN 6 THEN 'phage integrase' WHEN 7 THEN 'toxin of plasmid'
            WHEN 8 THEN 'mobilization protein A' WHEN 9 THEN 'sucrose permease' WHEN 10 THEN 'VanZ like protein' WHEN 11 THEN 'conjugal transfer TraG' WHEN 12 THEN 'head protein' ELSE 'hypothetical protein' END,
            ';KEGG=ko:K', cast(p_partkey % 40 AS STR), ',ko:K', cast(p_partkey % 17 + 40 AS STR), ';COG=', substring('JKLEGMCH', cast(p_partkey % 7 + 1 AS int), 2)) AS attrs
        FROM @part""",
    "ko_pathway": """
        SELECT DISTINCT concat('K', cast(p_partkey % 57 AS STR)) AS ko, concat(CASE WHEN p_size % 5 = 0 THEN 'ko' ELSE 'map' END, cast(p_size % 12 AS STR)) AS pathway FROM @part""",
    # transfer events: one for some orders
    "ev": """
        SELECT o_orderkey AS event_id, concat('S', cast(o_custkey % 40 AS STR)) AS sample, concat('G', cast(o_orderkey % 41 AS STR), '_', cast(o_orderkey % 2 + 1 AS STR)) AS receptor,
          cast((o_custkey % 60) * 150 AS bigint) AS insert_locus, concat('G', cast((o_orderkey * 7 + 3) % 53 AS STR), '_', cast(o_orderkey % 3 + 1 AS STR)) AS donor,
          cast((o_custkey % 25) * 200 + o_orderkey % 4 * 20 AS bigint) AS delete_start, cast((o_custkey % 25) * 200 + o_orderkey % 4 * 20 + 600 + o_custkey % 7 * 100 AS bigint) AS delete_end,
          CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS reverse_flag
        FROM @orders""",
    # split and discordant alignments
    "aln": """
        SELECT l_orderkey * 8 + l_linenumber AS aln_id, concat('q', cast(l_orderkey AS STR)) AS qname,
          cast(1 + 64 * (l_linenumber % 2) + 128 * (1 - l_linenumber % 2) + 16 * (l_orderkey % 2) + 2 * (l_partkey % 2) + 1024 * (CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END) AS bigint) AS flag,
          concat('G', cast(l_partkey % 23 AS STR), '_1:', cast(1000 * (l_suppkey % 5) + 1 AS STR), '-', cast(1000 * (l_suppkey % 5) + 6000 AS STR)) AS ref,
          cast(l_partkey * 13 % 4000 AS bigint) AS pos, cast(l_quantity AS bigint) + 10 AS mapq, cast(l_partkey % 1400 - 200 AS bigint) AS tlen,
          CASE WHEN l_suppkey % 4 = 0 THEN concat(cast(40 + l_linenumber AS STR), 'S', cast(60 - l_linenumber AS STR), 'M') WHEN l_suppkey % 4 = 1 THEN concat(cast(60 + l_linenumber AS STR), 'M', cast(40 - l_linenumber AS STR), 'S')
            WHEN l_suppkey % 4 = 2 THEN '5H50M2I20M3D23M' ELSE '100M' END AS cigar
        FROM @lineitem""",
    "hits": """
        SELECT l_orderkey * 8 + l_linenumber AS hit_id, concat('E', cast(l_orderkey % 500 AS STR)) AS query, concat(CASE l_suppkey % 3 WHEN 0 THEN 'plasmid' WHEN 1 THEN 'phage' ELSE 'ice' END, cast(l_partkey % 90 AS STR)) AS subject,
          80 + l_quantity / 3 AS identity, cast(l_quantity * 20 AS bigint) AS length, CASE WHEN l_discount > 0.07 THEN 0.001 ELSE 1e-10 END AS evalue, l_extendedprice / 100 AS bitscore, cast(500 + l_orderkey % 500 AS bigint) AS full_length
        FROM @lineitem""",
    # tags of repeated samples: 9 individuals at 10 time points
    "ts": """
        SELECT DISTINCT concat('I', cast(user_id % 9 AS STR), 'T', cast(event_id % 10 AS STR)) AS sample, cast(user_id % 9 AS bigint) AS individual, cast(event_id % 10 AS bigint) AS time_point,
          concat('T', cast(cast(floor(value) AS bigint) % 37 * (1 + user_id % 9) % 41 AS STR)) AS tag
        FROM @events""",
    "abund": """
        SELECT concat('S', cast(o_custkey % 40 AS STR)) AS sample, concat('s__S', cast(o_orderkey % 47 AS STR)) AS species, round(sum(o_totalprice) / 1000, 3) AS abundance
        FROM @orders GROUP BY 1, 2""",
    "seqs": """
        SELECT concat('c', cast(doc_id AS STR)) AS contig, doc_id AS n, translate(regexp_replace(lower(text), '[^a-z]', ''GFLAG), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq
        FROM @documents""",
}
#: Order in which views may use each other.
_ORDER = list(VIEWS)


def _closure(names: list[str]) -> list[str]:
    need, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += [x for x in _ORDER if re.search(rf"\b(FROM|JOIN) {x}\b", VIEWS[n])]
    return [n for n in _ORDER if n in need]


def with_clause(names: list[str], dialect: str, sf_dir: str = "") -> str:
    text = ", ".join(f"{n} AS ({VIEWS[n]})" for n in _closure(names))
    if dialect == "spark":
        text = re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text)
        return "WITH " + text.replace("STR", "string").replace(" DIV ", " div ").replace("GFLAG", "")
    return "WITH " + re.sub(r"@(\w+)", r"\1", text).replace("STR", "varchar").replace(" DIV ", " // ").replace("GFLAG", ", 'g'")


class Views:
    """Views as DataFrames, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.sql(f"{with_clause([name], 'spark', self.sf_dir)} SELECT * FROM {name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self[name]


def oracle(names: str, select: str, more: str = "") -> str:
    """The oracle's text: views, further common table expressions, and the final select."""
    return f"{with_clause(names.split(), 'duckdb')}{', ' + more if more else ''} {select}"
