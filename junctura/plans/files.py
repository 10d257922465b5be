"""Queries over files: rows of the views are written in a format to the shared folder, read back from it and told apart."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.checkpoints import shared_folder
from ..sources import files as S
from ..sources import index
from ..sources.ranges import reads
from .binding import oracle
from .catalog import query
from .kernels import _E, _K, _KMERS, _REFERENCE, _bits


def _folder(v, name: str) -> str:
    return f"{shared_folder(v.spark)}/files-{uuid.uuid4().hex}/{name}"


@query("s01_fasta", oracle("seqs", "SELECT contig, length(seq)::bigint AS len, md5(seq) AS digest FROM seqs WHERE length(seq) > 0"))
def s01(v):
    """Sequences of lines of sixty letters."""
    path = _folder(v, "reference.fa")
    lines = F.regexp_replace("seq", "(.{60})", "$1\n")
    v.seqs.filter("length(seq) > 0").select(F.concat(F.lit(">"), "contig", F.lit(" of a text\n"), lines)).write.text(path)
    return S.fasta(v.spark, path).select("contig", "len", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query("s02_reads", oracle("seqs", "SELECT contig AS read_name, md5(seq) AS digest, md5(translate(seq, 'ACGT', '@+IJ')) AS quality FROM seqs WHERE length(seq) > 0"))
def s02(v):
    """Four-line records, read from ranges of 1 MB, with qualities that look like heads."""
    path = _folder(v, "reads.fq")
    qual = F.translate("seq", "ACGT", "@+IJ")
    v.seqs.filter("length(seq) > 0").select(F.concat(F.lit("@"), "contig", F.lit("/1\n"), "seq", F.lit("\n+\n"), qual)).write.text(path)
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return reads(v.spark, path, split_bytes=1 << 20).select("read_name", digest("seq").alias("digest"), digest("qual").alias("quality"))


@query("s07_probed_index", oracle("seqs", f"SELECT contig, pos, 1 AS any_hit, (count(*) >= {_E})::int AS all_hit FROM kh WHERE n % 2 = 1 AND h IN (SELECT h FROM kh WHERE n % 2 = 0 GROUP BY h HAVING count(*) >= 3) GROUP BY contig, pos", _KMERS))
def s07(v):
    """The hit positions of a reference whose index has been written, probed by the reads' frequent hashes."""
    path = _folder(v, "index")
    index.write_tracks(v.seqs.filter(_REFERENCE).select("contig", "seq"), path, _K, _E)
    return index.probed_tracks(v.spark, path, _bits(v), _K, _E)


@query("s09_bed", oracle("genes", "SELECT contig, greatest(g_start, 1)::bigint AS start, g_end::bigint AS end FROM genes WHERE g_end - greatest(g_start, 1) >= 50"))
def s09(v):
    path = _folder(v, "genes.bed")
    S.write_bed(v.genes.select("contig", F.col("g_start").alias("start"), F.col("g_end").alias("end")), path)
    return S.bed(v.spark, path)


@query("s12_raw_clusters", oracle("bkp", "SELECT from_ref AS ref1, from_pos AS pos1, to_ref AS ref2, to_pos AS pos2, cross_split_reads AS support, if_reverse AS reverse FROM bkp"))
def s12(v):
    path = _folder(v, "s.raw.csv")
    pos = lambda c: [F.col(c).alias(n) for n in (f"pos{1 + (c == 'to_pos')}", f"left{1 + (c == 'to_pos')}", f"right{1 + (c == 'to_pos')}")]
    rows = v.bkp.select(F.col("from_ref").alias("ref1"), *pos("from_pos"), F.col("to_ref").alias("ref2"), *pos("to_pos"), F.col("cross_split_reads").alias("support"), F.col("if_reverse").alias("reverse"))
    S.write_raw(rows, path)
    return S.raw_clusters(v.spark, path).select("ref1", "pos1", "ref2", "pos2", "support", "reverse")


@query("s13_breakpoints", oracle("bkp", "SELECT from_ref, from_pos, from_side, to_ref, to_pos, to_strand, if_reverse, cross_split_reads::int AS cross_split_reads, 1000000::bigint AS reads_num FROM bkp WHERE sample = 'S1'"))
def s13(v):
    """One sample's breakpoints with the comment line, as the reader wants them."""
    path = _folder(v, "S1.acc.csv")
    none = {"read_seq": "N", "ref_seq": "N", "similarity": 1.5, "from_split_reads": 1, "to_split_reads": 2}
    S.write_acc(v.bkp.filter("sample = 'S1'").withColumns({c: F.lit(x) for c, x in none.items()}), path, 1_000_000, 300)
    rows = S.acc_breakpoints(v.spark, path)
    return rows.select("from_ref", "from_pos", "from_side", "to_ref", "to_pos", "to_strand", "if_reverse", "cross_split_reads", "reads_num")


@query("s15_events", oracle("ev", "SELECT sample, receptor, insert_locus, donor, delete_start, delete_end, reverse_flag FROM ev"))
def s15(v):
    path = _folder(v, "events.csv")
    S.write_events(v.ev, path)
    return S.events(v.spark, path)


@query("s27_truth", oracle("ev", "SELECT receptor, insert_locus, donor, delete_start, delete_end, reverse_flag FROM ev"))
def s27(v):
    path = _folder(v, "truth.txt")
    S.write_truth(v.ev, path)
    return S.truth(v.spark, path)
