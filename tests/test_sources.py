import gzip
import struct
import zlib

import pytest

from junctura.sources import bam, checks, index, ranges
from junctura.sources import files as S
from junctura.streaming import arrivals


def write(path, text):
    path.write_text(text)
    return str(path)


HEAD = "from_ref,from_pos,from_side,from_strand,to_ref,to_pos,to_side,to_strand,if_reverse,read_seq,ref_seq,similarity,from_split_reads,to_split_reads,cross_split_reads,pair_end\n"


def acc(n, rows):
    return f"# the number of reads in the sample is: {n}; Insert size is 600.\n" + HEAD + "".join(f"{a}_1,{p},head,+,{b}_1,{q},tail,-,True,AC,AC,1.5,2,3,4,5\n" for a, p, b, q in rows)


def test_sequences(spark, tmp_path):
    fa = write(tmp_path / "r.fa", ">A_1 first contig\nACGT\nACGT\n>B_2/x\nNNN\n>C_1\nA\n")
    assert sorted(tuple(r) for r in S.fasta(spark, fa).collect()) == [("A_1", "ACGTACGT", 8), ("B_2", "NNN", 3), ("C_1", "A", 1)]
    fq = write(tmp_path / "r.fq", "@q1/1\nACGT\n+\n@@@@\n@q2 x\nTTTT\n+q2\n+III\n@q3\nGG\n+\n++\n@q4\nC\n+\n@\n")
    assert sorted((r.read_name, r.seq) for r in S.fastq(spark, fq).collect()) == [("q1", "ACGT"), ("q2", "TTTT"), ("q3", "GG"), ("q4", "C")]


def test_reads_from_ranges_of_any_size(spark, tmp_path):
    import gzip
    import random

    rnd = random.Random(4)
    rows = []
    for i in range(120):
        n = rnd.randrange(1, 40)
        qual = rnd.choice("@+I") + "".join(rnd.choices("@+IJ", k=n - 1))
        rows.append((f"q{i}", "".join(rnd.choices("ACGTN", k=n)), qual))
    text = "".join(f"@{n}{rnd.choice(['', '/1', ' x', chr(9) + 'y'])}\n{s}\n+{rnd.choice(['', n])}\n{q}\n" for n, s, q in rows)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fq").write_text(text)
    for size in (1, 7, 100, 5000, 1 << 26):
        got = ranges.reads(spark, str(tmp_path / "in"), 2, size)
        assert sorted(tuple(r) for r in got.collect()) == sorted((n, 2, s, q) for n, s, q in rows)
    (tmp_path / "in" / "b.fq.gz").write_bytes(gzip.compress(text.replace("\n", "\r\n").encode()))
    assert sorted((r.read_name, r.seq, r.qual) for r in S.fastq(spark, str(tmp_path / "in")).collect()) == sorted(rows * 2)
    (tmp_path / "none").mkdir()
    assert S.fastq(spark, str(tmp_path / "none")).count() == 0


def test_sinks_close_the_chain(spark, tmp_path):
    write(tmp_path / "s1.acc.csv", acc(500, [("A", 1, "B", 2), ("A", 3, "A", 4), ("C", 3, "A", 9)]))
    rows = S.acc_breakpoints(spark, str(tmp_path / "s1.acc.csv"))
    S.write_acc(rows.repartition(2), str(tmp_path / "out"), 500, 300)
    again = S.acc_breakpoints(spark, str(tmp_path / "out"))
    key = [c for c in rows.columns if c not in ("sample", "reads_num")]
    assert sorted(map(str, again.select(key).collect())) == sorted(map(str, rows.select(key).collect()))
    assert {r.reads_num for r in again.collect()} == {500}
    events = spark.createDataFrame([("A", 5, "B", 7, 9, "True")], "receptor string, insert_locus long, donor string, delete_start long, delete_end long, reverse_flag string")
    S.write_truth(events, str(tmp_path / "truth"))
    assert [tuple(r) for r in S.truth(spark, str(tmp_path / "truth")).collect()] == [("A", 5, "B", 7, 9, "True")]
    write(tmp_path / "s9.csv", "from_ref,from_pos,to_ref,to_pos,x\nA,1,B,2,7\nA,1,B,2,8\nC,1,B,2,8\nA,1,B,2,8\n")
    assert sorted(tuple(r) for r in S.competitor_calls(spark, str(tmp_path / "s9.csv")).collect()) == [("s9", "A", 1, "B", 2)] * 2 + [("s9", "C", 1, "B", 2)]


def test_alignments(spark, tmp_path):
    sam = write(tmp_path / "a.sam", "@HD\tVN:1\nq1\t99\tA\t10\t60\t50M\t=\t100\t140\tACGT\t*\tNM:i:0\tSA:Z:B,20,-,10S40M,60,0;\nq2\t0\tA\t5\t9\t4M\t*\t0\t0\tACGT\t*\n")
    rows = S.sam(spark, sam)
    assert rows.count() == 2 and rows.filter("qname = 'q1'").first().pos == 9
    one = S.split_alignments(rows).collect()
    assert [(r.sa_ref, r.sa_pos, r.sa_strand, r.sa_cigar) for r in one] == [("B", 19, "-", "10S40M")]


def test_breakpoint_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "s1.acc.csv", acc(500, [("A", 1, "B", 2), ("A", 3, "A", 4)]))
    write(tmp_path / "in" / "s2.acc.csv", acc(700, [("C", 1, "B", 2)]))
    write(tmp_path / "in" / "s2.repeat.acc.csv", acc(700, [("C", 1, "B", 2)]))
    got = sorted((r.sample, r.reads_num, r.from_ref, r.similarity) for r in S.acc_breakpoints(spark, str(tmp_path / "in")).collect())
    assert got == [("s1", 500, "A_1", 1.5), ("s1", 500, "A_1", 1.5), ("s2", 700, "C_1", 1.5)]


def test_stream_appends_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "s1.acc.csv", acc(500, [("A", 1, "B", 2), ("A", 3, "A", 4)]))
    for _ in range(2):
        arrivals.append_table(arrivals.breakpoint_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    write(tmp_path / "in" / "s2.acc.csv", acc(500, [("A", 1, "B", 2)]))
    arrivals.append_table(arrivals.breakpoint_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_tables(spark, tmp_path):
    raw = write(tmp_path / "r.csv", "A, 1, 1, 2, B, 5, 4, 6, 3, True\nbad, row\n")
    assert [tuple(r) for r in S.raw_clusters(spark, raw).collect()] == [("A", 1, 1, 2, "B", 5, 4, 6, 3, "True")]
    ev = write(tmp_path / "e.csv", ",sample,receptor,insert_locus,donor,delete_start,delete_end,reverse_flag\n0,s,A_1,5,B_1,7,9,True\n")
    assert tuple(S.events(spark, ev).first()) == ("s", "A_1", 5, "B_1", 7, 9, "True")
    tr = write(tmp_path / "t.txt", "A 5 B 7 9 True\n")
    assert tuple(S.truth(spark, tr).first()) == ("A", 5, "B", 7, 9, "True")
    ab = write(tmp_path / "a.tsv", "\ts1\ts2\nk__B|p__P\t0.5\t1\n")
    assert sorted(tuple(r) for r in S.abundances(spark, ab).collect()) == [("k__B|p__P", "s1", 0.5), ("k__B|p__P", "s2", 1.0)]
    kr = write(tmp_path / "k.txt", " 12.5\t10\t3\tS\t562\t  Escherichia coli\n")
    assert tuple(S.kraken(spark, kr).first()) == (12.5, 10, "Escherichia coli")
    tl = write(tmp_path / "x.time", "\tUser time (seconds): 3600.00\n\tSystem time (seconds): 1800.0\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 30:00\n\tMaximum resident set size (kbytes): 2097152\n")
    assert tuple(S.time_logs(spark, tl).first())[1:] == (1.5, 0.5, 2.0)
    bd = write(tmp_path / "b.bed", "A_1:5-90\nA_1:5-20\n")
    S.write_bed(S.bed(spark, bd), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["A_1:5-90"]
    g = write(tmp_path / "g.gff", "#x\nA_1\ts\tregion\t1\t9\t.\t+\t.\tID=r\nA_1\ts\tCDS\t1\t9\t.\t+\t.\tID=g1;product=p\n")
    assert S.gff(spark, g).count() == 1


def block(raw):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def alignment_record(name, flag, ref, pos, ops, seq, tags=b""):
    codes = "=ACMGRSVTWYHKDBN"
    packed = bytes(codes.index(a) << 4 | codes.index(b) for a, b in zip(seq[::2], seq[1::2] + "=" * (len(seq) % 2), strict=True))
    raw = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    raw += struct.pack(f"<{len(ops)}I", *(n << 4 | "MIDNSHP=X".index(o) for n, o in ops)) + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(raw)) + raw


def test_binary_alignments(spark, tmp_path):
    tags = b"SAZB,20,-,3S2M,60,0;\0NMC\x05XBBs\x02\x00\x00\x00\x01\x00\xff\xffASf" + struct.pack("<f", 1.5)
    body = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 2) + n + b"\0" + struct.pack("<i", 900) for n in (b"A", b"B"))
    body += alignment_record("q1", 99, 0, 9, [(3, "M"), (2, "S")], "ACGTN", tags) + b"".join(alignment_record(f"x{i}", 0, i % 2, i, [(4, "M")], "ACGT") for i in range(3000)) + alignment_record("u", 4, -1, -1, [], "")
    (tmp_path / "in").mkdir()
    for name, size in (("a.bam", 7), ("b.bam", 60_000)):
        (tmp_path / "in" / name).write_bytes(b"".join(block(body[k : k + size * 100]) for k in range(0, len(body), size * 100)) + block(b""))
    rows = bam.bam(spark, str(tmp_path / "in"))
    got = rows.filter("qname = 'q1'").collect()
    assert rows.count() == 2 * 3002 and len(got) == 2 and rows.filter("qname = 'u'").first().ref == "*"
    assert (got[0].flag, got[0].ref, got[0].pos, got[0].cigar, got[0].seq, got[0].mate_ref) == (99, "A", 9, "3M2S", "ACGTN", "*")
    assert got[0].tags == {"SA": "B,20,-,3S2M,60,0;", "NM": "5", "XB": "s,1,-1", "AS": "1.5"}
    assert S.split_alignments(rows).count() == 2
    bam.write_alignments(rows.filter("ref <> '*'"), str(tmp_path / "t"), 4)
    assert sorted(r.qname for r in bam.fetch(spark, str(tmp_path / "t"), "A", 100, 103).select("qname").distinct().collect()) == ["x100", "x102", "x98"]
    (tmp_path / "in" / "c.bam").write_bytes(block(body)[:-200])
    with pytest.raises(Exception, match="cut off"):
        bam.bam(spark, str(tmp_path / "in")).count()


def test_binary_alignments_by_ranges_and_regions(spark, tmp_path):
    import random

    rnd = random.Random(3)
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 2) + n + b"\0" + struct.pack("<i", 90_000) for n in (b"A", b"B"))
    rows = sorted((rnd.randrange(2), rnd.randrange(80_000), f"r{i}", n) for i in range(700) for n in [rnd.choice([4, 90, 900, 30_000])])
    body = head + b"".join(alignment_record(q, 0, ref, pos, [(n, "M")], "ACGT" * (min(n, 900) // 4) + "A" * (n % 2)) for ref, pos, q, n in rows)
    for name, size in (("a.bam", 331), ("b.bam", 20_000)):
        (tmp_path / name).write_bytes(b"".join(block(body[k : k + size]) for k in range(0, len(body), size)) + block(b""))
        path = str(tmp_path / name)
        bytes_ = (tmp_path / name).stat().st_size
        for split in (97, 1000, 40_000, 1 << 26) if size > 1000 else (5000, 1 << 26):
            with open(path, "rb") as f:
                got = [r[2][0] for a in range(0, bytes_, split) for r in bam.records(f, a, a + split, bytes_)]
            assert got == [q for *_, q, _ in rows], split
        assert sorted(r.qname for r in bam.bam(spark, path, 5000).collect()) == sorted(q for *_, q, _ in rows)
        index_ = bam.linear_index(spark, path, 20_000)
        for ref, start, end in (("A", 30_000, 30_400), ("B", 0, 2000), ("B", 79_000, 90_000), ("A", 60_000, 70_000)):
            found = bam.fetch_blocks(index_, ref, start, end)
            want = [q for r, p, q, n in rows if "AB"[r] == ref and p < end and p + n > start]
            got = found.collect()
            assert sorted(r.qname for r in got) == sorted(want) and want
        # what lies before the first window and behind the region is not read
        with open(path, "rb") as f:
            blocks = [(b, r[2], r[3]) for b, _, r in bam.records(f)]
        used = {r.block for r in bam.fetch_blocks(index_, "B", 79_000, 90_000).collect()}
        assert min(used) > blocks[0][0] and used <= {b for b, ref, _ in blocks if ref == "B"}


def test_index(spark, tmp_path):
    seqs = spark.createDataFrame([("c", "ACGTTGCATGCATTGACCA"), ("short", "ACG")], "contig string, seq string")
    index.write_index(seqs, str(tmp_path / "i"), 8, seed=3)
    got = index.read_index(spark, str(tmp_path / "i"), 8, seed=3)
    assert got.count() > 20 and got.select("contig").distinct().count() == 1
    with pytest.raises(ValueError):
        index.read_index(spark, str(tmp_path / "i"), 9, seed=3)
    # a probe by many hashes leaves the index where it lies
    spark.sql(f"DROP TABLE {index._name(str(tmp_path / 'i'), 8, 3, 3)[1]}")  # as in another session
    again = index.read_index(spark, str(tmp_path / "i"), 8, seed=3)
    probe = again.join(got.select("h").distinct().hint("merge"), "h", "left_semi")
    assert probe.count() == got.count()
    probe = again.hint("merge").join(spark.range(5).withColumnRenamed("id", "h"), "h")
    plan = probe._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_input_checks(spark, tmp_path):
    ref, one, two = write(tmp_path / "r.fa", ">a"), write(tmp_path / "1.fq", "x"), str(tmp_path / "2.fq.gz")
    (tmp_path / "2.fq.gz").write_bytes(gzip.compress(b"x"))
    assert checks.input_problems(spark, ref, (one, one)) == [] and len(checks.input_problems(spark, ref, (one, two))) == 1
    with pytest.raises(ValueError, match="does not exist.*must not be compressed"):
        checks.check_inputs(spark, str(tmp_path / "no.fa.gz"), (one, one))


def test_annotation_and_designs(spark, tmp_path):
    rp = write(tmp_path / "rep.gff", "#x\nA_1 s region 1 900 . + .\nA_1 s repeat 5 9 . + .\n")
    assert [tuple(r) for r in S.repeat_regions(spark, rp).collect()] == [("A_1", 5, 9)]
    te = write(tmp_path / "tei.txt", "#x\nA_1\t10\t20\tIS3\n")
    assert [tuple(r) for r in S.mobile_elements(spark, te).collect()] == [("A_1", 10, 20)]
    (tmp_path / "p").mkdir()
    line = "k__B|p__P|c__C|o__O|f__F|g__G{0}|s__S{0}\t2|3\t{1}\n"
    write(tmp_path / "p" / "s1_profile.txt", "#v\n" + line.format(1, 2.5) + "k__B|p__P\t2\t9\n" + line.format(2, 0.5))
    write(tmp_path / "p" / "s2_profile.txt", line.format(2, 4.0))
    rows = S.profiles(spark, str(tmp_path / "p"))
    assert sorted(tuple(r) for r in rows.collect()) == [("s1", "s__S1", "g__G1", 2.5), ("s1", "s__S2", "g__G2", 0.5), ("s2", "s__S2", "g__G2", 4.0)]
    S.write_markers(["s__S1", "g__G2"], spark, str(tmp_path / "m"))
    got = S.marker_abundances(rows, S.read_markers(spark, str(tmp_path / "m"))).collect()
    assert sorted(tuple(r) for r in got) == [("s1", "g__G2", 0.5), ("s1", "s__S1", 2.5), ("s2", "g__G2", 4.0)]
    ko = write(tmp_path / "ko.txt", "ko:K1\nK2\n\n")
    assert sorted(r.ko for r in S.ko_list(spark, ko).collect()) == ["K1", "K2"]
    kp = write(tmp_path / "kp.txt", "ko:K1\tpath:map1\nko:K1\tpath:ko1\n")
    assert sorted(tuple(r) for r in S.ko_pathways(spark, kp).collect()) == [("K1", "ko1"), ("K1", "map1")]
    ve = write(tmp_path / "v.csv", ",sample,receptor,insert_locus,donor,delete_start,delete_end,reverse_flag,verified\n0,s,A,150,B,250,1000,True,Yes\n1,s,A,1,B,2,3,True,No\n")
    bins = S.verified_bins(S.verified_events(spark, ve))
    assert sorted((r.tag, r.role) for r in bins.collect()) == [("A&2", "ins"), ("A&2&B&10", "pair"), ("A&2&B&2", "pair"), ("B&10", "del"), ("B&10&A&2", "pair"), ("B&2", "del"), ("B&2&A&2", "pair")]
    rt = write(tmp_path / "runs.csv", "Run,L,P,x,y,z,Sample,q\nR1,PAIRED,ILLUMINA,x,y,z,g_S1,q\nR2,SINGLE,NANOPORE,x,y,z,S1,q\n")
    rows = S.runs(spark, rt)
    assert sorted(tuple(r) for r in rows.collect()) == [("R1", "S1", "ILLUMINA", "PAIRED"), ("R2", "S1", "NANOPORE", "SINGLE")]
    assert [tuple(r) for r in S.paired_runs(rows).collect()] == [("S1", "R1", "R2")]
    ds = write(tmp_path / "d.tsv", "Sample a b Individual Time\nS1 a b I1 4\n")
    assert [tuple(r) for r in S.design(spark, ds).collect()] == [("S1", "I1", 4)]
