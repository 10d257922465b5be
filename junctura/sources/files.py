"""Readers and writers of the domain's file formats, as DataFrames with explicit schemas.

Large line formats (reads, alignments, tables) stay splittable text scans; formats whose record spans lines are read by
a record separator, so that every record is complete in one row. Nothing is collected; headers are read as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import read_id
from .ranges import reads

ACC_COLUMNS = (
    "from_ref string, from_pos long, from_side string, from_strand string, to_ref string, to_pos long, to_side string, to_strand string, if_reverse string, "
    "read_seq string, ref_seq string, similarity double, from_split_reads int, to_split_reads int, cross_split_reads int, pair_end int"
)
RAW_COLUMNS = "ref1 string, pos1 long, left1 long, right1 long, ref2 string, pos2 long, left2 long, right2 long, support long, reverse string"
EVENT_COLUMNS = ("sample", "receptor", "insert_locus", "donor", "delete_start", "delete_end", "reverse_flag")
M6_COLUMNS = "query string, subject string, identity double, length int, mismatches int, gaps int, q_start int, q_end int, s_start int, s_end int, evalue double, bitscore double"
PAF_COLUMNS = "qname string, qlen long, qstart long, qend long, strand string, tname string, tlen long, tstart long, tend long, matches long, block long, mapq int"
GFF_COLUMNS = "contig string, source string, type string, g_start long, g_end long, score string, strand string, phase string, attrs string"


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig (up to the first slash, blank or tab), seq, len. A record is the text between two `>` at line starts."""
    records = spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "")
    head = F.regexp_extract("value", "^>?([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n?", ""), "[\r\n]", "")
    return records.select(read_id(head).alias("contig"), seq.alias("seq")).withColumn("len", F.length("seq").cast("long"))


def fastq(spark: SparkSession, path: str, mate: int = 1) -> DataFrame:
    """read_name, mate, seq and qual of four-line records, from byte ranges of the files."""
    return reads(spark, path, mate)


def read_pairs(one: DataFrame, two: DataFrame) -> DataFrame:
    """Mates joined by name: read_name, seq1, seq2."""
    return one.select("read_name", F.col("seq").alias("seq1")).join(two.select("read_name", F.col("seq").alias("seq2")), "read_name")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments with 1-based positions turned to 0-based ones, and tags as a map from name to value."""
    parts = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))
    f = F.col("f")
    # tags are NAME:TYPE:VALUE
    tags = F.map_from_entries(F.transform(F.slice(f, 12, 1000), lambda t: F.struct(F.substring(t, 1, 2), F.regexp_replace(t, "^[^:]*:[^:]*:", ""))))
    return parts.filter(F.size("f") >= 11).select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("ref"), (f[3].cast("long") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"),
        f[6].alias("mate_ref"), (f[7].cast("long") - 1).alias("mate_pos"), f[8].cast("long").alias("tlen"), f[9].alias("seq"), tags.alias("tags"),
    )


def split_alignments(alignments: DataFrame) -> DataFrame:
    """Alignments with exactly one supplementary entry: sa_ref, sa_pos (0-based), sa_strand, sa_cigar, sa_mapq."""
    entries = F.filter(F.split(F.col("tags")["SA"], ";"), lambda x: x != "")
    e = F.split(entries[0], ",")
    return alignments.filter(F.size(entries) == 1).select("*", e[0].alias("sa_ref"), (e[1].cast("long") - 1).alias("sa_pos"), e[2].alias("sa_strand"), e[3].alias("sa_cigar"), e[4].cast("int").alias("sa_mapq"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end of lines `contig:start-end`."""
    pattern = "^(.*):([0-9]+)-([0-9]+)\\s*$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    return spark.read.text(path).filter(F.col("value").rlike(pattern)).select(part(1).alias("contig"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))


def write_bed(df: DataFrame, path: str) -> None:
    """Intervals clamped to start at 1; those under 50 bases are left out."""
    start = F.greatest("start", F.lit(1).cast("long"))
    df.withColumn("start", start).filter("end - start >= 50").select(F.concat("contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("value")).write.text(path)


def sample_of(path_column: str = "_metadata.file_name", suffix: str = ".acc.csv"):
    return F.regexp_replace(F.col(path_column), suffix.replace(".", "\\.") + "$", "")


def acc_breakpoints(spark: SparkSession, path: str) -> DataFrame:
    """Breakpoints of one file or a folder of them: sample (from the file's name), the columns and reads_num (from the
    comment line). Files named `.repeat.acc.csv` are left out."""
    rows = spark.read.schema(ACC_COLUMNS).option("header", True).option("comment", "#").csv(path).select("*", sample_of().alias("sample"), F.col("_metadata.file_name").alias("__f"))
    head = spark.read.text(path).filter(F.col("value").startswith("#")).select(sample_of().alias("sample"), F.regexp_extract("value", "sample is:? *([0-9]+)", 1).cast("long").alias("reads_num"))
    return rows.filter(~F.col("__f").endswith(".repeat.acc.csv")).drop("__f").join(head, "sample", "left")


def write_acc(df: DataFrame, path: str, reads_num: int, insert_size: int) -> None:
    """One sample's breakpoints as acc_breakpoints() reads them: each file of the folder has the comment line with the number
    of reads and the insert size, the names of the columns, and its rows."""
    names = [c.split()[0] for c in ACC_COLUMNS.split(", ")]
    head = f"# the number of reads in the sample is: {reads_num}; Insert size is {insert_size}.\n{','.join(names)}\n"
    body = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    # a partition's first row brings the head with it
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    df.select(F.when(first, F.concat(F.lit(head), body)).otherwise(body).alias("value")).write.text(path)


def raw_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Raw clusters; lines without exactly ten fields are dropped."""
    f = F.transform(F.split("value", ","), lambda x: F.trim(x))
    kinds = [c.split() for c in RAW_COLUMNS.split(", ")]
    lines = spark.read.text(path).select(f.alias("f")).filter(F.size("f") == len(kinds))
    return lines.select(*[F.col("f")[i].try_cast(k).alias(n) for i, (n, k) in enumerate(kinds)])


def events(spark: SparkSession, path: str) -> DataFrame:
    """Events by the header's names, with or without a leading index column."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.col(c).cast("long").alias(c) if c in ("insert_locus", "delete_start", "delete_end") else F.col(c) for c in EVENT_COLUMNS])


def truth(spark: SparkSession, path: str) -> DataFrame:
    """receptor, insert_locus, donor, delete_start, delete_end, reverse_flag of blank-separated lines."""
    f = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).select(f.alias("f")).filter(F.size("f") >= 6).selectExpr("f[0] AS receptor", "cast(f[1] AS long) AS insert_locus", "f[2] AS donor", "cast(f[3] AS long) AS delete_start", "cast(f[4] AS long) AS delete_end", "f[5] AS reverse_flag")


def write_truth(df: DataFrame, path: str) -> None:
    """Events as truth() reads them."""
    names = ("receptor", "insert_locus", "donor", "delete_start", "delete_end", "reverse_flag")
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in names]).alias("value")).write.text(path)


def competitor_calls(spark: SparkSession, path: str) -> DataFrame:
    """sample, cref1, cpos1, cref2, cpos2 of another caller's tables, one a sample: comma-separated, the ends in the first four
    fields. A line with the ends of the line before it is left out."""
    from ..operators.order import consecutive_distinct

    f = F.split("value", ",")
    lines = spark.read.text(path).select(F.regexp_replace("_metadata.file_name", "\\.[^.]*$", "").alias("sample"), F.monotonically_increasing_id().alias("line"), f.alias("f"))
    place = lambda k: F.col("f")[k].try_cast("long")
    rows = lines.filter((F.size("f") >= 4) & (F.col("f")[0] != "from_ref")).select("sample", "line", F.col("f")[0].alias("cref1"), place(1).alias("cpos1"), F.col("f")[2].alias("cref2"), place(3).alias("cpos2"))
    return consecutive_distinct(rows, ["sample"], ["line"], ["cref1", "cpos1", "cref2", "cpos2"]).drop("line")


def _tabbed(spark: SparkSession, path: str, schema: str, comment: str = "#") -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("comment", comment).option("quote", "").csv(path)


def blast_m6(spark: SparkSession, path: str) -> DataFrame:
    return _tabbed(spark, path, M6_COLUMNS)


def paf(spark: SparkSession, path: str) -> DataFrame:
    return _tabbed(spark, path, PAF_COLUMNS)


def gff(spark: SparkSession, path: str) -> DataFrame:
    """Features but whole regions."""
    return _tabbed(spark, path, GFF_COLUMNS).filter("type <> 'region' AND g_start IS NOT NULL")


def kraken(spark: SparkSession, path: str) -> DataFrame:
    """pct, reads and name of report lines."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(f.alias("f")).filter(F.size("f") >= 6).select(F.trim(F.col("f")[0]).cast("double").alias("pct"), F.col("f")[1].cast("long").alias("reads"), F.trim(F.element_at("f", -1)).alias("name"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """genome and lineage of a table with these headers."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select(F.col("Genome").alias("genome"), F.col("Lineage").alias("lineage"))


def phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """Samples with full_disease as a list."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select("sample", "cohort", "disease", F.split("full_disease", ";").alias("full_disease"), F.col("bases").cast("long"))


def abundances(spark: SparkSession, path: str) -> DataFrame:
    """lineage, sample, abundance of a wide table whose first header cell is empty."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    first, *samples = wide.columns
    return wide.withColumnRenamed(first, "lineage").unpivot("lineage", samples, "sample", "abundance").withColumn("abundance", F.col("abundance").cast("double"))


def time_logs(spark: SparkSession, path: str) -> DataFrame:
    """file, cpu_hours, wall_hours, peak_gb of verbose timing logs."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "^\\s+|\\s+$", "").alias("v"))
    value = lambda prefix: F.max(F.when(F.col("v").startswith(prefix), F.regexp_extract("v", ": ([0-9.:]+)$", 1)))
    got = lines.groupBy("file").agg(value("User time").alias("user"), value("System time").alias("system"), value("Elapsed").alias("wall"), value("Maximum resident").alias("peak"))
    # h:mm:ss or m:ss, by the number of fields
    wall = F.aggregate(F.split("wall", ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.cast("double"))
    return got.select("file", ((F.col("user").cast("double") + F.col("system").cast("double")) / 3600).alias("cpu_hours"), (wall / 3600).alias("wall_hours"), (F.col("peak").cast("double") / 1048576).alias("peak_gb"))


def write_events(df: DataFrame, path: str) -> None:
    df.select(*EVENT_COLUMNS).write.option("header", True).csv(path)


def write_raw(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(", ", *[F.col(c.split()[0]).cast("string") for c in RAW_COLUMNS.split(", ")]).alias("value")).write.text(path)


# --- annotation, designs and markers ------------------------------------------------------------------------------


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """f: the blank-separated fields of lines that are no comments."""
    return spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), "\\s+").alias("f"))


def repeat_regions(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end of tandem repeats, whole regions left out."""
    f = F.col("f")
    return _fields(spark, path).filter((F.size("f") >= 5) & (f[2] != "region")).select(f[0].alias("contig"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"))


def mobile_elements(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end of transposable elements: the first three fields of each line."""
    f = F.col("f")
    return _fields(spark, path).filter((F.size("f") >= 3) & (f[2] != "region")).select(f[0].alias("contig"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """sample, species, genus, abundance of one taxonomic profile a sample; the sample is the file's name up to the first
    underscore. Lineages of fewer than six levels are left out."""
    lines = spark.read.text(path).select("value", F.regexp_extract("_metadata.file_name", "^[^_]*", 0).alias("sample"))
    f = F.split(F.trim("value"), "\\s+")
    rows = lines.filter(~F.col("value").startswith("#")).select("sample", F.split(f[0], "\\|").alias("l"), f[2].try_cast("double").alias("abundance"))
    return rows.filter(F.size("l") >= 6).select("sample", F.element_at("l", -1).alias("species"), F.element_at("l", -2).alias("genus"), "abundance")


def marker_abundances(rows: DataFrame, markers: DataFrame) -> DataFrame:
    """sample, marker, abundance of profiles(): each row counts for its species if that is a marker, else for its genus."""
    own = markers.select("marker").distinct()
    one = rows.join(own.select(F.col("marker").alias("species"), F.col("marker").alias("m1")), "species", "left")
    two = one.join(own.select(F.col("marker").alias("genus"), F.col("marker").alias("m2")), "genus", "left")
    return two.withColumn("marker", F.coalesce("m1", "m2")).filter("marker is not null").groupBy("sample", "marker").agg(F.sum("abundance").alias("abundance"))


def ko_list(spark: SparkSession, path: str) -> DataFrame:
    """ko of a list with one identifier a line, with or without its prefix."""
    return spark.read.text(path).select(F.regexp_replace(F.trim("value"), "^ko:", "").alias("ko")).filter("ko <> ''")


def ko_pathways(spark: SparkSession, path: str) -> DataFrame:
    """ko, pathway of a tab-separated table, prefixes left off."""
    f = F.split("value", "\t")
    bare = lambda c: F.regexp_replace(F.trim(c), "^(ko|path):", "")
    return spark.read.text(path).filter(F.size(f) >= 2).select(bare(f[0]).alias("ko"), bare(f[1]).alias("pathway")).distinct()


def verified_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with a last field Yes: sample, the event's columns and event (a hash of the row)."""
    f = F.split("value", ",")
    rows = spark.read.text(path).filter((F.size(f) >= 9) & (f[1] != "sample") & (F.trim(F.element_at(f, -1)) == "Yes"))
    return rows.select(
        F.xxhash64("value").alias("event"), f[1].alias("sample"), f[2].alias("receptor"), f[3].cast("long").alias("insert_locus"), f[4].alias("donor"), f[5].cast("long").alias("delete_start"), f[6].cast("long").alias("delete_end"), f[7].alias("reverse_flag"),
    )


def verified_bins(rows: DataFrame, size: int = 100) -> DataFrame:
    """sample, tag, event, role of verified events: the bins of both contigs (ins, del), and those of the two junctions in
    either spelling (pair)."""
    from ..functions.columns import bin_even, hgt_tag

    one = lambda ref, pos, role: F.struct(F.concat_ws("&", ref, bin_even(F.col(pos), size).cast("string")).alias("tag"), F.lit(role).alias("role"))
    pair = lambda a, x, b, y: F.struct(hgt_tag(F.col(a), F.col(x), F.col(b), F.col(y), size, True).alias("tag"), F.lit("pair").alias("role"))
    tags = [one("receptor", "insert_locus", "ins")]
    for end in ("delete_start", "delete_end"):
        tags += [one("donor", end, "del"), pair("receptor", "insert_locus", "donor", end), pair("donor", end, "receptor", "insert_locus")]
    return rows.select("sample", "event", F.explode(F.array(*tags)).alias("x")).select("sample", "x.tag", "event", "x.role").distinct()


def runs(spark: SparkSession, path: str) -> DataFrame:
    """run, sample (behind an underscore, if its name has one), platform and layout (PAIRED or SINGLE) of a run table."""
    f = F.split("value", ",")
    name = F.element_at(f, -2)
    sample = F.when(name.contains("_"), F.split(name, "_")[1]).otherwise(name)
    layout = F.when(F.col("value").contains("PAIRED"), "PAIRED").when(F.col("value").contains("SINGLE"), "SINGLE")
    return spark.read.text(path).filter((F.size(f) >= 6) & (f[0] != "Run")).select(f[0].alias("run"), sample.alias("sample"), F.element_at(f, -6).alias("platform"), layout.alias("layout"))


def paired_runs(rows: DataFrame) -> DataFrame:
    """sample, short_run, long_run: the runs of paired and of single reads of one sample."""
    part = lambda layout, name: rows.filter(F.col("layout") == layout).select("sample", F.col("run").alias(name))
    return part("PAIRED", "short_run").join(part("SINGLE", "long_run"), "sample")


def design(spark: SparkSession, path: str) -> DataFrame:
    """sample, individual, time_point of a table whose fourth and fifth fields these are."""
    f = F.col("f")
    return _fields(spark, path).filter((F.size("f") >= 5) & (f[0] != "Sample")).select(f[0].alias("sample"), f[3].alias("individual"), f[4].cast("int").alias("time_point"))


def write_markers(markers: list[str], spark: SparkSession, path: str) -> None:
    """A list of markers in its order."""
    spark.createDataFrame(list(enumerate(markers)), "rank int, marker string").write.mode("overwrite").parquet(path)


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("rank", "marker")
