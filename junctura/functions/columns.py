"""Column functions of the domain: names, tags, bins, sequences, alignments' CIGAR strings and classifiers.

All are built-in Spark expressions; they stay inside code generation and need no user functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def genome(contig: Column) -> Column:
    """The contig's name without its last `_token`."""
    return F.regexp_replace(contig, "_[^_]*$", "")


def pair_tag(a: Column, b: Column, sep: str = "&") -> Column:
    """Both names in order, joined."""
    return F.concat(F.least(a, b), F.lit(sep), F.greatest(a, b))


def bin_trunc(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("long")


def bin_even(pos: Column, size: int) -> Column:
    """The nearest bin, halves to the even one."""
    return F.bround((pos / size).cast("double"), 0).cast("long")


def hgt_tag(ref1: Column, pos1: Column, ref2: Column, pos2: Column, size: int = 100, even: bool = False) -> Column:
    cut = bin_even if even else bin_trunc
    return F.concat_ws("&", ref1, cut(pos1, size).cast("string"), ref2, cut(pos2, size).cast("string"))


def event_tag(receptor: Column, insert: Column, donor: Column, start: Column, end: Column, size: int = 100, legacy: bool = False) -> Column:
    """The tag of an event's bins, halves to the even one; legacy repeats the insertion in the last place."""
    last = insert if legacy else end
    return F.concat_ws("&", receptor, bin_even(insert, size).cast("string"), donor, bin_even(start, size).cast("string"), bin_even(last, size).cast("string"))


def lineage_level(lineage: Column, level: int) -> Column:
    """Level 1 is the phylum, 6 the species."""
    return F.split(lineage, ";")[level]


def annotated(taxon: Column) -> Column:
    """False for a bare prefix as `g__`."""
    return F.length(taxon) > 3


def taxon_refined(taxon: Column) -> Column:
    """The name without suffixes as `_A` behind its parts."""
    return F.regexp_replace(taxon, "(?<=[a-z0-9])_[A-Z]+\\b", "")


# fixed values: complements of bases and of ambiguity codes
BASES = ("ACGTacgtRYMKrymkVBHDvbhd", "TGCAtgcaYRKMyrkmBVDHbvdh")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), *BASES)


def count_n(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(F.upper(seq), "N", ""))).cast("long")


def gc_content(seq: Column) -> Column:
    upper = F.upper(seq)
    return (F.length(upper) - F.length(F.translate(upper, "GC", ""))) / F.length(upper).cast("double")


def window_of(seq: Column, start: Column, end: Column) -> Column:
    """The 0-based half-open slice; a start below 1 is set to 1."""
    first = F.greatest(start, F.lit(1))
    return F.substring(seq, (first + 1).cast("int"), F.greatest(end - first, F.lit(0)).cast("int"))


def read_id(name: Column) -> Column:
    """The read's name up to the first slash, blank or tab, without its mark."""
    return F.regexp_extract(name, "^[@>]?([^/ \\t]+)", 1)


# --- alignments ---------------------------------------------------------------------------------------------------

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, DUPLICATE, SUPPLEMENTARY = 1, 2, 4, 8, 16, 32, 64, 1024, 2048


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def proper_pair(flag: Column, tlen: Column) -> Column:
    """Proper, mapped with its mate, neither supplementary nor duplicate, 0 < tlen < 1000."""
    bad = SUPPLEMENTARY | DUPLICATE | UNMAPPED | MATE_UNMAPPED
    return has(flag, PAIRED) & has(flag, PROPER) & ~has(flag, bad) & (tlen > 0) & (tlen < 1000)


def _sum_lengths(cigar: Column, pattern: str) -> Column:
    numbers = F.regexp_extract_all(cigar, F.lit(pattern), F.lit(1))
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def cigar_query_span(cigar: Column, reverse: Column) -> Column:
    """struct(start, end): 0-based first and last query base of the aligned part, in read orientation.

    A leading (for reverse alignments: trailing) clip shifts the start; M and I extend the span."""
    left = F.coalesce(F.nullif(F.regexp_extract(cigar, "^([0-9]+)[SH]", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    right = F.coalesce(F.nullif(F.regexp_extract(cigar, "([0-9]+)[SH]$", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    start = F.when(reverse, right).otherwise(left)
    return F.struct(start.alias("start"), (start + _sum_lengths(cigar, "([0-9]+)[MI]") - 1).alias("end"))


def span_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(a.end, b.end) - F.greatest(a.start, b.start) + 1)


def reference_length(cigar: Column) -> Column:
    return _sum_lengths(cigar, "([0-9]+)[MDN=X]")


def clip_side(cigar: Column) -> Column:
    """right if the trailing clip is longer than the leading one, else left."""
    left = F.coalesce(F.nullif(F.regexp_extract(cigar, "^([0-9]+)[SH]", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    right = F.coalesce(F.nullif(F.regexp_extract(cigar, "([0-9]+)[SH]$", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return F.when(right > left, "right").otherwise("left")


def segment_to_global(ref: Column, pos: Column) -> Column:
    """Position on the contig of a position on a segment named contig:start-end."""
    return F.coalesce(F.nullif(F.regexp_extract(ref, ":([0-9]+)-[0-9]+$", 1), F.lit("")).cast("long"), F.lit(0).cast("long")) + pos


def segment_contig(ref: Column) -> Column:
    return F.regexp_extract(ref, "^([^:]+)", 1)


def at_segment_end(ref: Column, pos: Column, near: int = 15) -> Column:
    """Within near bases of the segment's end, or of its start if that is not the contig's own start."""
    start = F.regexp_extract(ref, ":([0-9]+)-", 1).cast("long")
    end = F.regexp_extract(ref, "-([0-9]+)$", 1).cast("long")
    return ((pos < near) & (start > 100)) | (end - start - pos < near)


# --- annotation ---------------------------------------------------------------------------------------------------


def attributes(attrs: Column) -> Column:
    """`k=v;k=v` as a map."""
    return F.str_to_map(attrs, F.lit(";"), F.lit("="))


def ko_list(attrs: Column) -> Column:
    return F.transform(F.split(attributes(attrs)["KEGG"], ","), lambda x: F.regexp_replace(x, "^ko:", ""))


# fixed values: keyword patterns of product classes; of several that match, the last counts
PRODUCT_CLASSES = (
    ("plasmid", r"relax\S*|conjug\S*|mob\S*|plasmid|type IV|chromosome partitioning|chromosome segregation"),
    ("phage", r"capsid|phage|tail|head|tape measure|antiterminatio"),
    ("transposon", r"transpos\S*|insertion|Tra[A-Z]|Tra[0-9]|IS[0-9]|conjugate transposon"),
    ("Other_HGT_mechanisms", r"integrase|excision\S*|exonuclease|recomb|toxin|restrict\S*|resolv\S*|topoisomerase|reverse transcrip"),
    ("CAZYmes", r"glycosyltransferase|glycoside hydrolase|xylan|monooxygenase|rhamnos\S*|cellulose|sialidase|\S*ose($|\s|\-)|acetylglucosaminidase|cellobiose|galact\S*|fructose|aldose|starch|mannose|mannan\S*|glucan|lyase|glycosyltransferase|glycosidase|pectin|SusD|SusC|fructokinase|galacto\S*|arabino\S*"),
    ("ARG", r"azole resistance|antibiotic resistance|TetR|tetracycline resistance|VanZ|betalactam\S*|beta-lactam|antimicrob\S*|lantibio\S*"),
)


def product_class(product: Column) -> Column:
    """The class of a product by its keywords (in their own case); unclassified if none matches."""
    out = F.lit("unclassified")
    for name, pattern in PRODUCT_CLASSES:
        out = F.when(product.rlike(pattern), name).otherwise(out)
    return out


def is_insertion_sequence(product: Column) -> Column:
    return product.rlike("IS[0-9]")


def hit_class(evalue: Column, length: Column, full: Column) -> Column:
    """A: over nine tenths of the element, B: over 100 bases, C: other; null beyond the e-value's bound."""
    return F.when(evalue < 1e-5, F.when(length / full.cast("double") > 0.9, "A").when(length > 100, "B").otherwise("C"))


def mechanism(tei: Column, vntr: Column, inserted: Column, homology: Column) -> Column:
    """Mechanism of a junction from its evidence, in order of precedence."""
    return (
        F.when(tei, "TEI").when(vntr, "VNTR").when(inserted > 10, "FoSTeS/MMBIR").when(inserted > 0, "NHEJ").when(homology > 100, "NAHR").when(homology >= 2, "alt-EJ").otherwise("NHEJ")
    )


def flank(pos: Column, length: Column, size: int = 5000) -> Column:
    return F.struct(F.greatest(pos - size, F.lit(1)).alias("start"), F.least(pos + size, length).alias("end"))


# --- breakpoints --------------------------------------------------------------------------------------------------


def refined_ends(row_prefixes: tuple[str, str] = ("from", "to")) -> Column:
    """struct of both ends after unifying sides and strands: right is tail and left is head; a (+, tail) from-end swaps
    the ends; then a (-, head) from-end becomes + and the other strand flips (all but + become +)."""
    a, b = row_prefixes
    side = lambda c: F.when(F.col(c) == "right", "tail").when(F.col(c) == "left", "head").otherwise(F.col(c))
    swap = (F.col(f"{a}_strand") == "+") & (side(f"{a}_side") == "tail")

    def pick(name: str, first: str, second: str) -> Column:
        x, y = (side(f"{first}_side"), side(f"{second}_side")) if name == "side" else (F.col(f"{first}_{name}"), F.col(f"{second}_{name}"))
        return F.when(swap, y).otherwise(x)

    fs, ts = pick("side", a, b), pick("side", b, a)
    fd, td = pick("strand", a, b), pick("strand", b, a)
    turn = (fd == "-") & (fs == "head")
    return F.struct(
        pick("ref", a, b).alias("from_ref"), pick("pos", a, b).alias("from_pos"), fs.alias("from_side"), F.when(turn, "+").otherwise(fd).alias("from_strand"),
        pick("ref", b, a).alias("to_ref"), pick("pos", b, a).alias("to_pos"), ts.alias("to_side"),
        F.when(turn, F.when(td == "+", "-").otherwise("+")).otherwise(td).alias("to_strand"),
    )
