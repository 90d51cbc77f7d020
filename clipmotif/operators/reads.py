"""Mapped reads: parsing of mapper lines, edits, and the cross-link events of three protocols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAPPERS = ("novoalign", "bowtie", "rmap")
PROTOCOLS = ("iCLIP", "hCLIP", "pCLIP")
READ = ("chrom", "start", "end", "name", "score", "strand", "seq", "mm")


def tokens(line: Column) -> Column:
    """Fields of a line: tabs part them, blanks after a tab belong to it, so that empty fields vanish."""
    return F.split(F.regexp_replace(F.trim(F.regexp_replace(line, "[\r\n]+$", "")), "^[ \t]+|[ \t]+$", ""), "\t[ \t]*")


def is_record(line: Column) -> Column:
    """Whether a line is neither blank nor a header or track line."""
    return ~line.rlike("^(#|browser|track)") & (F.trim(line) != "")


def parse_novoalign(lines: DataFrame) -> DataFrame:
    """Reads from novoalign's lines: at least 13 fields, the fifth of them U for uniquely mapped."""
    t = F.col("t")
    own = lines.where(is_record(F.col("line"))).select(tokens(F.col("line")).alias("t")).where((F.size(t) >= 13) & (F.get(t, 4) == "U"))
    return own.select(
        F.substring(F.get(t, 7), 2, 1 << 20).alias("chrom"), F.get(t, 8).try_cast("long").alias("start"), (F.get(t, 8).try_cast("long") + F.length(F.get(t, 2))).alias("end"), F.get(t, 0).alias("name"),
        F.get(t, 5).try_cast("double").alias("score"), F.when(F.get(t, 9) == "F", "+").otherwise("-").alias("strand"), F.get(t, 2).alias("seq"), F.coalesce(F.get(t, 13), F.lit("")).alias("mm"),
    )


def parse_bowtie(lines: DataFrame) -> DataFrame:
    """Reads from bowtie's lines: at least 7 fields; an eighth holds the edits, rewritten by ``bowtie_edits``."""
    t = F.col("t")
    own = lines.where(is_record(F.col("line"))).select(tokens(F.col("line")).alias("t")).where(F.size(t) >= 7)
    start = F.get(t, 3).try_cast("long") + 1
    mm = F.when(F.size(t) == 8, bowtie_edits(F.get(t, 7), F.get(t, 1), F.length(F.get(t, 4)))).otherwise("")
    return own.select(
        F.get(t, 2).alias("chrom"), start.alias("start"), (start + F.length(F.get(t, 4))).alias("end"), F.get(t, 0).alias("name"), F.get(t, 6).try_cast("double").alias("score"),
        F.get(t, 1).alias("strand"), F.get(t, 4).alias("seq"), mm.alias("mm"),
    )


def parse_rmap(lines: DataFrame) -> DataFrame:
    """Reads from BED lines of six fields or more; exactly eight also have the read and its edits, others "NA"."""
    t = F.col("t")
    own = lines.where(is_record(F.col("line"))).select(tokens(F.col("line")).alias("t")).where(F.size(t) >= 6)
    more = lambda i: F.when(F.size(t) == 8, F.get(t, i)).otherwise("NA")
    return own.select(
        F.get(t, 0).alias("chrom"), F.get(t, 1).try_cast("long").alias("start"), F.get(t, 2).try_cast("long").alias("end"), F.get(t, 3).alias("name"), F.get(t, 4).try_cast("double").alias("score"),
        F.get(t, 5).alias("strand"), more(6).alias("seq"), more(7).alias("mm"),
    )


PARSERS = {"novoalign": parse_novoalign, "bowtie": parse_bowtie, "rmap": parse_rmap}


def parse_reads(lines: DataFrame, mapper: str) -> DataFrame:
    """Reads from ``lines(line)`` of one of MAPPERS."""
    if mapper not in PARSERS:
        raise ValueError(f"unknown mapper {mapper!r}; known are {', '.join(MAPPERS)}")
    return PARSERS[mapper](lines)


def bowtie_edits(mm: Column, strand: Column, length: Column) -> Column:
    """bowtie's list "11:T>C,…" in the other mappers' form "12T>C …": positions from one, on the minus strand from the other end."""
    part = lambda x: F.split(x, ":")
    at = lambda x: part(x)[0].cast("long")
    one = lambda x: F.concat(F.when(strand == "-", length - at(x)).otherwise(at(x) + 1).cast("string"), F.element_at(part(x), 2))
    return F.array_join(F.transform(F.filter(F.split(F.coalesce(mm, F.lit("")), ","), lambda x: x.rlike("^[0-9]+:.+")), one), " ")


def edits(mm: Column) -> Column:
    """Array of structs (type, position, ref_base, read_base) of an edit list: "12T>C" a mutation, "9+AC" an insertion, "5-T" a deletion."""
    word = F.filter(F.split(F.coalesce(mm, F.lit("")), " "), lambda x: x.rlike("^[0-9]+([A-Za-z]+>[A-Za-z]+|[+-][A-Za-z]+)$"))

    def one(x: Column) -> Column:
        position = F.regexp_extract(x, "^([0-9]+)", 1).cast("int")
        rest = F.regexp_replace(x, "^[0-9]+", "")
        kind = F.when(F.contains(rest, F.lit(">")), "mutation").when(F.startswith(rest, F.lit("+")), "insertion").otherwise("deletion")
        bases = F.substring(rest, 2, 1 << 20)
        ref = F.when(kind == "mutation", F.substring_index(rest, ">", 1)).when(kind == "deletion", bases).otherwise("")
        read = F.when(kind == "mutation", F.substring_index(rest, ">", -1)).when(kind == "insertion", bases).otherwise("")
        return F.struct(kind.alias("type"), position.alias("position"), ref.alias("ref_base"), read.alias("read_base"))

    return F.transform(word, one)


def _hit(plus: tuple[str, str, str], minus: tuple[str, str, str], e: Column, strand: Column) -> Column:
    same = lambda k: (e["type"] == k[0]) & (F.upper(e["ref_base"]) == k[1]) & (F.upper(e["read_base"]) == k[2])
    return F.when(strand == "-", same(minus)).otherwise(same(plus))


def events(reads: DataFrame, protocol: str, mapper: str = "novoalign") -> DataFrame:
    """Rows (chrom, st, en, name, strand) of the cross-link events of ``reads``.

    iCLIP: the first position of each read, unless it has a deleted T (A on the minus strand): reads that
    run through.  hCLIP: the position of the read's only edit, a deleted T (A).  pCLIP: the position of the
    only edit, a T read as C (A as G).  rmap's lines have no edits and serve iCLIP alone.
    """
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown protocol {protocol!r}; known are {', '.join(PROTOCOLS)}")
    if mapper == "rmap" and protocol != "iCLIP":
        raise ValueError(f"{protocol} needs edits, which {mapper} does not report")
    e = edits(F.col("mm")) if mapper != "rmap" else F.array().cast("array<struct<type:string,position:int,ref_base:string,read_base:string>>")
    own = reads.select("chrom", "start", "name", "strand", e.alias("e"))
    deleted = (("deletion", "T", ""), ("deletion", "A", ""))
    changed = (("mutation", "T", "C"), ("mutation", "A", "G"))
    if protocol == "iCLIP":
        own = own.where(~F.exists("e", lambda x: _hit(*deleted, x, F.col("strand"))))
        st = F.col("start")
    else:
        kind = deleted if protocol == "hCLIP" else changed
        own = own.where((F.size("e") == 1) & _hit(*kind, F.get("e", 0), F.col("strand")))
        st = F.col("start") + F.get("e", 0)["position"] - F.when(F.col("strand") == "-", 1).otherwise(2)
    st = st.cast("long")
    return own.select("chrom", st.alias("st"), (st + 1).alias("en"), "name", "strand")
