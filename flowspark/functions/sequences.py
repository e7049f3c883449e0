"""Sequences, weighted identifiers and primers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases that a degenerate code stands for.
IUPAC = {"R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def iupac_pattern(primer: str) -> str:
    """A primer as a regular expression."""
    return "".join(f"[{IUPAC[c.upper()]}]" if c.upper() in IUPAC else re.escape(c) for c in primer)


def iupac_column(primer: str | Column) -> Column:
    """The same on a column."""
    out = F.upper(primer)
    marks = {code: chr(0xE000 + k) for k, code in enumerate(IUPAC)}  # codes stand in each other's classes
    out = F.translate(out, "".join(IUPAC), "".join(marks.values()))
    for code, bases in IUPAC.items():
        out = F.replace(out, F.lit(marks[code]), F.lit(f"[{bases}]"))
    return out


def truncate_tag(seq: str, tag: str, length: int) -> Column:
    """The sequence up to length, without the tag (its leading Gs aside) where it starts with it."""
    tag = tag.lstrip("G")
    return F.when(F.col(seq).startswith(tag), F.substring(seq, len(tag) + 1, max(0, length - len(tag)))).otherwise(F.substring(seq, 1, length))


def parse_tag(seq: str, tag: str, length: int) -> Column:
    """What follows the tag wherever it stands, up to length; empty where it is absent."""
    return F.substring(F.regexp_extract(seq, f"{iupac_pattern(tag.lstrip('G'))}(.*)", 1), 1, length)


def strip_primer(seq: str, primer: str) -> Column:
    return F.regexp_replace(seq, f"^{iupac_pattern(primer)}", "")


_WEIGHTED = r"^(.*?)_(\d+)_(\d+)$"


def parse_wheader(header: str | Column) -> Column:
    """id, index and frequency of <id>_<index>_<frequency>; anything else is an error."""
    header = F.col(header) if isinstance(header, str) else header
    part = lambda k: F.regexp_extract(header, _WEIGHTED, k)
    whole = F.struct(part(1).alias("id"), part(2).cast("int").alias("index"), part(3).cast("int").alias("frequency"))
    return F.when(header.rlike(_WEIGHTED), whole).otherwise(F.raise_error(F.concat(F.lit("no weighted header: "), header)).cast("struct<id:string,index:int,frequency:int>"))


def read_weight(header: str | Column) -> Column:
    """The number behind the last underscore, or 1."""
    header = F.col(header) if isinstance(header, str) else header
    return F.coalesce(F.regexp_extract(header, r"_([0-9.]+)$", 1).try_cast("double"), F.lit(1.0))


def accepted(line: str | Column, alphabet: str = "ACGT") -> Column:
    """A line up to its first character outside the alphabet."""
    return F.regexp_extract(line, f"^[{alphabet}]*", 0)


def wrap(seq: str | Column, width: int = 80) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def logistic(x: Column, y: Column, z: Column, alpha: float = -7.5, beta: float = 0.5) -> Column:
    """Chance that a sequence with chimera index x, best distance y and score z is a chimera."""
    return F.when((x >= 0.15) | (y > 0), F.lit(0.0)).otherwise(1 / (1 + F.exp(-(F.lit(alpha) + F.lit(beta) * z))))
