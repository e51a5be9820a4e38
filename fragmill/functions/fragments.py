"""Expressions on labelled fragments: ``e3.linker.poi`` strings in which [*:2] marks the E3 cut and [*:1] the target cut."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE, TWO = "[*:1]", "[*:2]"


def _has(x: Column, label: str) -> Column:
    return F.contains(x, F.lit(label))


def split_roles(value: Column) -> Column:
    """struct(e3, linker, poi) by label content, not position: only for exactly three parts; a later part of a role wins."""
    parts = F.split(value, r"\.")
    last = lambda keep: F.when(F.size(parts) == 3, F.try_element_at(F.filter(parts, keep), F.lit(-1)))
    return F.struct(
        last(lambda p: _has(p, TWO) & ~_has(p, ONE)).alias("e3"),
        last(lambda p: _has(p, ONE) & _has(p, TWO)).alias("linker"),
        last(lambda p: _has(p, ONE) & ~_has(p, TWO)).alias("poi"),
    )


def split_positions(value: Column) -> Column:
    """struct(e3, linker, poi) by position; missing places are null."""
    parts = F.split(value, r"\.")
    return F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("e3", "linker", "poi"))])


def three_parts(value: Column) -> Column:
    """Exactly two dots; null is false."""
    return F.coalesce(F.regexp_count(value, F.lit(r"\.")) == 2, F.lit(False))


def all_attachment_points(value: Column) -> Column:
    """Each of both labels exactly twice; null is false."""
    n = lambda label: F.regexp_count(value, F.lit(label))
    return F.coalesce((n(r"\[\*:1\]") == 2) & (n(r"\[\*:2\]") == 2), F.lit(False))


def swap_labels(value: Column) -> Column:
    """The two labels exchanged."""
    mark = F.replace(value, F.lit(ONE), F.lit("[*:x]"))
    return F.replace(F.replace(mark, F.lit(TWO), F.lit(ONE)), F.lit("[*:x]"), F.lit(TWO))


def rename_label(value: Column, old: int, new: int) -> Column:
    """[*:old] and [old*] as [*:new]."""
    return F.regexp_replace(value, rf"\[\*:{old}\]|\[{old}\*\]", f"[*:{new}]")


def first_label(value: Column) -> Column:
    """The number of the first labelled attachment point, null if there is none."""
    found = F.regexp_extract(value, r"\[\*:(\d+)\]", 1)
    return F.when(found != "", found.cast("int"))


def join_roles(e3: Column, linker: Column, poi: Column) -> Column:
    """``e3.linker.poi``; null if any is null."""
    return F.concat(e3, F.lit("."), linker, F.lit("."), poi)


def label_projection(value: Column, what: str) -> Column:
    """The ligands (``e3.poi``) or the linker of a label; null where a role is missing."""
    r = split_roles(value)
    if what == "linker":
        return r["linker"]
    if what == "ligands":
        return F.concat(r["e3"], F.lit("."), r["poi"])
    raise ValueError(f"what must be linker or ligands, not {what}")


def bare(value: Column) -> Column:
    """Without attachment points."""
    return F.regexp_replace(value, r"\[\*:\d+\]", "")


def clean_text(value: Column) -> Column:
    """Without sentence marks of a decoder."""
    return F.trim(F.regexp_replace(value, r"</?s>", ""))


def notes_entries(value: Column) -> Column:
    """``(key=value)`` notes as an array of (key, value, kind); kind is int, bool, none or string. Repeated keys: the last."""
    keys = F.regexp_extract_all(value, F.lit(r"\(([A-Za-z_]+)=([^)]*)\)"), 1)
    values = F.regexp_extract_all(value, F.lit(r"\(([A-Za-z_]+)=([^)]*)\)"), 2)
    kind = lambda v: F.when(v.rlike(r"^\d+$"), "int").when(F.lower(v).isin("true", "false"), "bool").when(F.lower(v) == "none", "none").otherwise("string")
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value"), kind(v).alias("kind")))
    return F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), x["key"]))


def mol_id(*values: Column) -> Column:
    """A content hash of the given strings; null if any is null."""
    return F.sha2(F.concat(*[x for v in values for x in (v, F.lit("|"))]), 256)


def heavy_atoms(value: Column) -> Column:
    """Atoms other than hydrogen and attachment points, counted on the string; -1 for null."""
    rest = F.regexp_replace(value, r"\[\*:\d+\]|\[H\]|\*", "")
    return F.coalesce(F.regexp_count(rest, F.lit(r"\[[^\]]*\]|Cl|Br|[BCNOPSFIbcnops]")), F.lit(-1))
