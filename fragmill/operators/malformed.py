"""Rows that fail to parse: separated from the loadable ones, with the reason.

From a record schema one anchored pattern for whole rows is generated. Rows it matches have the right fields, and it
captures the judged ones, whose syntax is then checked as far as no pattern can state it (balanced parentheses, even
ring numbers). Only rows it misses pass through prefix patterns of the same schema, one field longer each: the first
that misses names the broken field, and what it leaves over is the reason.

All patterns use possessive character classes and no repeated group, so their cost is linear and their stack use
constant for rows of any length.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A doubled quote is rewritten to this noncharacter before matching, which makes the quoting rules regular without
# repeated groups. Should a record hold it itself (Unicode forbids that in interchange), it comes out as U+FFFD.
_PAIR = "\uffff"

#: The symbols of the elements.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo "
    "Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl "
    "Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
#: Symbols written in lower case in aromatic rings.
AROMATIC = ["se", "as", "te", "b", "c", "n", "o", "p", "s"]



def _symbols(names: list[str]) -> str:
    """A pattern of all names, one class of second letters for each first letter."""
    second: dict[str, set[str]] = {}
    for x in names:
        second.setdefault(x[0], set()).add(x[1:])
    made = (k + (f"[{''.join(sorted(v - {''}))}]" if v - {""} else "") + ("?" if "" in v and v - {""} else "") for k, v in sorted(second.items()))
    return "|".join(made)


_SYMBOL = _symbols([*ELEMENTS, *AROMATIC])
_BRACKET = rf"\[[0-9]*(?:{_SYMBOL}|\*)@{{0,2}}(?:H[0-9]*)?(?:[+-][0-9]+|\++|-+)?(?::[0-9]+)?\]"
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"


@dataclass(frozen=True)
class FieldSpec:
    """A field's name, its Spark type and how its value is judged: not at all, as a molecule, or as a split molecule."""

    name: str
    type: str = "string"
    kind: str = "any"  # any, molecule, split


@dataclass(frozen=True)
class RecordSchema:
    """The fields of one feed, in order."""

    feed: str
    fields: tuple[FieldSpec, ...] = field(default_factory=tuple)


CURATED = RecordSchema(
    "curated",
    (
        FieldSpec("compound_id"),
        FieldSpec("protac_smiles", kind="molecule"),
        FieldSpec("e3_binder_smiles"),
        FieldSpec("poi_ligand_smiles"),
        FieldSpec("linker_smiles"),
        FieldSpec("notes"),
    ),
)
PREDICTION = RecordSchema(
    "prediction",
    (
        FieldSpec("smiles"),
        FieldSpec("default_pred_n0", kind="split"),
        FieldSpec("model_name"),
        FieldSpec("n_flags", "int"),
        FieldSpec("review_reasons"),
    ),
)

# One field, up to and without its comma: quoted, empty quoted, or without any quote.
_ANY = rf"(?:{_PAIR}*+\"[^\"]*+\"|{_PAIR}++|[^\",{_PAIR}]*+)"
_CHARS = r"[-A-Za-z0-9*\[\]()=#:/\\@+%.]"
_MOLECULE = rf"(?:\"{_SPACE}*+{_CHARS}++{_SPACE}*+\"|{_SPACE}*+{_CHARS}++{_SPACE}*+)"
_OUTSIDE = r"[^-A-Za-z0-9*\[\]()=#:/\\@+%.]++"
_SPLIT = rf"(?:\"{_SPACE}*+{_CHARS}*+{_SPACE}*+\"|{_PAIR}|{_SPACE}*+{_CHARS}*+{_SPACE}*+)"
_PATTERN = {"any": _ANY, "molecule": _MOLECULE, "split": _SPLIT}


def row_pattern(schema: RecordSchema) -> str:
    """The anchored pattern of a whole record (to which a closing comma was added)."""
    return r"\A" + "".join(_PATTERN[f.kind] + "," for f in schema.fields) + r"\z"


def captured_pattern(schema: RecordSchema, at: int) -> str:
    """The anchored pattern of a whole record that captures one field with its comma."""
    return r"\A" + "".join(f"({_PATTERN[f.kind]},)" if i == at else _PATTERN[f.kind] + "," for i, f in enumerate(schema.fields)) + r"\z"


def shape_pattern(fields: int) -> str:
    """The pattern of the first fields of any record, by quoting alone."""
    return r"\A" + (_ANY + ",") * fields


def prefix_patterns(schema: RecordSchema) -> list[str]:
    """Patterns of the first 1, 2, ... fields; the first that misses names the first broken field."""
    parts = [_PATTERN[f.kind] + "," for f in schema.fields]
    return [r"\A" + "".join(parts[: i + 1]) for i in range(len(parts))]


def strip_space(value: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(value, rf"\A{_SPACE}++|{_SPACE}++\z", "")


def skeleton(value: Column) -> Column:
    """A molecule string with each atom written as A; what is left over besides bonds, rings, dots and parentheses is no syntax."""
    bare = F.replace(F.replace(F.regexp_replace(value, _BRACKET, "*"), F.lit("Cl"), F.lit("C")), F.lit("Br"), F.lit("B"))
    return F.translate(bare, "BCNOPSFIbcnops*A", "A" * 15 + "!")


_SHAPE = r"(?:\A|\|)(?![/\\]*+A)|[^-A0-9()=#:/\\.%|]|%(?![0-9]{2})|\(\)|[-=#:/\\.](?:\||\z)"


def _pairs(bare: Column) -> Column:
    """The parentheses of a skeleton less innermost pairs, taken out a few times."""
    out = F.translate(bare, "A0123456789=#:/\\.%-", "")
    for _ in range(4):
        out = F.replace(out, F.lit("()"), F.lit(""))
    return out


def _balanced(pairs: Column) -> Column:
    """Whether nothing but boundaries is left of the parentheses; only deeper nesting is counted through."""
    step = lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
    deep = F.aggregate(
        F.split(pairs, ""),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda a, c: F.struct((a["d"] + step(c)).alias("d"), F.when((c == "|") & (a["d"] != 0), -1).otherwise(F.least(a["m"], a["d"] + step(c))).alias("m")),
        lambda a: (a["d"] == 0) & (a["m"] == 0),
    )
    return F.when(pairs.isin("", "||"), F.lit(True)).otherwise(deep)


def _even(digits: Column) -> Column:
    """Whether each digit occurs evenly."""
    odd = lambda d: (F.length(digits) - F.length(F.replace(digits, F.lit(d), F.lit("")))) % 2 == 1
    return ~reduce(lambda x, y: x | y, map(odd, "1234567890"))


def _even_rings(bare: Column) -> Column:
    """Whether each ring number of a skeleton without boundaries occurs evenly; %01 is 1."""
    # Sorted and joined, equal neighbours cancel, so nothing is left when each occurs evenly.
    rings = F.transform(F.regexp_extract_all(bare, F.lit(r"(%[0-9]{2}|[0-9])"), 1), lambda t: F.lpad(F.ltrim(t, F.lit("%")), 2, "0"))
    return F.regexp_replace(F.concat(F.array_join(F.sort_array(rings), ","), F.lit(",")), r"([0-9]{2}),\1,", "").isin("", ",")


def skeleton_ok(bare: Column) -> Column:
    """Whether a skeleton is well-formed. Use on a column or lambda variable: it is referred to many times."""
    return ~bare.rlike(_SHAPE) & ~F.contains(bare, F.lit("|")) & _balanced(_pairs(bare)) & _even_rings(bare)


def well_formed(value: Column) -> Column:
    """Whether a molecule string is well-formed: syntax only, neither valence nor aromaticity. Null is not."""
    return F.coalesce(F.forall(F.array(skeleton(value)), skeleton_ok), F.lit(False))


def joined(value: Column, kind: str) -> Column:
    """A judged value as one string whose molecules stand between bars; "!" for a split molecule of wrong shape."""
    if kind == "molecule":
        return value
    n = lambda x: F.length(value) - F.length(F.replace(value, F.lit(x), F.lit("")))
    shape = (n(".") == 2) & (n("[*:1]") == 10) & (n("[*:2]") == 10)
    return F.when((value == "") | shape, F.translate(value, ".", "|")).otherwise(F.lit("!"))


def _fields(text: Column) -> Column:
    """All fields of a record whose quoting is right, unquoted."""
    found = F.regexp_extract_all(text, F.lit(rf"\G({_ANY}),"), 1)
    body = F.transform(found, lambda x: F.when(x.startswith('"') | x.startswith(_PAIR), _unquote(x)).otherwise(x))
    return body


def _unquote(x: Column) -> Column:
    # The opening quote of a run of 2n+1 quotes is counted with its first pair: write pairs out as two quotes, drop
    # the outer two, then halve what is left.
    full = F.replace(x, F.lit(_PAIR), F.lit('""'))
    return F.replace(F.substring(full, F.lit(2), F.length(full) - 2), F.lit('""'), F.lit('"'))


def judge(df: DataFrame, schemas: tuple[RecordSchema, ...] = (CURATED, PREDICTION), feed: str = "feed", raw: str = "raw_line") -> DataFrame:
    """df with ``reason`` (null: loadable), ``broken_field`` (number of the first broken field, from 1) and ``parsed`` (its fields).

    Reasons, the first that holds: ``unknown_feed`` (no schema of that name, or null), ``quoting``, ``column_count``,
    ``invalid_value``. A null record has no field at all: ``column_count``. The empty record has one empty field.
    Columns of df are kept; those of the three names are replaced.
    """
    held = {"reason", "broken_field", "parsed"}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in held])
    safe = F.replace(F.coalesce(F.col(raw), F.lit("")), F.lit(_PAIR), F.lit("\ufffd"))
    text = F.concat(F.replace(safe, F.lit('""'), F.lit(_PAIR)), F.lit(","))
    name = F.coalesce(F.col(feed), F.lit(""))

    def by_feed(make, other):
        out = F.when(F.lit(False), other)
        for s in schemas:
            out = out.when(name == s.feed, make(s))
        return out.otherwise(other)

    staged = _bind(df, _text=text)
    t, none = F.col("_text"), F.lit(None).cast("string")
    # The whole-row pattern captures the judged fields with their comma, so what is captured is empty only where it misses.
    judged = {s.feed: [i for i, f in enumerate(s.fields) if f.kind != "any"] for s in schemas}
    most = max([len(x) for x in judged.values()] + [1])
    cells = range(most)
    cell = lambda j: by_feed(lambda s: F.regexp_extract(t, captured_pattern(s, (judged[s.feed] + [0] * most)[j]), 1), F.lit(""))
    staged = _bind(staged, **{f"_cell{j}": F.when(F.col(raw).isNotNull(), cell(j)).otherwise(F.lit("")) for j in cells})
    whole = F.col("_cell0") != ""
    value = lambda j: F.regexp_replace(F.col(f"_cell{j}"), _OUTSIDE, "")

    def string(j: int) -> Column:
        return by_feed(lambda s: joined(F.col(f"_value{j}"), s.fields[judged[s.feed][j]].kind) if j < len(judged[s.feed]) else F.lit(""), F.lit(""))

    staged = _bind(staged, **{f"_value{j}": F.when(whole, value(j)).otherwise(none) for j in cells})
    staged = _bind(staged, **{f"_bare{j}": skeleton(string(j)) for j in cells})
    staged = _bind(staged, **{f"_pairs{j}": _pairs(F.col(f"_bare{j}")) for j in cells}, **{f"_rings{j}": F.translate(f"_bare{j}", "A()=#:/\\.-", "") for j in cells})

    def good(j: int) -> Column:
        bare, rings = F.col(f"_bare{j}"), F.col(f"_rings{j}")
        part = lambda x, i: F.split_part(x, F.lit("|"), F.lit(i))
        plain = F.when(F.contains(rings, F.lit("|")), _even(part(rings, 1)) & _even(part(rings, 2)) & _even(part(rings, 3))).otherwise(_even(rings))
        wide = F.forall(F.split(bare, r"\|"), _even_rings)
        return (bare == "") | (~bare.rlike(_SHAPE) & _balanced(F.col(f"_pairs{j}")) & F.when(F.contains(rings, F.lit("%")), wide).otherwise(plain))

    # The first judged field that is not well-formed, 0 if there is none; null for rows the pattern misses.
    number = lambda j: by_feed(lambda s: F.lit((judged[s.feed] + [0] * most)[j] + 1), F.lit(0))
    bad = reduce(lambda rest, j: F.when(~F.coalesce(good(j), F.lit(False)), number(j)).otherwise(rest), reversed(cells), F.lit(0))
    staged = _bind(staged, _bad=F.when(whole, bad))

    # Rows it misses: how many fields are right in number and quoting, and what stands after them.
    def depth(s: RecordSchema) -> Column:
        out = F.lit(len(s.fields))
        for i in reversed(range(len(s.fields))):
            out = F.when(~t.rlike(shape_pattern(i + 1)), F.lit(i)).otherwise(out)
        return out

    def rest(s: RecordSchema) -> Column:
        out = F.regexp_replace(t, shape_pattern(len(s.fields)), "")
        for i in reversed(range(len(s.fields))):
            out = F.when(F.col("_depth") == i, F.regexp_replace(t, shape_pattern(i), "")).otherwise(out)
        return out

    missed = F.col("_bad").isNull() & F.col(raw).isNotNull()
    staged = _bind(staged, _depth=F.when(missed, by_feed(depth, F.lit(None).cast("int"))))
    staged = _bind(staged, _rest=F.when(F.col("_depth").isNotNull(), by_feed(rest, none)))
    width = by_feed(lambda s: F.lit(len(s.fields)), F.lit(-1))
    left = F.col("_rest")
    reason = (
        F.when(F.col("_bad") == 0, none)
        .when(~name.isin(*[s.feed for s in schemas]), F.lit("unknown_feed"))
        .when(F.col("_bad").isNotNull(), F.lit("invalid_value"))
        .when(F.col(raw).isNull() | ((left == "") & (F.col("_depth") < width)), F.lit("column_count"))
        .when(left == "", F.lit("invalid_value"))
        .when((F.col("_depth") < width) | (F.regexp_replace(left, rf"\G{_ANY},", "") != ""), F.lit("quoting"))
        .otherwise(F.lit("column_count"))
    )
    staged = _bind(staged, reason=reason)

    def prefix_depth(s: RecordSchema) -> Column:
        out = F.lit(len(s.fields) + 1)
        for i, p in reversed(list(enumerate(prefix_patterns(s)))):
            out = F.when(~t.rlike(p), F.lit(i + 1)).otherwise(out)
        return out

    broken = F.when(F.col("reason").isNotNull(), F.coalesce("_bad", by_feed(prefix_depth, F.lit(0))))
    return staged.select(*[F.col(f"`{c}`") for c in df.columns], "reason", broken.alias("broken_field"), _fields(t).alias("parsed"))


def _bind(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns computed once: a filter on them cannot be pushed below, which would copy their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def rejected(df: DataFrame, key: str = "line_id", **kw) -> DataFrame:
    """(key, reason, broken_field) of the records that cannot be loaded."""
    return judge(df, **kw).filter("reason is not null").select(key, "reason", "broken_field")


def loaded(df: DataFrame, schema: RecordSchema, key: str = "line_id", feed: str = "feed", raw: str = "raw_line", schemas: tuple[RecordSchema, ...] = (CURATED, PREDICTION)) -> DataFrame:
    """The loadable records of one feed as typed rows; a value that does not fit its type comes out null."""
    rows = judge(df, schemas, feed, raw).filter(F.col("reason").isNull() & (F.col(feed) == schema.feed))
    value = lambda i, f: F.get(F.col("parsed"), F.lit(i)) if f.type == "string" else F.expr(f"try_cast(nullif(trim(parsed[{i}]), '') as {f.type})")
    judged = lambda i, f: strip_space(value(i, f)) if f.kind != "any" else value(i, f)
    return rows.select(key, *[judged(i, f).alias(f.name) for i, f in enumerate(schema.fields)])
