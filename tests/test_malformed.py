"""Against a character-by-character reader that shares nothing with the patterns."""

import re

import pytest
from pyspark.sql import functions as F

from fragmill.operators import malformed as M

SF = "/root/testdata/sf0.01"
BR = re.compile(r"\[\d*([A-Z][a-z]?|[a-z]{1,2}|\*)@{0,2}(H\d*)?([+-]\d+|\++|-+)?(:\d+)?\]")


def tokens(s):
    i, out = 0, []
    while i < len(s):
        m = BR.match(s, i)
        if m and (m[1] in M.ELEMENTS or m[1] in M.AROMATIC or m[1] == "*"):
            out.append(("a", m[0]))
            i = m.end()
        elif s[i : i + 2] in ("Cl", "Br"):
            out.append(("a", s[i : i + 2]))
            i += 2
        elif s[i] in "BCNOPSFIbcnops*":
            out.append(("a", s[i]))
            i += 1
        elif s[i] == "%" and s[i + 1 : i + 3].isdigit() and len(s[i + 1 : i + 3]) == 2:
            out.append(("r", int(s[i + 1 : i + 3])))
            i += 3
        elif s[i] in "0123456789":
            out.append(("r", int(s[i])))
            i += 1
        elif s[i] in "-=#:/\\.":
            out.append(("b", s[i]))
            i += 1
        elif s[i] in "()":
            out.append((s[i], s[i]))
            i += 1
        else:
            return None
    return out


def mol(s):
    t = tokens(s)
    if not t:
        return False
    first = next((i for i, x in enumerate(t) if x[0] == "a"), None)
    if first is None or any(x[1] not in ("/", "\\") for x in t[:first]) or t[-1][0] == "b":
        return False
    depth, rings = 0, {}
    for i, x in enumerate(t):
        depth += (x[0] == "(") - (x[0] == ")")
        if depth < 0 or (x[0] == ")" and t[i - 1][0] == "("):
            return False
        if x[0] == "r":
            rings[x[1]] = rings.get(x[1], 0) + 1
    return depth == 0 and all(n % 2 == 0 for n in rings.values())


def split_ok(s):
    p = s.split(".")
    return s == "" or (len(p) == 3 and all(map(mol, p)) and s.count("[*:1]") == 2 and s.count("[*:2]") == 2)


def read(s):
    fields, i = [], 0
    while True:
        if i < len(s) and s[i] == '"':
            i, buf = i + 1, []
            while True:
                if i >= len(s):
                    return None
                if s[i] == '"':
                    if s[i + 1 : i + 2] == '"':
                        buf.append('"')
                        i += 2
                        continue
                    i += 1
                    break
                buf.append(s[i])
                i += 1
            if i < len(s) and s[i] != ",":
                return None
            fields.append("".join(buf))
        else:
            j = s.find(",", i)
            j = len(s) if j < 0 else j
            if '"' in s[i:j]:
                return None
            fields.append(s[i:j])
            i = j
        if i >= len(s):
            return fields
        i += 1


def reason(feed, raw):
    n = {"curated": 6, "prediction": 5}.get(feed)
    if n is None:
        return "unknown_feed"
    if raw is None:
        return "column_count"
    f = read(raw)
    if f is None:
        return "quoting"
    if len(f) != n:
        return "column_count"
    return None if (mol(f[1].strip()) if feed == "curated" else split_ok(f[1].strip())) else "invalid_value"


def test_all_rows_of_a_table(spark):
    df = spark.read.parquet(f"{SF}/raw_lines.parquet")
    want = {r.line_id: reason(r.feed, r.raw_line) for r in df.collect()}
    got = {r.line_id: r for r in M.judge(df).collect()}
    assert {k: v.reason for k, v in got.items()} == want
    assert {"quoting", "column_count", "invalid_value", None} <= set(want.values())
    for r in got.values():
        if r.reason is None:
            assert r.parsed == read(r.raw_line)
        else:
            assert r.broken_field >= 1


E3 = "a,{},,,,n"
CASES = [
    ("curated", None), ("curated", ""), ("curated", " "), ("nosuch", "a"), (None, "a,b"),
    ("curated", E3.format("C")), ("curated", E3.format(" C\t")), ("curated", E3.format('"C\n"')), ("curated", E3.format('"\u00a0C"')),
    ("curated", 'a,"C",,,,"say ""hi"""'), ("curated", '"""a""",C,,,,n'), ("curated", '""a"",C,,,,n'), ("curated", 'a,C"",,,,n'),
    ("curated", 'a,C,,,,"x" '), ("curated", 'a,C,,,,"x'), ("curated", 'a,C,"",,,'), ("curated", 'a,C,"""",,,'), ("curated", 'a,C,""",,,'),
    ("curated", 'a, "C",,,,n'), ("curated", "a,C,,,,n,"), ("curated", 'a,"C,D",,,,n'), ("curated", 'a,b,"c\nd",e'), ("curated", '",",C,",",",",",",n'),
    *[("curated", E3.format(x)) for x in ("C()", "C(C", "C)C(", "C(C)(C)", "C1CC1", "C1CC2", "C%11CC%11", "C%1C", "C%01CC1", "=C", "/C=C/C", "\\C", "C=", "C.", ".C", "C.C", "C-", "C/", "[nH]1cc1", "[13CH4]", "[Zz]", "[C@@H]", "[C@@@H]", "[O-]", "[Fe+++]", "[Fe+2]", "[*:1]", "[*:]", "[:1]", "[]", "1CC1", "(C)C", "Xx", "c1ccccc1", "ClBr", "Al", "[Al]", "[se]", "C C", "%11C%11", "[2H]C", "C(=O)O", "C((C))", "C(1)C1", "*", "é", "C{C}", "CA", "A", "CAC", "Bl", "Cr", "BrCl", "CCl(Br)l", "!C", "C~C")],
    *[("prediction", f"C,{x},m,1,") for x in ("", " ", "nan", "[*:2]C.[*:2]C[*:1].[*:1]C", "[*:2]C.[*:2]C[*:2].[*:1]C", "C[*:1].C[*:1].[*:2]C[*:2]", "C.[*:2]C[*:1].[*:1]C", "[*:2]C.[*:2]C[*:1].[*:1]C.C", "[*:2]C..[*:1]C")],
    ("prediction", 'C,"",m,x,r'), ("prediction", "C,,m,2,\u2028"), ("curated", "a\uffffb,C,,,,n"),
]


def test_edges_nulls_and_long_rows(spark):
    long = [("curated", E3.format("C" * 60000)), ("curated", E3.format("C(" * 20000 + "C" + ")" * 20000)), ("curated", '"' + '""' * 50000 + '",C,,,,n'), ("curated", "," * 50000), ("curated", "a,C,,,," + '"x",' * 20000)]
    rows = [(i, f, r) for i, (f, r) in enumerate(CASES + long)]
    df = spark.createDataFrame(rows, "line_id long, feed string, raw_line string")
    got = {r.line_id: r.reason for r in M.judge(df).select("line_id", "reason").collect()}
    for i, f, r in rows:
        assert got[i] == reason(f, r), (f, (r or "")[:80])


def test_typed_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "prediction", "C,,m,2,r", "mine", "p"), (2, "prediction", "C,,m,two,r", "mine", "p"), (3, "prediction", "C,X,m,2,r", "mine", "p"), (4, "curated", "i,C,,,,", "mine", "p")], "line_id long, feed string, raw_line string, reason string, parsed string")
    got = sorted(map(tuple, M.loaded(df, M.PREDICTION).collect()))
    assert got == [(1, "C", "", "m", 2, "r"), (2, "C", "", "m", None, "r")]
    assert [tuple(r) for r in M.rejected(df).collect()] == [(3, "invalid_value", 2)]
    assert M.judge(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="nosuch"):
        M.judge(df, raw="nosuch").count()


def test_patterns_are_anchored():
    assert M.row_pattern(M.CURATED).startswith(r"\A") and len(M.prefix_patterns(M.CURATED)) == 6
    assert F.lit(1) is not None
