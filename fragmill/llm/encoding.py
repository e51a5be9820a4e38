"""Garbled text from wrong character encodings, restored by minimum description length.

UTF-8 bytes read as a one-byte charset leave runs of characters that, written in that charset, are again valid UTF-8.
Such runs are candidates; so are runs that appear after a first repair (text garbled twice). Bytes of one one-byte
charset read as another leave single characters instead: words with characters that are strange to the language, and usual ones
once taken back, are candidates too when no UTF-8 run saves anything. Each candidate stretch is
compressed, with its surroundings, by Zstandard with a dictionary of its language, and the chain of decodings with the
smallest compressed size plus its own cost wins; if none is smaller than the text as it stands, it is left unchanged.
Replacement characters and C1 controls never belong to a text as written: such texts are reported even if nothing can
be restored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmill.plans.lineage import Scratch
from fragmill.sources.tables import require

CHARSETS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_2", "cp866", "koi8_r")


@cache
def byte_of(charset: str) -> dict[str, int]:
    """Characters above 127 and their bytes. Of Windows charsets, unused bytes stand for C1 controls, and cp1252 also
    takes C1 controls for the bytes it uses otherwise, as Latin-1 does."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if charset == "cp1252":
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


def _class(charset: str, lo: int, hi: int) -> str:
    points = sorted(ord(c) for c, b in byte_of(charset).items() if lo <= b <= hi)
    return "[" + "".join(f"\\U{p:08x}" for p in points) + "]"


@cache
def run_pattern(charset: str) -> re.Pattern:
    """Runs of characters whose bytes in the charset are characters of two to four bytes in UTF-8."""
    more = _class(charset, 0x80, 0xBF)
    return re.compile(f"(?:{_class(charset, 0xC2, 0xDF)}{more}|{_class(charset, 0xE0, 0xEF)}{more}{{2}}|{_class(charset, 0xF0, 0xF4)}{more}{{3}})+")


#: A pattern (of Java's kind) for texts worth a closer look: any character beyond ASCII.
CLOSER = r"[^\x00-\x7f]"

_BEYOND = re.compile("[^\x00-\x7f]{2,}")


def decode_run(run: str, charset: str) -> str | None:
    """What a run says when its bytes in the charset are read as UTF-8; None if they are not UTF-8 or hold controls."""
    table = byte_of(charset)
    try:
        out = bytes(table[c] for c in run).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
    return out


_LOST = re.compile("[\x80-\x84\x86-\x9f\ufffd]")


@cache
def exchange(read: str, true: str) -> dict[str, str]:
    """What the characters beyond ASCII of a text read in one charset say in another; C1 controls and what would become
    one are left out."""
    back = {b: c for c, b in byte_of(true).items() if not "\x80" <= c <= "\x9f"}
    return {c: back[b] for c, b in byte_of(read).items() if b in back and not "\x80" <= c <= "\x9f"}


def wide_words(text: str) -> list[tuple[int, str]]:
    """(start, word) of the words with a character beyond ASCII."""
    return [(m.start(), m[0]) for m in re.finditer(r"\S+", text) if not m[0].isascii()]


@cache
def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def taken_back(words: list[tuple[int, str]], table: dict[str, str], usual: set[str], here: set[str], anywhere: set[str]) -> list[tuple[int, int, str]]:
    """(start, end, new word) of those ``wide_words`` of a text that may come from an exchange of charsets.

    Each changed character of a word becomes one that is usual in the language, and one becomes a letter from

    * a letter of another script that the language does not have (``here``): alone or beside any letters if the new one
      is Latin, in a word without ASCII letters if it is not. Greek letters are also signs and count as below;
    * any character that no language has (``anywhere``), beside an ASCII letter in a word of at least three; a letter of
      which some language has the other case only if the word mixes cases.
    """
    out = []
    for start, word in words:
        changed = [(k, c, table.get(c)) for k, c in enumerate(word) if c > "\x7f" and table.get(c) != c]
        if not changed or not all(n in usual for _, _, n in changed):
            continue
        letters = "".join(c for c in word if c.isalpha())
        mixed = not (letters.isupper() or letters[1:].islower())
        ascii_letters = sum(c < "\x80" and c.isalpha() for c in word)
        for k, c, n in changed:
            old, new = _script(c), _script(n)
            other = old not in ("", "GREEK", new) and c not in here and (new == "LATIN" or not ascii_letters)
            beside = word[max(0, k - 1) : k] + word[k + 1 : k + 2]
            strange = c not in anywhere and (mixed or c.swapcase() == c or c.swapcase() not in anywhere)
            if new and (other or strange and ascii_letters > 2 and any(x < "\x80" and x.isalpha() for x in beside)):
                out.append((start, start + len(word), "".join(table.get(x, x) for x in word)))
                break
    return out


def _shares(counts: dict[str, tuple[dict[str, int], int]]) -> tuple[dict[str, set[str]], dict[str, set[str]], set[str]]:
    """Of texts that hold each character, and texts, by language: characters usual in it (a tenth of its texts), those it
    has (a fiftieth), and those any has."""
    usual, here = ({x: {c for c, k in held.items() if k >= max(2, share * n)} for x, (held, n) in counts.items()} for share in (0.1, 0.02))
    return usual, here, set().union(*here.values())


def garbled(text: str, common: set[str], charsets: Sequence[str] = CHARSETS, deepest: int = 3) -> bool:
    """Whether a run of the text, decoded once or several times, says nothing but common characters."""
    for charset in charsets:
        for m in run_pattern(charset).finditer(text):
            new = decode_run(m[0], charset)
            if new is not None and (set(new) <= common or (deepest > 1 and garbled(new, common, charsets, deepest - 1))):
                return True
    return False


class Judge:
    """Description lengths with one dictionary a language.

    A text costs its compressed bytes, plus what naming its characters beyond ASCII costs: ``alphabet_weight`` times
    the information of finding each in a text of the language. A decoding costs ``chain_cost`` bytes a charset and
    ``stretch_cost`` bytes a stretch; one from another one-byte charset (``TRUE as READ`` in the chain) ``pair_cost``.
    """

    def __init__(self, dictionaries: dict[str, tuple[bytes, dict[str, int], int]], charsets: Sequence[str] = CHARSETS, chain_cost: float = 2.0, pair_cost: float = 3.0, stretch_cost: float = 0.5, alphabet_weight: float = 2.0, margin: int = 48, deepest: int = 3, level: int = 6):
        import zstandard as z

        # A character costs its rarity in texts of the language, or of all languages if that is less; one never seen
        # costs an escape and then the 21 bits of a code point.
        bits = lambda k, n: -alphabet_weight / 8 * log2((k + 0.25) / (n + 1))
        every: dict[str, int] = {}
        total = sum(n for _, _, n in dictionaries.values())
        for _, held_by, _ in dictionaries.values():
            for c, k in held_by.items():
                every[c] = every.get(c, 0) + k
        self.alphabet: dict[str, dict[str, float]] = {}
        self.escape = bits(0, total) + alphabet_weight / 8 * 21

        self.charsets, self.chain_cost, self.stretch_cost, self.margin, self.deepest = charsets, chain_cost, stretch_cost, margin, deepest
        self.pair_cost = pair_cost
        self.tables = {f"{t} as {r}": exchange(r, t) for r in charsets for t in charsets if r != t}
        self.coders = {}
        self.usual, self.here, self.anywhere = _shares({x: (held_by, n) for x, (_, held_by, n) in dictionaries.items()})
        #: language -> character -> names of the exchanges that make it a usual one, of characters the language has not.
        self.easier: dict[str, dict[str, list[str]]] = {}
        for lang, (raw, held_by, n) in dictionaries.items():
            self.alphabet[lang] = {c: min(bits(held_by.get(c, 0), n), bits(k, total)) for c, k in every.items()}
            easier = self.easier[lang] = {}
            for name, table in self.tables.items():
                for c, new in table.items():
                    if new in self.usual[lang] and c not in self.here[lang]:
                        easier.setdefault(c, []).append(name)
            held = z.ZstdCompressionDict(raw) if raw else None
            if held:
                held.precompute_compress(level=level)
            self.coders[lang] = z.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str, langs: Sequence[str]) -> float:
        data, wide = text.encode("utf-8", "surrogatepass"), [c for c in text if c > "\x7f"]
        return min(len(self.coders[x].compress(data)) + sum(self.alphabet[x].get(c, self.escape) for c in wide) for x in langs)

    def step(self, text: str, charset: str, langs: Sequence[str]) -> tuple[float, str]:
        """(bytes saved, text) when those stretches that get shorter are read anew from the charset."""
        runs = [(m.start(), m.end(), decode_run(m[0], charset)) for m in run_pattern(charset).finditer(text)]
        return self.shorter(text, [r for r in runs if r[2] is not None], langs)

    def exchange_step(self, text: str, words: list[tuple[int, str]], name: str, langs: Sequence[str]) -> tuple[float, str]:
        """(bytes saved, text) when those stretches that get shorter are taken back from an exchange of charsets."""
        found = {r for x in langs for r in taken_back(words, self.tables[name], self.usual[x], self.here[x], self.anywhere)}
        return self.shorter(text, sorted(found), langs)

    def shorter(self, text: str, found: list[tuple[int, int, str]], langs: Sequence[str]) -> tuple[float, str]:
        """(bytes saved, text) with those stretches of (start, end, new text) put in that get shorter."""
        stretches: list[list[tuple[int, int, str]]] = []
        for run in found:
            if stretches and run[0] - stretches[-1][-1][1] <= self.margin:
                stretches[-1].append(run)
            else:
                stretches.append([run])
        saved, out, at = 0.0, [], 0
        for runs in stretches:
            a, b = max(0, runs[0][0] - self.margin), min(len(text), runs[-1][1] + self.margin)
            inner, p = [], a
            for s, e, new in runs:
                inner += [text[p:s], new]
                p = e
            gain = self.size(text[a:b], langs) - self.size("".join(inner) + text[p:b], langs) - self.stretch_cost
            if gain > 0:
                saved += gain
                for s, e, new in runs:
                    out += [text[at:s], new]
                    at = e
        return saved, "".join(out) + text[at:]

    def best(self, text: str, lang: str | None) -> tuple[str, list[str], float]:
        """(text, chain of charsets, bytes saved) by UTF-8 runs; the chain is empty where the text is best left as it is."""
        langs = [lang] if lang in self.coders else list(self.coders)
        chain: list[str] = []
        total = 0.0
        while len(chain) < self.deepest * 2:
            beyond = " ".join(_BEYOND.findall(text))
            charsets = [c for c in self.charsets if run_pattern(c).search(beyond)]
            saved, new, charset = max(((*self.step(text, c, langs), c) for c in charsets), key=lambda x: x[0], default=(0.0, text, ""))
            if saved <= self.chain_cost:
                break
            text, total = new, total + saved - self.chain_cost
            chain.append(charset)
        return text, chain, total

    def restored(self, text: str, lang: str | None) -> tuple[str, list[str], float]:
        """As best, also with exchanges of one-byte charsets, each tried when no UTF-8 run saves anything."""
        text, chain, total = self.best(text, lang)
        # A single character may be usual in one language and strange in another, so a text of no known language is first
        # given the one in which it is shortest.
        langs = [lang] if lang in self.coders else [] if text.isascii() else [min(self.coders, key=lambda x: self.size(text, [x]))]
        while len(chain) < self.deepest * 2:
            wide = {c for c in text if c > "\x7f"}
            some = {n for x in langs for c in wide for n in self.easier[x].get(c, ())}
            names, words = [n for n in self.tables if n in some], wide_words(text) if some else []
            saved, new, name = max(((*self.exchange_step(text, words, n, langs), n) for n in names), key=lambda x: x[0], default=(0.0, text, ""))
            if saved <= self.pair_cost:
                break
            text, more, gain = self.best(new, lang)
            chain += [name, *more]
            total += saved - self.pair_cost + gain
        return text, chain, total


class Suspects:
    """Tells texts that may be garbled, by what is usual in all texts: ``counts`` has (language, character) -> texts that
    hold it, and their number at an empty character. Such texts must not teach how the language is written."""

    def __init__(self, counts: dict[tuple[str, str], int], charsets: Sequence[str] = CHARSETS):
        self.charsets, held_by = charsets, {}
        of: dict[str, dict[str, int]] = {}
        many = {lang: n for (lang, c), n in counts.items() if not c}
        for (lang, c), n in counts.items():
            if c:
                held_by[c] = held_by.get(c, 0) + n
            mine = of.setdefault(lang, {})
            if c > "\x7f":
                mine[c] = n
        # Runs that only decode to rare characters are how the text was written.
        self.common = {c for c, n in held_by.items() if n >= max(2, sum(many.values()) * 0.004)}
        self.usual, self.here, self.anywhere = _shares({x: (held, many[x]) for x, held in of.items()})
        self.tables = [exchange(r, t) for r in charsets for t in charsets if r != t]

    def __call__(self, text: str, lang: str) -> bool:
        if _LOST.search(text) or garbled(" ".join(_BEYOND.findall(text)), self.common, self.charsets):
            return True
        usual, here = self.usual.get(lang, set()), self.here.get(lang, set())
        strange = {c for c in text if c > "\x7f" and c not in here}
        words = wide_words(text) if strange else []
        return any(any(t.get(c) in usual for c in strange) and taken_back(words, t, usual, here, self.anywhere) for t in self.tables if words)


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, text): (lang, char, n), how many texts of this partition hold each character; an empty char counts them."""
    n: dict[str, Counter[str]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mine = n.setdefault(lang, Counter())
            mine.update(set(text))
            mine[""] += 1
    rows = [(x, c, k) for x, mine in n.items() for c, k in mine.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "char", "n"])


#: Fixed value: what is longer is no word.
LONGEST_WORD = 64


def _alphabets(batches: Iterator[pa.RecordBatch], suspects: Suspects) -> Iterator[pa.RecordBatch]:
    """Of (lang, text): (lang, char, n), how many clean texts of this partition hold each character beyond ASCII; an empty
    char counts the texts, and a word behind a blank how often it stands in them. Counts leave in parts, to be added."""
    n: dict[tuple[str, str], int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in n], pa.string()), pa.array([c for _, c in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "char", "n"])

    for batch in batches:
        if len(n) > 200_000:
            yield out()
            n.clear()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text.isascii() or not suspects(text, lang):
                for c in {"", *(c for c in text if c > "\x7f")}:
                    n[lang, c] = n.get((lang, c), 0) + 1
                for w, k in Counter(text.split()).items():
                    if len(w) <= LONGEST_WORD:
                        n[lang, " " + w] = n.get((lang, " " + w), 0) + k
    yield out()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = 65536, most_languages: int = 200, charsets: Sequence[str] = CHARSETS) -> dict[str, tuple[bytes, dict[str, int], int]]:
    """language -> (dictionary, clean texts that hold each character beyond ASCII, clean texts).

    All is counted over all documents: first the characters, which tell texts that may be garbled, then characters and
    words of the others. A dictionary holds the words that take most bytes in all clean texts of its language, as many as
    ``size`` bytes hold. Characters that stand in less than one text of 100,000 are left out. The ``most_languages`` most
    frequent languages have a dictionary; others, and null, are tried with each.
    """
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return {"": (b"", {}, 0)}
    by = sorted(r.lang for r in counts)
    named, least = rows.filter(F.col("lang").isin(*by)), F.when(F.lit(False), F.lit(0.0))
    for r in counts:
        least = least.when(F.col("lang") == r.lang, F.lit(r["count"] / 100_000))
    every = named.mapInArrow(_characters, "lang string, char string, n long").groupBy("lang", "char").agg(F.sum("n").alias("n"))
    suspects = Suspects({(r.lang, r.char): r.n for r in every.filter(F.col("n") >= least).collect()}, charsets)  # bounded by what texts of a language hold
    held = named.mapInArrow(lambda it: _alphabets(it, suspects), "lang string, char string, n long").groupBy("lang", "char").agg(F.sum("n").alias("n"))
    held = Scratch(docs.sparkSession).keep(held)
    clean = {r.lang: r.n for r in held.filter("char = ''").collect()}
    least = F.when(F.lit(False), F.lit(0.0))
    for name, n in clean.items():
        least = least.when(F.col("lang") == name, F.lit(n / 100_000))
    alphabet: dict[str, dict[str, int]] = {name: {} for name in by}
    words = F.col("char").startswith(" ")
    for r in held.filter((F.col("char") != "") & ~words & (F.col("n") >= least)).collect():  # bounded by what texts of a language hold
        alphabet[r.lang][r.char] = r.n
    # The words that take most bytes, the first ones last: what is near is cheapest to refer to.
    long = F.octet_length("char").alias("bytes")
    first = Window.partitionBy("lang").orderBy(F.desc(F.col("n") * F.col("bytes")), "char")
    best = held.filter(words).select("lang", "char", "n", long).withColumn("upto", F.sum("bytes").over(first.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") <= size)
    texts: dict[str, list[tuple[int, str]]] = {name: [] for name in by}
    for r in best.collect():  # at most ``size`` bytes a language
        texts[r.lang].append((r.upto, r.char))
    return {name: ("".join(w for _, w in sorted(texts[name], reverse=True)).encode("utf-8", "surrogatepass"), alphabet[name], clean.get(name, 0)) for name in by}


def _repair(batches: Iterator[pa.RecordBatch], judge: list, make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not judge:
            judge.append(make())
        ids, texts, langs = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        at, new, chains, saved, whole = [], [], [], [], []
        for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
            fixed, chain, gain = judge[0].restored(text, lang)
            left = bool(_LOST.search(fixed))
            if chain or left:
                at.append(i)
                new.append(fixed)
                chains.append(chain)
                saved.append(gain)
                whole.append(not left)
        if at:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(new, pa.string()), pa.array(chains, pa.list_(pa.string())), pa.array(saved, pa.float64()), pa.array(whole, pa.bool_())], schema=schema)


def repair(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", dictionaries: dict | None = None, charsets: Sequence[str] = CHARSETS, **parameters) -> DataFrame:
    """(doc_id, restored, chain, bytes_saved, complete) of each affected document.

    chain lists the charsets the text had been read in, outermost first (``cp1252 as cp1251`` for bytes of one one-byte
    charset read as another); it is empty where nothing could be restored.
    complete is false where replacement characters or C1 controls remain. Null and empty texts are not affected.
    Repeated rows come out as often as they stand in docs; other columns are ignored. Without ``dictionaries`` they
    are counted over all docs.
    """
    require(docs, [doc_id, text, lang], "documents")
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(train(docs, text, lang, charsets=charsets) if dictionaries is None else dictionaries)
    rows = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).filter(F.col("text").rlike(CLOSER))
    out = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("restored", T.StringType()), T.StructField("chain", T.ArrayType(T.StringType())), T.StructField("bytes_saved", T.DoubleType()), T.StructField("complete", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    return rows.mapInArrow(lambda it: _repair(it, [], lambda: Judge(held.value, charsets, **parameters), arrow), out)
