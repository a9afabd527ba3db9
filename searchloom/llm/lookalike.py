"""One consistent form of texts that look the same.

A text's canonical form differs from the text only where a character is unstable: the normalization quick check does
not answer yes for it, it is invisible, it is another form of a character (full-width, half-width, ligature, styled
letter), another kind of blank, or a letter or sign that looks like an ordinary one. One regular expression, made from
these properties, finds the unstable segments, each with the character before it, to which an accent may attach. Only
these segments are normalized, and spliced into the text that stays as it is. Texts without such a segment never leave
the JVM.

Kept apart, because a reader sees them: case, accents, raised and lowered digits, the number of blanks and lines,
quotation marks and dashes of different shape. A joiner between two pictographs is kept too, as it makes one of them.

Defined results: null stays null and empty stays empty; a text of nothing visible has a canonical form but is no
partner of any text; repeated rows each count; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.lookup import lookup_join
from searchloom.scratch import materialize

#: Letters and signs of other alphabets or codes, each above the ordinary one it looks like.
LOOKALIKE_FROM = "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТХІЈЅУԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧονɑɡօ∕⁄∗∶ǃ․‐"
LOOKALIKE_TO = "aeopcyxijshdqwlABEKMHOPCTXIJSYQWABEZHIKMNOPTYXovago//*:!.-"
#: Greek letters, each above the Cyrillic one it looks like, that look like no Latin one.
GREEK_FROM = "ΓΠΦΘΨκθψ"
GREEK_TO = "ГПФѲѰкѳѱ"
#: Compatibility kinds of a character that are the same to a reader. Raised, lowered, circled and fraction forms are not.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Compatibility characters of kind <compat> that are the same to a reader: Roman numerals, ligatures, the micro sign.
SAME_LOOK_RANGES = ((0x2160, 0x217F), (0xFB00, 0xFB06), (0xB5, 0xB5))
#: Characters without a glyph besides those of the category Cf: variation selectors, fillers, the grapheme joiner.
NO_GLYPH = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF), (0x34F, 0x34F), (0x115F, 0x1160), (0x3164, 0x3164), (0xFFA0, 0xFFA0), (0x180B, 0x180E))
JOINER = "‍"
#: Characters of the category Cf that do have a glyph: number signs of Arabic, Syriac and other scripts.
SEEN_FORMAT = ((0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD))


class Tables(NamedTuple):
    fold: dict[int, str]  # what each single character becomes before composition
    pattern: re.Pattern  # a run of unstable characters
    java: str  # for the JVM: matches every text that has an unstable character, and few others


#: Ranges of stable characters that the JVM's test names; texts made of these alone never reach Python.
STABLE_RANGES = 24


def _within(c: int, ranges) -> bool:
    return any(a <= c <= b for a, b in ranges)


def _char_class(codes: list[int], escape) -> str:
    """A regular-expression class of sorted code points, as ranges."""
    parts, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append(escape(codes[i]) + ("-" + escape(codes[j]) if j > i else ""))
        i = j + 1
    return "[" + "".join(parts) + "]"


@lru_cache(maxsize=1)
def tables() -> Tables:
    """The properties of all characters, from the interpreter's character database; made once per process."""
    fold = dict(zip(map(ord, LOOKALIKE_FROM + GREEK_FROM), LOOKALIKE_TO + GREEK_TO))
    unstable = set(fold)
    for c in range(0x110000):
        if 0xD800 <= c <= 0xDFFF or 0xAC00 <= c <= 0xD7A3 or 0x4E00 <= c <= 0x9FFF:
            continue  # surrogates; precomposed syllables and unified ideographs are stable
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        if (kind == "Cf" and not _within(c, SEEN_FORMAT)) or _within(c, NO_GLYPH) or (kind == "Cc" and ch not in "\t\n\v\f\r\x85"):
            fold[c] = ""
        elif kind == "Zs":
            if ch != " ":
                fold[c] = " "
        else:
            d = unicodedata.decomposition(ch)
            if d.startswith(SAME_LOOK) or (d.startswith("<compat>") and _within(c, SAME_LOOK_RANGES)):
                fold[c] = unicodedata.normalize("NFKC", ch).translate(fold)
            elif d and not d.startswith("<"):
                unstable.update(map(ord, unicodedata.normalize("NFD", ch)[1:]))  # may attach to the character before
                nfd = unicodedata.normalize("NFD", ch)
                if ord(nfd[0]) in fold or not unicodedata.is_normalized("NFC", ch):
                    unstable.add(c)
            if unicodedata.combining(ch):
                unstable.add(c)
    unstable.update(fold)
    unstable.update(range(0x1161, 0x1176))
    unstable.update(range(0x11A8, 0x11C3))
    unstable.update((ord(JOINER), ord("\r")))
    codes = sorted(unstable)
    gaps = [(x + 1, y - 1) for x, y in zip([-1, *codes], [*codes, 0x110000]) if y - x > 1]
    low = [g for g in gaps if g[1] < 0x250]
    stable = sorted({*low, *sorted(gaps, key=lambda g: g[0] - g[1])[:STABLE_RANGES]})
    java = "[^" + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in stable) + "]"
    escape = "\\U{:08x}".format
    near, far = ([c for c in codes if c != 13 and (c > 0xFFFF) == astral] for astral in (False, True))
    pattern = f"(?:{_char_class(near, escape)}|(?=[\U00010000-\U0010ffff]){_char_class(far, escape)})+"  # a class within the basic plane is a bitmap
    return Tables(fold, re.compile(pattern), java)


def _pictograph(ch: str) -> bool:
    return bool(ch) and (unicodedata.category(ch) in ("So", "Sk") and ord(ch) > 0x2000 or ch == "️")


def _segment(s: str, after: str) -> str:
    """The canonical form of an unstable segment with its boundary character in front."""
    fold = tables().fold
    if JOINER in s:
        s = "".join(c for i, c in enumerate(s) if c != JOINER or (i and _pictograph(s[i - 1]) and _pictograph(s[i + 1 : i + 2] or after)))
        s = "".join(c if c == JOINER else c.translate(fold) for c in unicodedata.normalize("NFD", s))
    else:
        s = unicodedata.normalize("NFD", s).translate(fold)
    return unicodedata.normalize("NFC", s)


def canonical(text: str | None) -> str | None:
    """The canonical form of one text."""
    if not text:
        return text
    if "\r\n" in text:
        text = text.replace("\r\n", "\n")
    if text.isascii() and text.isprintable():
        return text
    out, done = [], 0
    for m in tables().pattern.finditer(text):
        start = max(done, m.start() - 1)  # the character before belongs to the segment unless an earlier one has it
        out.append(text[done:start])
        out.append(_segment(text[start : m.end()], text[m.end() : m.end() + 1]))
        done = m.end()
    if not done:
        return text
    out.append(text[done:])
    joined = "".join(out)
    # Where only invisible characters stood between a letter and its accent, the two now meet: check the whole again.
    return joined if unicodedata.is_normalized("NFC", joined) else unicodedata.normalize("NFC", joined)


def canonical_text(col: Column | str) -> Column:
    """The canonical form as a column; the slow path. :func:`with_canonical` avoids it for texts that are stable."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(canonical, na_action="ignore")

    return run(col)


def with_canonical(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """``df`` with ``out``, read once. Only texts with an unstable character go to Python; no shuffle."""
    t = F.col(f"`{text}`")
    return df.withColumn(out, F.coalesce(canonical_text(F.when(t.rlike(tables().java), t)), t))


def visible(col: Column | str) -> Column:
    """Whether a canonical text has anything a reader can see."""
    return F.col(col).rlike(r"[^\s]") if isinstance(col, str) else col.rlike(r"[^\s]")


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``variant`` and ``look``: 128-bit fingerprints of the text itself and of its canonical form, in binary.

    Two rows look the same if they agree in ``look``, and are the same string if they agree in ``variant`` too. Rows
    without a text or with nothing visible are left out.
    """
    c = with_canonical(df.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text")), "__text", "__look").where(visible("__look"))
    return c.select(F.col("__id").alias(key), F.unhex(F.md5("__text")).alias("variant"), F.unhex(F.md5("__look")).alias("look"))


def lookalike_members(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``look`` (hex), ``documents`` and ``strings`` of every row of a look that has more than one string.

    One row per row of the table, however many copies a string has: two rows are a pair of :func:`lookalike_pairs` if they
    share ``look`` and differ in ``variant`` (hex). The rows of a frequent look are spread when their class is looked up.
    """
    rows = materialize(lookalike_classes(df, key, text), "look").where(F.col(f"`{key}`").isNotNull())
    strings = rows.groupBy("look", "variant").agg(F.count("*").alias("n"))
    mixed = strings.groupBy("look").agg(F.sum("n").alias("documents"), F.count("*").alias("strings")).where("strings > 1")
    found = lookup_join(rows, mixed, ["look"])
    return found.select(key, F.lower(F.hex("look")).alias("look"), F.lower(F.hex("variant")).alias("variant"), "documents", "strings")


#: Parts into which the rows of one string are spread when they are joined.
SPREAD = 16


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``{key}_a`` < ``{key}_b``: every pair of rows whose texts look the same but are different strings.

    The fingerprints are written, so that the texts are read and normalized once. Then the different strings of each
    look are paired, one row per string whatever its number of copies, and only looks with more than one string go on.
    The rows of the more frequent string of a pair are joined first and those of the other one next, both spread over
    ``SPREAD`` parts by id: one string may hold a large share of all rows, and no task gets more than its part of them.
    """
    rows = materialize(lookalike_classes(df, key, text), "look").where(F.col(f"`{key}`").isNotNull())
    members = rows.select(F.col(f"`{key}`").alias("__m"), "variant")
    strings = rows.groupBy("look", "variant").agg(F.count("*").alias("members"))
    mixed = strings.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    live = strings.join(mixed, "look", "left_semi").select("look", F.struct("members", "variant").alias("s"))
    pairs = live.select("look", F.col("s").alias("sa")).join(live.select("look", F.col("s").alias("sb")), "look").where("sa > sb")
    pairs = pairs.select(F.col("sa.variant").alias("va"), F.col("sb.variant").alias("vb"))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(SPREAD))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint")))
    many = members.select(F.col("__m").alias("__a"), F.col("variant").alias("va"), part("__m").alias("__p"))
    half = pairs.withColumn("__p", parts).join(many, ["va", "__p"]).select("__a", "vb", part("__a").alias("__p"))
    few = lookup_join(members.withColumnRenamed("variant", "vb"), pairs.select("vb").distinct(), ["vb"])
    both = half.join(few.select("vb", F.col("__m").alias("__b"), parts.alias("__p")), ["vb", "__p"]).where("__a != __b")
    return both.select(F.least("__a", "__b").alias(f"{key}_a"), F.greatest("__a", "__b").alias(f"{key}_b")).distinct()
