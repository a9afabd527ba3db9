"""Analysis of text as columns: tokenizers, token filters, analyzers, phrases, relevance, highlighting.

Built-in functions do the work, so texts stay in the JVM; only stemming and transposition-aware edit distance go through
Arrow. ``standard`` takes runs of letters, digits and underscores for words, which differs from the Unicode word rules at
apostrophes and points inside words.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual English stop words of search analyzers.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
WORD = r"[\p{L}\p{N}_]+"


def standard(c: Column) -> Column:
    """Lower-cased words; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def whitespace(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")


def keyword(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))


def pattern(c: Column, regex: str = r"\W+") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), regex), lambda t: t != "")


def stop(tokens: Column, words: list[str] | None = None) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(words if words is not None else STOPWORDS))


def length_filter(tokens: Column, lowest: int = 0, highest: int = 1 << 30) -> Column:
    return F.filter(tokens, lambda t: F.length(t).between(lowest, highest))


def synonyms(tokens: Column, table: dict[str, list[str]]) -> Column:
    """Each token, and behind it its synonyms."""
    if not table:
        return tokens
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(m[t], F.array().cast("array<string>")))))


#: Accented letters and their ASCII forms.
_FOLD_FROM, _FOLD_TO = "àáâãäåāăąçćčďđèéêëēĕėęěğģìíîïīĭįıķĺļľłñńņňòóôõöøōŏőŕŗřśşšţťùúûüūŭůűųýÿźżž", "aaaaaaaaacccddeeeeeeeeeggiiiiiiiikllllnnnnooooooooorrrsssttuuuuuuuuuyyzzz"


def asciifold(tokens: Column) -> Column:
    upper = [(a.upper(), b.upper()) for a, b in zip(_FOLD_FROM, _FOLD_TO) if len(a.upper()) == 1 and a.upper() != b.upper()]
    a, b = _FOLD_FROM + "".join(x for x, _ in upper), _FOLD_TO + "".join(y for _, y in upper)
    return F.transform(tokens, lambda t: F.replace(F.replace(F.translate(t, a, b), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")))


def ngrams(c: Column, shortest: int, longest: int, edge: bool = False) -> Column:
    """Character n-grams, by start and then length; of the beginning only with ``edge``."""
    last = F.lit(1) if edge else F.greatest(F.lit(1), F.length(c))
    grams = lambda i: F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: F.when(i + n - 1 <= F.length(c), F.substring(c, i, n)))
    return F.coalesce(F.filter(F.flatten(F.transform(F.sequence(F.lit(1), last), grams)), lambda g: g.isNotNull()), F.array().cast("array<string>"))


def shingles(tokens: Column, n: int = 2, joint: str = " ") -> Column:
    """Runs of ``n`` tokens."""
    some = F.size(tokens) >= n
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - n + 1))
    return F.when(some, F.transform(starts, lambda i: F.concat_ws(joint, F.slice(tokens, i, n)))).otherwise(F.array().cast("array<string>"))


def cjk_bigrams(c: Column) -> Column:
    """Pairs of neighbouring ideographs and kana, single ones where they stand alone, and ordinary words."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+|[\p{L}\p{N}_&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]+"), F.lit(0))
    ideographs = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,}$"
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 1)), lambda i: F.substring(t, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda t: F.when(t.rlike(ideographs), pairs(t)).otherwise(F.array(t))))


_VOWEL = "[aeiouy]"


def stem_word(w: str) -> str:
    """A light English stemmer: plural, -ed, -ing and common derivational endings, in the order of the public rules."""
    if len(w) <= 2:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: -len(end)] + "ee"
    for end in ("ingly", "edly", "ing", "ed"):
        if w.endswith(end) and re.search(_VOWEL, w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif re.fullmatch(r"[^aeiouy]*[aeiouy][^aeiouywx]", w):
                w += "e"
            break
    if len(w) > 2 and w[-1] == "y" and w[-2] not in "aeiou":
        w = w[:-1] + "i"
    for end, new in (("ational", "ate"), ("tional", "tion"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("fulli", "ful")):
        if w.endswith(end) and len(w) > len(end) + 2:
            return w[: -len(end)] + new
    return w


def _stem(tokens: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ts: [stem_word(t) for t in ts], na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(tokens)


#: Analyzers by name.
ANALYZERS: dict[str, Callable[[Column], Column]] = {
    "standard": standard,
    "simple": lambda c: F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0)), F.array().cast("array<string>")),
    "whitespace": whitespace,
    "keyword": keyword,
    "lowercase": lambda c: F.transform(keyword(c), F.lower),
    "english": lambda c: _stem(stop(standard(c))),
    "stemmer": lambda c: _stem(standard(c)),
    "icu_folding": lambda c: asciifold(standard(c)),
    "ecommerce": lambda c: asciifold(standard(F.regexp_replace(c, "(?<=\\p{L})[-'](?=\\p{L})", ""))),
    "cjk": cjk_bigrams,
    "thai": lambda c: standard(c),
}


def build_analyzer(settings: dict) -> Callable[[Column], Column]:
    """An analyzer from ``{"tokenizer": ..., "filter": [...]}``; both take a name or an object with ``type``."""
    tok = settings.get("tokenizer", "standard")
    tok = {"type": tok} if isinstance(tok, str) else tok
    start = {
        "standard": lambda c: F.coalesce(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.array().cast("array<string>")),
        "whitespace": whitespace,
        "keyword": keyword,
        "pattern": lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), tok.get("pattern", r"\W+")), lambda t: t != ""),
        "ngram": lambda c: ngrams(c, tok.get("min_gram", 1), tok.get("max_gram", 2)),
        "edge_ngram": lambda c: ngrams(c, tok.get("min_gram", 1), tok.get("max_gram", 2), edge=True),
    }
    if tok["type"] not in start:
        raise ValueError(f"unknown tokenizer {tok['type']}")
    steps = []
    for f in settings.get("filter", []):
        f = {"type": f} if isinstance(f, str) else f
        steps.append(f)

    def run(c: Column) -> Column:
        t = start[tok["type"]](c)
        for f in steps:
            kind = f["type"]
            if kind == "lowercase":
                t = F.transform(t, F.lower)
            elif kind == "stop":
                t = stop(t, f.get("stopwords"))
            elif kind == "length":
                t = length_filter(t, f.get("min", 0), f.get("max", 1 << 30))
            elif kind == "synonym":
                t = synonyms(t, f.get("synonyms", {}))
            elif kind == "asciifolding":
                t = asciifold(t)
            elif kind == "stemmer":
                t = _stem(t)
            elif kind == "shingle":
                t = F.concat(t, shingles(t, f.get("size", 2)))
            else:
                raise ValueError(f"unknown token filter {kind}")
        return t

    return run


def python_tokens(text: str) -> list[str]:
    """The ``standard`` tokens of a query text."""
    return re.findall(r"\w+", text.lower())


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, with ``c`` computed once: inside ``f`` it is a bound variable, also in the lambdas of ``f``."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def tf(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


_JOINT = "\x1f"


def _joined(tokens: Column) -> Column:
    return F.concat(F.lit(_JOINT), F.array_join(tokens, _JOINT), F.lit(_JOINT))


def phrase(tokens: Column, terms: list[str], last_is_prefix: bool = False) -> Column:
    """Whether the terms stand next to each other in this order; the last one may be the beginning of a token."""
    return _joined(tokens).contains(_JOINT + _JOINT.join(terms) + ("" if last_is_prefix else _JOINT))


def positions(tokens: Column, term: str) -> Column:
    """Positions of a term, from 0."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(t == term, i)), lambda i: i.isNotNull())


def _next_place(places: Column) -> Callable[[Column], Column]:
    def step(e: Column) -> Column:
        at = F.array_min(F.filter(places, lambda p: p > e["at"]))
        return F.struct(at.cast("int").alias("at"), (e["gap"] + at - e["at"] - 1).cast("int").alias("gap"))

    return step


def _narrow(ends: Column, slop: int) -> Callable[[Column], Column]:
    return lambda places: F.filter(F.transform(ends, _next_place(places)), lambda e: e["at"].isNotNull() & (e["gap"] <= slop))


def sloppy_phrase(tokens: Column, terms: list[str], slop: int) -> Column:
    """Whether the terms occur in this order with at most ``slop`` other tokens between them in all.

    From each place of the first term the earliest place of the next one is taken, and the gaps are added up.
    """
    ends = F.transform(positions(tokens, terms[0]), lambda p: F.struct(p.cast("int").alias("at"), F.lit(0).alias("gap")))
    for term in terms[1:]:
        ends = let(positions(tokens, term), _narrow(ends, slop))
    return F.size(ends) > 0


def bm25_idf(n: float, df: float) -> float:
    import math

    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def damerau_levenshtein(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits, a swap of neighbours being one, turn ``a`` into ``b``."""
    if abs(len(a) - len(b)) > most:
        return False
    older, old, new = [], list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        if min(new) > most and min(old) > most:
            return False
        older, old = old, new
    return old[-1] <= most


def fuzzy_edits(fuzziness, term: str) -> int:
    """``AUTO``: none up to 2 letters, one up to 5, else two; or a fixed number."""
    text = str(fuzziness).upper()
    if text.startswith("AUTO"):
        low, high = (map(int, text[5:].split(","))) if ":" in text else (3, 6)
        return 0 if len(term) < low else 1 if len(term) < high else 2
    if not text.isdigit():
        raise ValueError(f"fuzziness must be AUTO or a number, not {fuzziness!r}")
    return int(text)


def fuzzy_any(tokens: Column, term: str, edits: int) -> Column:
    """Whether any token is within ``edits`` edits. Spark's distance, which counts a swap as two, leaves few to the slow test."""

    @F.pandas_udf("boolean")
    def exact(s: pd.Series) -> pd.Series:
        seen: dict[str, bool] = {}

        def near(ts) -> bool:
            for t in ts if ts is not None else ():
                if t not in seen:
                    seen[t] = damerau_levenshtein(t, term, edits)
                if seen[t]:
                    return True
            return False

        return s.map(near)

    if edits == 0:
        return F.array_contains(tokens, term)
    loose = F.filter(tokens, lambda t: (F.length(t).between(len(term) - edits, len(term) + edits)) & (F.levenshtein(t, F.lit(term)) <= 2 * edits))
    return exact(loose)


def highlight(c: Column, terms: list[str], pre: str = "<em>", post: str = "</em>") -> Column:
    """The text with every whole-word occurrence of a term marked; null if there is none."""
    if not terms:
        return F.lit(None).cast("string")
    words = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    rx = rf"(?iu)(?<![\p{{L}}\p{{N}}_])({words})(?![\p{{L}}\p{{N}}_])"
    safe = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(c.rlike(rx), F.regexp_replace(c, rx, f"{safe(pre)}$1{safe(post)}"))


def fragments(c: Column, terms: list[str], pre: str = "<em>", post: str = "</em>", size: int = 100, most: int = 5) -> Column:
    """The first ``most`` pieces of about ``size`` characters, cut at blanks, that have a term, each with its terms marked; an array."""
    pieces = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?s)\S.{{0,{max(1, size) - 1}}}(?=\s|$)|\S{{{max(1, size)}}}"), F.lit(0))
    return F.slice(F.filter(F.transform(pieces, lambda x: highlight(x, terms, pre, post)), lambda x: x.contains(pre)), 1, most)
