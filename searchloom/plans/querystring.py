"""Query strings, parsed to query documents."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"""\s*(
    \(|\)|AND\b|OR\b|NOT\b|&&|\|\||!(?=\S)|[+-](?=[^\s])
  | (?:[\w.*]+:)?"(?:[^"\\]|\\.)*"(?:~\d+)?(?:\^[\d.]+)?
  | (?:[\w.]+:)?[\[{][^\]}]*?\ TO\ [^\]}]*?[\]}](?:\^[\d.]+)?
  | (?:[\w.]+):(?=\()
  | (?:\\.|[^\s()"])+
)""", re.VERBOSE)


class QueryStringError(ValueError):
    """The string can't be parsed."""


def _value(text: str):
    text = text.strip().strip('"')
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _leaf(token: str, fields: list[str], operator: str) -> dict:
    boost = 1.0
    if m := re.search(r"\^([\d.]+)$", token):
        boost, token = float(m[1]), token[: m.start()]
    m = re.match(r"([\w.]+):(?=.)", token)
    if m and not token.startswith('"'):
        fields, token = [m[1]], token[m.end() :]
    if fields == ["_exists_"]:
        return {"exists": {"field": token}}

    def one(f: str) -> dict:
        if f == "*" or not f:
            raise QueryStringError("a field is needed")
        f, _, up = f.partition("^")
        b = boost * float(up or 1)
        if m := re.fullmatch(r"([\[{])(.*?) TO (.*?)([\]}])", token):
            r = {}
            if m[2] != "*":
                r["gte" if m[1] == "[" else "gt"] = _value(m[2])
            if m[3] != "*":
                r["lte" if m[4] == "]" else "lt"] = _value(m[3])
            return {"range": {f: r | {"boost": b}}}
        if m := re.fullmatch(r"(>=|<=|>|<)(.+)", token):
            return {"range": {f: {{">=": "gte", "<=": "lte", ">": "gt", "<": "lt"}[m[1]]: _value(m[2]), "boost": b}}}
        if m := re.fullmatch(r'"((?:[^"\\]|\\.)*)"(?:~(\d+))?', token):
            return {"match_phrase": {f: {"query": re.sub(r"\\(.)", r"\1", m[1]), "slop": int(m[2] or 0), "boost": b}}}
        if m := re.fullmatch(r"(\S+?)~(\d?)", token):
            return {"fuzzy": {f: {"value": m[1], "fuzziness": m[2] or "AUTO", "boost": b}}}
        if token == "*":
            return {"exists": {"field": f}}
        if re.search(r"(?<!\\)[*?]", token):
            return {"wildcard": {f: {"value": token, "boost": b}}}
        return {"match": {f: {"query": re.sub(r"\\(.)", r"\1", token), "operator": operator, "boost": b}}}

    parts = [one(f) for f in fields]
    return parts[0] if len(parts) == 1 else {"dis_max": {"queries": parts}}


def parse_query_string(text: str, fields: list[str], default_operator: str = "or") -> dict:
    """Fields, phrases, ranges, wildcards, fuzziness, boosts, AND/OR/NOT, + and -, parentheses."""
    toks, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryStringError(f"can't read {text[at:]!r}")
        toks.append(m[1].strip())
        at = m.end()
    pos = 0
    op_and = default_operator.lower() == "and"

    def peek() -> str:
        return toks[pos] if pos < len(toks) else ""

    def group(names: list[str], depth: int) -> dict:
        nonlocal pos
        if depth > 64:
            raise QueryStringError("nested too deeply")
        must, should, never = [], [], []
        joined = ""
        while peek() and peek() != ")":
            t = peek()
            if t in ("AND", "&&", "OR", "||"):
                joined = "AND" if t in ("AND", "&&") else "OR"
                pos += 1
                if joined == "AND" and should:
                    must.append(should.pop())
                continue
            sign = ""
            while peek() in ("NOT", "!", "+", "-"):
                sign = "-" if peek() in ("NOT", "!", "-") else "+"
                pos += 1
            t = peek()
            if not t:
                raise QueryStringError("the query ends in an operator")
            if t == "(":
                pos += 1
                q = group(names, depth + 1)
                if peek() != ")":
                    raise QueryStringError("a parenthesis is not closed")
                pos += 1
            elif re.fullmatch(r"[\w.]+:", t):
                pos += 2
                q = group([t[:-1]], depth + 1)
                if peek() != ")":
                    raise QueryStringError("a parenthesis is not closed")
                pos += 1
            else:
                pos += 1
                q = _leaf(t, names, default_operator)
            if sign == "-":
                never.append(q)
            elif sign == "+" or joined == "AND" or op_and and joined != "OR":
                must.append(q)
            else:
                should.append(q)
            joined = ""
        if len(must) + len(should) == 1 and not never:
            return (must + should)[0]
        return {"bool": {"must": must, "should": should, "must_not": never} | ({"minimum_should_match": 1} if should and not must else {})}

    q = group(fields, 0)
    if pos < len(toks):
        raise QueryStringError("a parenthesis too many")
    return q


def parse_simple(text: str, fields: list[str], default_operator: str = "or") -> dict:
    """The lenient form, which never fails: ``+`` and, ``|`` or, ``-`` not; anything else is text."""
    must, should, never = [], [], []
    for t in text.split():
        sign, word = (t[0], t[1:]) if t[0] in "+-|" and len(t) > 1 else ("", t)
        word = word.strip('"()')
        if not word or word in "+-|":
            continue
        q = {"match": {fields[0]: {"query": word}}} if len(fields) == 1 else {"multi_match": {"query": word, "fields": fields}}
        {"+": must, "-": never, "|": should}.get(sign, must if default_operator.lower() == "and" else should).append(q)
    if not (must or should or never):
        return {"match_none": {}}
    return {"bool": {"must": must, "should": should, "must_not": never} | ({"minimum_should_match": 1} if should and not must else {})}
