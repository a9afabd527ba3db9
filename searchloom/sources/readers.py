"""Readers of files by their content: formats are recognised from the first bytes, and each has one reader."""

from __future__ import annotations

import ast
import csv
import gzip
import html.parser
import io
import json
import re
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that its format is told from.
HEAD = 65_536


def sniff(data: bytes, name: str = "") -> dict:
    """Family, encoding and dialect of a file from its first bytes; the name only breaks ties. ``alone``: the dialect if a file of a single line belongs to a CSV table."""
    zipped = data[:2] == b"\x1f\x8b"
    if zipped:
        try:
            data = gzip.GzipFile(fileobj=io.BytesIO(data)).read(HEAD)
        except (OSError, EOFError):
            pass
    out = {"gzip": zipped, "encoding": "utf-8"}
    if data[:16] == b"SQLite format 3\x00":
        return out | {"family": "sqlite"}
    if data[:5] == b"%PDF-":
        return out | {"family": "pdf"}
    if data[:4] == b"PK\x03\x04":
        return out | {"family": "docx" if b"word/" in data else "zip"}
    if data[:4] == b"PAR1":
        return out | {"family": "parquet"}
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        out["encoding"] = "utf-16"
    try:
        text = data.decode(out["encoding"], "strict" if len(data) < HEAD else "ignore")
    except UnicodeDecodeError:
        out["encoding"], text = "latin-1", data.decode("latin-1")
    if "\x00" in text:
        return out | {"family": "binary"}
    head = text.lstrip("\ufeff \t\r\n")
    lines = [x for x in head.splitlines() if x.strip()]
    if not lines:
        return out | {"family": "empty"}
    if re.match(r"(?i)<!doctype html|<html", head):
        return out | {"family": "html"}
    if head.startswith("<?xml") or re.match(r"<[A-Za-z][\w:.-]*[\s>]", head):
        return out | {"family": "xml"}
    objects = sum(x.lstrip().startswith("{") and x.rstrip().endswith("}") for x in lines[:50])
    if objects >= max(1, 0.8 * min(len(lines), 50)) and (len(lines) > 1 or not head.startswith("[")):
        return out | {"family": "jsonl" if len(lines) > 1 else "json"}
    if head[0] in "[{":
        return out | {"family": "json"}
    if re.search(r"(?im)^\s*(insert\s+into|create\s+table)\b", head):
        return out | {"family": "sqldump"}
    if sum(bool(re.match(r'\S+ \S+ \S+ \[[^\]]+\] "', x)) for x in lines[:20]) >= max(1, min(len(lines), 20) // 2):
        return out | {"family": "access_log"}
    if sum(bool(re.match(r"<\d{1,3}>|\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\w{3} +\d+ \d\d:\d\d:\d\d ", x)) for x in lines[:20]) >= max(2, min(len(lines), 20) // 2):
        return out | {"family": "log"}
    if name.endswith((".py", ".js", ".ts", ".tsx", ".rs", ".go", ".java", ".c", ".cc", ".cpp", ".rb", ".php", ".cs", ".sh")):
        return out | {"family": "code"}
    best = ("", 0)
    for sep in ",;\t|":
        counts = [x.count(sep) for x in lines[:30]]
        if min(counts) >= 1 and max(counts) - min(counts) <= max(1, max(counts) // 4) and sum(counts) > best[1]:
            best = (sep, sum(counts))
    if best[0]:
        cells = [c for x in lines[1:20] for c in x.split(best[0])]
        comma = sum(bool(re.fullmatch(r'"?-?\d+,\d+"?', c.strip())) for c in cells) > sum(bool(re.fullmatch(r'"?-?\d+\.\d+"?', c.strip())) for c in cells)
        first = lines[0].split(best[0])
        table = {"family": "csv", "separator": best[0], "decimal_comma": comma and best[0] != ",", "header": not any(re.fullmatch(r'"?-?\d+([.,]\d+)?"?', c.strip()) for c in first), "first": lines[0]}
        if len(lines) > 1:
            return out | table
        if len(data) < HEAD:
            out["alone"] = table
    if re.match(r"---\s*$|[\w-]+:\s", lines[0]) and sum(bool(re.match(r"\s*(- |[\w-]+:(\s|$))", x)) for x in lines[:30]) >= 0.7 * min(len(lines), 30):
        return out | {"family": "yaml"}
    words = [len(x.split()) for x in lines[:50]]
    return out | {"family": "prose" if sum(words) / len(words) >= 8 else "lines"}


def families(spark: SparkSession, path: str) -> dict[str, dict]:
    """What :func:`sniff` says of every file of a path, folder or pattern; the first ``HEAD`` bytes of each are read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo, out = list(fs.globStatus(p) or []), {}
    while todo:
        f = todo.pop()
        name = f.getPath().getName()
        if f.isDirectory():
            todo += list(fs.listStatus(f.getPath()))
        elif not name.startswith(("_", ".")):
            stream = fs.open(f.getPath())
            try:
                head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEAD)))
            finally:
                stream.close()
            out[f.getPath().toString()] = sniff(head, name) | {"head": head}
    _single_lines(out)
    return out


def _single_lines(kinds: dict[str, dict]) -> None:
    """Files of a single line get the dialect of the CSV file that they belong to: Spark writes the header alone where a task has no rows.

    Beside CSV files with a header such a file must repeat it, beside others it must have as many values; it stays apart otherwise. Without
    any CSV file beside them, files that are named so and all have the same line are CSV files.
    """
    alone = {n: k["alone"] for n, k in sorted(kinds.items()) if "alone" in k}
    tables = [k for _, k in sorted(kinds.items()) if k["family"] == "csv"]
    for name, one in alone.items():
        for t in tables:
            if one["first"] == t["first"] if t["header"] else _values(one["first"], t) == _values(t["first"], t):
                kinds[name] |= {k: t[k] for k in ("family", "encoding", "separator", "decimal_comma", "header", "first")} | {"rows": not t["header"]}
                break
    named = {n: one for n, one in alone.items() if re.search(r"(?i)\.[ct]sv(\.gz)?$", n)}
    if not tables and len({one["first"] for one in named.values()}) == 1:
        for name, one in named.items():
            kinds[name] |= one | {"rows": not one["header"]}


def _values(line: str, kind: dict) -> int:
    return len(next(csv.reader([line], delimiter=kind["separator"])))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A file, or a folder of files of one format (empty ones aside); files of several formats are refused, :func:`read_folder` takes those."""
    kinds = families(spark, path)
    if not kinds:
        raise FileNotFoundError(path)
    full = {n: k for n, k in sorted(kinds.items()) if k["family"] != "empty"} or kinds
    found = {k["family"] for k in full.values()}
    if len(found) > 1:
        raise ValueError(f"files of several formats: {sorted(found)}")
    return _read(spark, path, next(iter(full.values())))


def read_folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The files of a folder as one table per format."""
    by: dict[str, list[str]] = {}
    kinds = families(spark, path)
    for name, k in sorted(kinds.items()):
        if k["family"] != "empty":
            by.setdefault(k["family"], []).append(name)
    out = {}
    for family, names in by.items():
        for name in [n for n in names if kinds[n].get("rows", True)] or names:  # a header alone adds only columns of text
            part = _read(spark, name, kinds[name])
            out[family] = part if family not in out else out[family].unionByName(part, allowMissingColumns=True)
    return out


def _read(spark: SparkSession, path: str, kind: dict) -> DataFrame:
    """Files of the format that their first one shows."""
    head = {"c": kind["head"]}
    family = kind["family"]
    if family == "csv":
        df = spark.read.csv(path, sep=kind["separator"], header=kind["header"], inferSchema=True, encoding=kind["encoding"])
        if kind["decimal_comma"]:
            for c, t in df.dtypes:
                if t == "string":
                    bad = F.sum((F.col(f"`{c}`").isNotNull() & ~F.col(f"`{c}`").rlike(r"^-?\d+(,\d+)?$")).cast("int"))
                    if df.agg(F.coalesce(bad, F.lit(0)) == 0).first()[0]:
                        df = df.withColumn(c, F.regexp_replace(f"`{c}`", ",", ".").try_cast("double"))
        return df
    if family == "jsonl":
        return spark.read.json(path)
    if family == "json":
        return spark.read.json(path, multiLine=True)
    if family == "parquet":
        return spark.read.parquet(path)
    if family == "xml":
        return read_xml(spark, path, bytes(head["c"]).decode(kind["encoding"], "ignore"))
    if family == "html":
        return read_html(spark, path)
    if family == "sqldump":
        return read_sql_dump(spark, path)
    if family == "sqlite":
        return read_sqlite(spark, path)
    if family == "docx":
        return read_docx(spark, path)
    if family == "yaml":
        return read_yaml(spark, path)
    if family == "code":
        return read_code(spark, path)
    if family in ("access_log", "log"):
        from searchloom.sources.logs import parse_syslog, read_access_log

        return (read_access_log if family == "access_log" else parse_syslog)(spark.read.text(path))
    if family == "prose":
        return read_sections(spark, path)
    if family in ("lines", "empty"):
        return spark.read.text(path)
    raise ValueError(f"no reader for {family} files")


def read_xml(spark: SparkSession, path: str, head: str) -> DataFrame:
    """Records of the element that repeats below the root."""
    tags = re.findall(r"<([A-Za-z][\w:.-]*)", head)
    counts: dict[str, int] = {}
    for t in tags[1:]:
        counts[t] = counts.get(t, 0) + 1
    row = next((t for t in tags[1:] if counts[t] > 1), tags[1] if len(tags) > 1 else tags[0])
    return spark.read.format("xml").option("rowTag", row).load(path)


class _Html(html.parser.HTMLParser):
    """Title, text and links of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links, self.stack = "", [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "noscript"):
            self.stack.append(tag)
        if tag == "a" and (h := dict(attrs).get("href")):
            self.links.append(h)
        if tag in ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "tr", "section"):
            self.text.append("\n")

    def handle_endtag(self, tag):
        if self.stack and self.stack[-1] == tag:
            self.stack.pop()

    def handle_data(self, data):
        if not self.stack:
            self.text.append(data)
        elif self.stack[-1] == "title":
            self.title += data


def parse_html(s: str) -> tuple[str, str, list[str]]:
    p = _Html()
    p.feed(s or "")
    text = re.sub(r"[ \t]*\n\s*", "\n", re.sub(r"[ \t]+", " ", "".join(p.text))).strip()
    return p.title.strip(), text, p.links


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _per_file(spark: SparkSession, path: str, f, schema: str) -> DataFrame:
    """Rows that ``f`` makes of each file's path and bytes; files are read by the executors."""
    names = [x.name for x in T.StructType.fromDDL(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                yield pd.DataFrame(list(f(p, bytes(c))), columns=names)

    return _files(spark, path).mapInPandas(run, schema)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, lambda p, c: [(p, *parse_html(c.decode("utf-8", "replace")))], "path string, title string, text string, links array<string>")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of prose: a heading (marked, underlined or numbered) begins one."""

    def split(p: str, c: bytes):
        title, lines, n = "", [], 0
        for x in c.decode("utf-8", "replace").splitlines():
            m = re.match(r"\s*(#{1,6}\s+(.+)|(\d+\.)+\s+\S.{0,80}$)", x)
            if m:
                if "".join(lines).strip():
                    yield p, n, title, "\n".join(lines).strip()
                    n += 1
                title, lines = (m[2] or x).strip(), []
            else:
                lines.append(x)
        if "".join(lines).strip():
            yield p, n, title, "\n".join(lines).strip()

    return _per_file(spark, path, split, "path string, section int, title string, text string")


def parse_inserts(text: str):
    """(table, {column: value}) of each row of INSERT statements."""
    columns: dict[str, list[str]] = {}
    for m in re.finditer(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?([\w.]+)[`\"]?\s*\((.*?)\)\s*[^,()]*;", text):
        parts = re.split(r",(?![^()]*\))", m[2])
        names = [re.match(r"\s*[`\"]?(\w+)[`\"]?", p) for p in parts]
        columns[m[1]] = [n[1] for n in names if n and n[1].upper() not in ("PRIMARY", "KEY", "UNIQUE", "CONSTRAINT", "FOREIGN", "CHECK")]
    for m in re.finditer(r"(?is)insert\s+into\s+[`\"]?([\w.]+)[`\"]?\s*(?:\(([^)]*)\))?\s*values\s*", text):
        names = [c.strip(' `"') for c in m[2].split(",")] if m[2] else columns.get(m[1])
        at = m.end()
        while at < len(text) and text[at] == "(":
            values, at = _tuple(text, at + 1)
            yield m[1], dict(zip(names or [f"c{i}" for i in range(len(values))], values))
            n = re.compile(r"\s*,\s*").match(text, at)
            if not n:
                break
            at = n.end()


def _tuple(text: str, at: int):
    values, token = [], re.compile(r"\s*('(?:[^'\\]|\\.|'')*'|[^,()']+)\s*(,|\))", re.DOTALL)
    while True:
        m = token.match(text, at)
        if not m:
            return values, at
        v = m[1].strip()
        if v[:1] == "'":
            v = re.sub(r"\\(.)", r"\1", v[1:-1].replace("''", "'"))
        elif v.upper() == "NULL":
            v = None
        values.append(v)
        at = m.end()
        if m[2] == ")":
            return values, at


def read_sql_dump(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the INSERT statements: table and a map of values as text."""
    return _per_file(spark, path, lambda p, c: [(t, r) for t, r in parse_inserts(c.decode("utf-8", "replace"))], "table string, row map<string,string>")


def read_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all tables: table and a map of values as text."""

    def rows(_: str, c: bytes):
        with tempfile.NamedTemporaryFile(suffix=".db") as f:  # within one task only
            f.write(c)
            f.flush()
            db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
            for (t,) in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name"):
                cur = db.execute(f'select * from "{t}"')
                names = [d[0] for d in cur.description]
                for r in cur:
                    yield t, {n: None if v is None else str(v) for n, v in zip(names, r)}

    return _per_file(spark, path, rows, "table string, row map<string,string>")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of word-processor files."""

    def paragraphs(p: str, c: bytes):
        import xml.etree.ElementTree as ET

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        root = ET.fromstring(zipfile.ZipFile(io.BytesIO(c)).read("word/document.xml"))
        for i, x in enumerate(root.iter(f"{w}p")):
            style = x.find(f"{w}pPr/{w}pStyle")
            t = "".join(y.text or "" for y in x.iter(f"{w}t"))
            if t.strip():
                yield p, i, style.get(f"{w}val") if style is not None else None, t

    return _per_file(spark, path, paragraphs, "path string, paragraph int, style string, text string")


def parse_yaml(text: str) -> list[dict]:
    """Documents of plain YAML: nested mappings by indentation, lists, scalars; flattened to dotted names."""
    out = []
    for doc in re.split(r"(?m)^---\s*$", text):
        flat: dict[str, str] = {}
        stack: list[tuple[int, str]] = []
        for line in doc.splitlines():
            line = re.sub(r"\s+#.*$", "", line)
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            indent = len(line) - len(line.lstrip())
            while stack and stack[-1][0] >= indent and not line.lstrip().startswith("- "):
                stack.pop()
            prefix = ".".join(n for _, n in stack)
            body = line.strip()
            if body.startswith("- "):
                flat[prefix] = (flat[prefix] + "," if prefix in flat else "") + body[2:].strip("'\" ")
                continue
            m = re.match(r"([\w.-]+)\s*:\s*(.*)$", body)
            if m:
                name = f"{prefix}.{m[1]}" if prefix else m[1]
                if m[2]:
                    flat[name] = m[2].strip("'\"")
                else:
                    stack.append((indent, m[1]))
        if flat:
            out.append(flat)
    return out


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, lambda p, c: [(p, i, d) for i, d in enumerate(parse_yaml(c.decode("utf-8", "replace")))], "path string, document int, fields map<string,string>")


#: How definitions begin in languages other than Python.
_SYMBOL = re.compile(r"^\s*(?:export\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|pub(?:\([^)]*\))?\s+|final\s+|abstract\s+)*(?:(class|interface|trait|struct|enum|module|namespace|impl|type|function|func|fn|def)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)|([A-Za-z_][\w<>*&:\s]*\s+[*&]?)([A-Za-z_]\w*)\s*\([^;]*\)\s*\{)")


def code_symbols(path: str, text: str):
    """(kind, name, line) of the definitions in a source file."""
    if path.endswith(".py"):
        try:
            tree = ast.parse(text)
        except SyntaxError:
            return
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield ("class" if isinstance(node, ast.ClassDef) else "function"), node.name, node.lineno
        return
    for i, line in enumerate(text.splitlines(), 1):
        m = _SYMBOL.match(line)
        if m and (m[1] or m[4] not in ("if", "for", "while", "switch", "return", "catch")):
            kind = m[1] or "function"
            yield ("function" if kind in ("func", "fn", "def") else kind), m[2] or m[4], i


def read_code(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, lambda p, c: [(p, k, n, i) for k, n, i in code_symbols(p, c.decode("utf-8", "replace"))], "path string, kind string, name string, line int")


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Structs to columns with dotted, sanitised names."""
    cols, seen = [], set()

    def walk(t: T.StructType, col, prefix: str) -> None:
        for f in t.fields:
            name = prefix + re.sub(r"[^\w.@-]+", "_", f.name.strip()).strip("_")
            c = col[f.name] if col is not None else F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, c, name + separator)
            else:
                while name in seen:
                    name += "_"
                seen.add(name)
                cols.append(c.alias(name))

    walk(df.schema, None, "")
    return df.select(*cols)


def cluster_schemas(schemas: dict[str, list[str]], least: float = 0.6) -> list[list[str]]:
    """Files grouped by the similarity of their field sets; driver-side, over one entry per file."""
    groups: list[tuple[set[str], list[str]]] = []
    for name, fields in sorted(schemas.items()):
        s = set(fields)
        best = max(groups, key=lambda g: len(s & g[0]) / max(1, len(s | g[0])), default=None)
        if best and len(s & best[0]) / max(1, len(s | best[0])) >= least:
            best[1].append(name)
            best[0].update(s)
        else:
            groups.append((s, [name]))
    return [g[1] for g in groups]


def to_json_lines(rows: list[dict]) -> str:
    return "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
