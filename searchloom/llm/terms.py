"""Term counts of a collection, kept up to date from signed changes.

A record contributes its terms once with sign +1 when it is added and once with sign -1 when it is removed; a change is
both. Only the changed records are tokenized. Their terms are summed to one signed row per term, and that delta is
merged into counts kept on disk in hash buckets; buckets without a changed term are not read or rewritten.

Defined results: a null field counts as empty; a record without terms is a record still; repeated records count each
time; an empty collection has no terms; columns other than the named fields are ignored, whatever they are called.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.scratch import materialize

#: A term: a maximal run of letters or digits of any script.
TERM = r"[\p{L}\p{N}]+"
#: The columns of the counts on disk; a version that holds no row has no file to tell them.
COUNTS = "term string, occurrences bigint, records bigint, bucket int"
#: The row of the counts that holds the number of records. No term is empty.
ALL_RECORDS = ""
#: Terms of a bucket where their number is free; deltas beside a bucket's counts, and their share of it (one in so many), at which they are merged.
BUCKET_TERMS, MERGE_RUNS, MERGE_SHARE = 500_000, 4, 8
#: Seconds for which an unfinished manifest is taken for that of a writer at work.
GRACE_S = 60


def record_text(fields: list[str]) -> Column:
    """The fields joined by a separator that is part of no term, lower-cased; null counts as empty."""
    return F.lower(F.concat_ws("\n", *[F.coalesce(F.col(f"`{f}`"), F.lit("")) for f in fields]))


def record_terms(df: DataFrame, fields: list[str], keep: list[Column] | None = None) -> DataFrame:
    """One row per record: the kept columns, ``terms`` (each distinct term with its ``tf``) and ``dl`` (its length in terms).

    Terms are sorted within the row and run lengths are taken, so no shuffle is needed and a text of any length costs n log n.
    """
    keep = keep or []
    runs = df.select(*keep, F.array_sort(F.regexp_extract_all(record_text(fields), F.lit(TERM), F.lit(0))).alias("__t"))
    names = [c for c in runs.columns if c != "__t"]
    starts = F.expr("filter(sequence(1, size(__t)), i -> i = 1 or element_at(__t, i) != element_at(__t, i - 1))")
    runs = runs.select(*names, "__t", F.when(F.size("__t") > 0, starts).otherwise(F.array().cast("array<int>")).alias("__s"))
    pairs = F.expr("transform(__s, (p, j) -> struct(element_at(__t, p) as term, (coalesce(get(__s, j + 1), size(__t) + 1) - p) as tf))")
    return runs.select(*names, F.size("__t").alias("dl"), pairs.alias("terms"))


def term_frequencies(df: DataFrame, fields: list[str], keep: list[Column] | None = None, extra: str | None = None) -> DataFrame:
    """One row per record and distinct term: the kept columns, ``term``, ``tf`` and ``dl``, from :func:`record_terms`.

    ``extra`` adds one row of that term with frequency 0 to each record.
    """
    runs = record_terms(df, fields, keep)
    names = [c for c in runs.columns if c not in ("terms", "dl")]
    pairs = F.col("terms")
    if extra is not None:
        pairs = F.concat(pairs, F.expr(f"array(struct('{extra}' as term, 0 as tf))"))
    out = runs.select(*names, "dl", F.explode(pairs).alias("__p"))
    return out.select(*names, F.col("__p.term").alias("term"), F.col("__p.tf").cast("bigint").alias("tf"), "dl")


def signed_changes(old: DataFrame | None, new: DataFrame, columns: list[str]) -> DataFrame:
    """The net difference of two snapshots over ``columns``, with ``sign``: how often each record was added or, below 0, removed.

    Records are compared by value, as a multiset, so null keys and repeated records need no special case. The heavy
    columns travel only once: records are matched by a 128-bit fingerprint that is aggregated before the shuffle.
    """
    cols = [F.col(f"`{c}`") for c in columns]
    added = new.select(*cols, F.lit(1).cast("bigint").alias("sign"))
    if old is None:
        return added
    both = added.unionByName(old.select(*cols, F.lit(-1).cast("bigint").alias("sign")))
    key = F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols[::-1]).alias("b"))
    net = both.groupBy(key.alias("__k")).agg(F.sum("sign").alias("sign"), *[F.first(c).alias(n) for c, n in zip(cols, columns)])
    return net.where("sign != 0").select(*columns, "sign")


def term_delta(changes: DataFrame, fields: list[str]) -> DataFrame:
    """``term``, ``occurrences``, ``records``: the signed sums over the changed records, aggregated before the shuffle."""
    t = term_frequencies(changes, fields, [F.col("sign")], extra=ALL_RECORDS)
    return t.groupBy("term").agg(F.sum(F.col("tf") * F.col("sign")).alias("occurrences"), F.sum("sign").alias("records"))


class TermCounts:
    """Persistent counts per term in ``path``, in hash buckets, changed only by signed deltas.

    A change writes its delta to a folder of its own and then a manifest that names the folders of every bucket; a reader
    follows the newest manifest, so a change that fails before its manifest leaves the old state in force and can be
    tried again. A bucket whose delta is small against it keeps the delta beside its counts; one whose deltas have come
    to a share of ``MERGE_SHARE`` of it, or to ``MERGE_RUNS``, is merged: so a bucket is rewritten in proportion to what has
    changed in it, and buckets without a changed term aren't read at all. Without ``buckets`` their number follows the
    vocabulary (``BUCKET_TERMS`` terms each), and grows with it.

    A manifest is created only if its number is free, so of two writers that start from one version the second fails
    and may try again. An unfinished manifest counts as a writer at work for ``GRACE_S`` seconds and as none after that.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.fixed = spark, path.rstrip("/"), buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest state: ``version``, ``count`` (of buckets), ``buckets`` (each one's folders and rows), ``number`` (of its file)."""
        jvm, p, fs = self._fs()
        empty = {"version": 0, "count": 0, "buckets": {}, "number": 0}
        files = sorted((f for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")), key=lambda f: f.getPath().getName()) if fs.exists(p) else []
        for i, f in enumerate(reversed(files)):
            stream = fs.open(f.getPath())
            try:
                m = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                if time.time() - f.getModificationTime() / 1000 < GRACE_S:
                    raise RuntimeError(f"another writer is committing to {self.path}") from None
                continue
            finally:
                stream.close()
            return m | {"number": m["number"] + i}  # the numbers of unfinished files stay taken
        return empty | {"number": len(files)}

    def _commit(self, m: dict) -> int:
        jvm, p, fs = self._fs()
        m = m | {"version": m["version"] + 1, "number": m["number"] + 1}
        final = jvm.org.apache.hadoop.fs.Path(p, f"{m['number']:09d}.json")
        try:
            out = fs.create(final, False)
        except Exception as e:  # noqa: BLE001
            raise RuntimeError(f"another writer committed version {m['version']} of {self.path}") from e
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        return m["version"]

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(count)).cast("int")

    def _read(self, m: dict, only: set[int] | None = None) -> DataFrame:
        """The rows of the buckets, several of a term where a delta lies beside the counts."""
        by: dict[str, list[int]] = {}
        for b, state in m["buckets"].items():
            if only is None or int(b) in only:
                for run in state["runs"]:
                    by.setdefault(run, []).append(int(b))
        out = self.spark.createDataFrame([], COUNTS)
        for run, bs in sorted(by.items()):
            part = self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts/{run}").where(F.col("bucket").isin(bs))
            out = out.unionByName(part.select("term", "occurrences", "records", "bucket"))
        return out

    def _write(self, df: DataFrame, count: int) -> tuple[str, dict[int, int]]:
        """Write rows to a new folder by bucket; its name and the rows of each bucket."""
        run = uuid.uuid4().hex
        parts = df.select("term", "occurrences", "records", self._bucket(count).alias("bucket"))
        parts.repartition(count, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/counts/{run}")
        rows = self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts/{run}").groupBy("bucket").count().collect()  # one per bucket
        return run, {r["bucket"]: r["count"] for r in rows}

    def _merged(self, m: dict, only: set[int] | None = None) -> DataFrame:
        rows = self._read(m, only).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        return rows.where("occurrences != 0 or records != 0")

    def apply(self, changes: DataFrame, fields: list[str]) -> int:
        """Merge signed records (column ``sign`` and the text fields) into the counts; returns the version in force then."""
        m = self.manifest()
        delta = term_delta(changes, fields).where("occurrences != 0 or records != 0")
        if not m["count"]:
            m["count"] = self.fixed
            if self.fixed is None:  # how many buckets is known once the delta is there
                delta = materialize(delta, "terms-first")
                m["count"] = max(1, -(-delta.count() // BUCKET_TERMS))
        run, rows = self._write(delta, m["count"])
        if not rows:
            return m["version"]
        merge = set()
        for b, n in rows.items():
            state = m["buckets"].setdefault(str(b), {"runs": [], "rows": 0, "beside": 0})
            beside = state["beside"] + n if state["runs"] else 0
            m["buckets"][str(b)] = {"runs": [*state["runs"], run], "rows": state["rows"] + n, "beside": beside}
            if len(state["runs"]) >= MERGE_RUNS or beside * MERGE_SHARE > state["rows"]:
                merge.add(b)
        if self.fixed is None and sum(s["rows"] for s in m["buckets"].values()) > 4 * m["count"] * BUCKET_TERMS:
            old, m["count"], merge = m, 4 * m["count"], set()
            run, rows = self._write(self._merged(old), m["count"])
            m["buckets"] = {str(b): {"runs": [run], "rows": n, "beside": 0} for b, n in rows.items()}
        if merge:
            run, rows = self._write(self._merged(m, merge), m["count"])
            m["buckets"] |= {str(b): {"runs": [run] if b in rows else [], "rows": rows.get(b, 0), "beside": 0} for b in merge}
        return self._commit(m)

    def clean(self) -> None:
        """Delete the folders that the newest manifest doesn't name: those of older versions and of failed changes. Not while another writes or reads."""
        jvm, _, fs = self._fs()
        used = {run for state in self.manifest()["buckets"].values() for run in state["runs"]}
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/counts")
        for f in fs.listStatus(p) if fs.exists(p) else []:
            if f.getPath().getName() not in used:
                fs.delete(f.getPath(), True)

    def _counts(self) -> DataFrame:
        m = self.manifest()
        if all(len(state["runs"]) < 2 for state in m["buckets"].values()):
            return self._read(m).select("term", "occurrences", "records")
        return self._merged(m)

    def total_records(self) -> int:
        """Records in the collection."""
        r = self._counts().where(F.col("term") == ALL_RECORDS).select("records").first()
        return int(r[0]) if r else 0

    def terms(self, rare_records: int = 2, common_share: tuple[int, int] = (1, 3)) -> DataFrame:
        """``term``, ``occurrences``, ``records`` and ``mark``.

        ``mark`` is ``common`` for a term in more than the share ``common_share`` (numerator, denominator) of all
        records, else ``rare`` for one in at most ``rare_records`` records, else null. A term that is both, which only
        a collection of a few records can have, is ``rare`` by its count and comes out as ``rare``.
        """
        n = self.total_records()
        num, den = common_share
        mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") * den > n * num, "common")
        return self._counts().where(F.col("term") != ALL_RECORDS).withColumn("mark", mark)
