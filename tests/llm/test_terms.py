from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from searchloom.llm import relevance, terms
from searchloom.scratch import scratch_path

FIELDS = ["title", "content"]
SCHEMA = "id long, title string, content string, term string, tf int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


ROWS = [
    (1, "Alpha beta", "beta BETA gamma_delta"),
    (2, None, "alpha Ünïcode 42 x2"),
    (3, "", None),
    (4, None, None),
    (None, "alpha", "alpha"),
    (5, "copy", "copy copy"),
    (5, "copy", "copy copy"),
    (6, "long " * 5000, "tail"),
]


def brute(rows):
    occ, rec = Counter(), Counter()
    for _, t, c in rows:
        words = re.findall(r"[^\W_]+", ((t or "") + "\n" + (c or "")).lower())
        occ.update(words)
        rec.update(set(words))
    return {w: (occ[w], rec[w]) for w in occ}


def counts(store):
    return {r["term"]: (r["occurrences"], r["records"]) for r in store.terms().collect()}


def test_counts_equal_brute_force(spark):
    store = terms.TermCounts(spark, scratch_path(spark, "t"), 4)
    store.apply(terms.signed_changes(None, table(spark, ROWS), FIELDS), FIELDS)
    assert counts(store) == brute(ROWS)
    assert store.total_records() == len(ROWS)


def test_deltas_reach_the_same_state_as_a_recount(spark):
    steps = [ROWS[:3], ROWS, ROWS[2:] + [(9, "new", "alpha")], ROWS[2:], []]
    store = terms.TermCounts(spark, scratch_path(spark, "t"), 4)
    old = None
    for s in steps:
        new = table(spark, s) if s else table(spark, ROWS).limit(0)
        store.apply(terms.signed_changes(old, new, FIELDS), FIELDS)
        assert counts(store) == brute(s)
        assert store.total_records() == len(s)
        old = new


def test_only_touched_buckets_are_rewritten(spark):
    store = terms.TermCounts(spark, scratch_path(spark, "t"), 16)
    store.apply(terms.signed_changes(None, table(spark, ROWS), FIELDS), FIELDS)
    before = store.manifest()["buckets"]
    store.apply(table(spark, [(7, "alpha", None)]).withColumn("sign", F.lit(1)), FIELDS)
    after = store.manifest()["buckets"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2  # the term's and the record count's


def test_no_change_keeps_the_version(spark):
    store = terms.TermCounts(spark, scratch_path(spark, "t"), 4)
    t = table(spark, ROWS)
    store.apply(terms.signed_changes(None, t, FIELDS), FIELDS)
    assert store.apply(terms.signed_changes(t, t, FIELDS), FIELDS) == 1


def test_empty_table(spark):
    store = terms.TermCounts(spark, scratch_path(spark, "t"), 4)
    assert store.terms().count() == 0
    store.apply(terms.signed_changes(None, table(spark, ROWS).limit(0), FIELDS), FIELDS)
    assert store.terms().count() == 0 and store.total_records() == 0


def test_marks(spark):
    rows = [(i, "everywhere", f"only{i} pair{i // 2} {'half' if i % 2 else ''}") for i in range(20)]
    store = terms.TermCounts(spark, scratch_path(spark, "t"), 4)
    store.apply(terms.signed_changes(None, table(spark, rows), FIELDS), FIELDS)
    marks = {r["term"]: r["mark"] for r in store.terms().collect()}
    assert marks["everywhere"] == "common" and marks["half"] == "common"
    assert marks["only3"] == "rare" and marks["pair3"] == "rare"


def test_relevance_orders_rare_repeated_terms_first(spark):
    rows = [(i, "the common words", "the note " + ("rareword " * 3 if i in (3, 4) else "other ")) for i in range(30)]
    r = relevance.relevance(table(spark, rows), FIELDS).where("id = 3").orderBy(F.desc("score")).collect()
    assert r[0]["term"] == "rareword" and r[0]["tf"] == 3 and r[0]["df"] == 2
    assert r[-1]["score"] < r[0]["score"] / 5


def test_relevance_handles_nulls_and_repeats(spark):
    r = relevance.relevance(table(spark, ROWS), FIELDS).collect()
    assert {x["id"] for x in r} == {1, 2, None, 5, 6}
    assert sum(x["id"] == 5 for x in r) == 2
    assert relevance.relevance(table(spark, ROWS).limit(0), FIELDS).count() == 0


@pytest.mark.parametrize("share", [1000, 2])
def test_relevance_is_the_same_however_terms_are_split(spark, monkeypatch, share):
    monkeypatch.setattr(relevance, "FREQUENT", share)
    r = relevance.relevance(table(spark, ROWS), FIELDS).collect()
    words = {w: n for w, (_, n) in brute(ROWS).items()}
    assert all(x["df"] == words[x["term"]] for x in r)
    assert len(r) == sum(words.values())


def test_no_change_then_change(spark):
    """A change without effect writes no version and stands in the way of none."""
    store = terms.TermCounts(spark, scratch_path(spark, "t"), 4)
    t = table(spark, ROWS)
    store.apply(terms.signed_changes(None, t, FIELDS), FIELDS)
    for _ in range(2):
        assert store.apply(terms.signed_changes(t, t, FIELDS), FIELDS) == 1
    assert store.apply(table(spark, [(9, "new", None)]).withColumn("sign", F.lit(1)), FIELDS) == 2
    assert counts(store) == brute([*ROWS, (9, "new", None)])


def test_crash_before_the_manifest_and_retry(spark, monkeypatch):
    store = terms.TermCounts(spark, scratch_path(spark, "t"), 4)
    store.apply(terms.signed_changes(None, table(spark, ROWS), FIELDS), FIELDS)
    more = table(spark, [(9, "new", "alpha")]).withColumn("sign", F.lit(1))
    with monkeypatch.context() as m:
        m.setattr(terms.TermCounts, "_commit", lambda self, x: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.apply(more, FIELDS)
    assert counts(store) == brute(ROWS)
    assert store.apply(more, FIELDS) == 2
    store.clean()
    assert counts(store) == brute([*ROWS, (9, "new", "alpha")])


def test_crash_within_the_manifest(spark, monkeypatch):
    path = scratch_path(spark, "t")
    store = terms.TermCounts(spark, path, 4)
    store.apply(terms.signed_changes(None, table(spark, ROWS), FIELDS), FIELDS)
    jvm, p, fs = store._fs()
    out = fs.create(jvm.org.apache.hadoop.fs.Path(p, f"{2:09d}.json"), False)
    out.write(bytearray(b'{"version": 2, "buck'))
    out.close()
    with pytest.raises(RuntimeError):  # it may be a writer at work
        store.manifest()
    monkeypatch.setattr(terms, "GRACE_S", -1)
    assert counts(store) == brute(ROWS)
    assert store.apply(table(spark, [(9, "new", None)]).withColumn("sign", F.lit(1)), FIELDS) == 2
    assert counts(store) == brute([*ROWS, (9, "new", None)])


def test_of_two_writers_one_fails_and_may_try_again(spark, monkeypatch):
    path = scratch_path(spark, "t")
    one, two = (terms.TermCounts(spark, path, 4) for _ in range(2))
    one.apply(terms.signed_changes(None, table(spark, ROWS), FIELDS), FIELDS)
    seen = two.manifest()
    one.apply(table(spark, [(9, "new", None)]).withColumn("sign", F.lit(1)), FIELDS)
    other = table(spark, [(10, "other", None)]).withColumn("sign", F.lit(1))
    with monkeypatch.context() as m:
        m.setattr(terms.TermCounts, "manifest", lambda self: seen)
        with pytest.raises(RuntimeError):
            two.apply(other, FIELDS)
    two.apply(other, FIELDS)
    assert counts(two) == brute([*ROWS, (9, "new", None), (10, "other", None)])


def test_buckets_follow_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(terms, "BUCKET_TERMS", 5)
    store = terms.TermCounts(spark, scratch_path(spark, "t"))
    rows = [(i, f"word{i} other{i}", "all") for i in range(8)]
    store.apply(terms.signed_changes(None, table(spark, rows), FIELDS), FIELDS)
    first = store.manifest()["count"]
    more = [(i, f"word{i} other{i}", "all") for i in range(8, 80)]
    store.apply(terms.signed_changes(None, table(spark, more), FIELDS), FIELDS)
    assert first == 4 and store.manifest()["count"] == 16
    assert counts(store) == brute(rows + more)


def test_small_changes_lie_beside_the_counts_until_they_are_merged(spark):
    store = terms.TermCounts(spark, scratch_path(spark, "t"), 1)
    rows = [(i, f"word{i}", "all") for i in range(200)]
    store.apply(terms.signed_changes(None, table(spark, rows), FIELDS), FIELDS)
    runs = []
    for i in range(4):
        rows.append((1000 + i, f"late{i}", None))
        store.apply(terms.signed_changes(None, table(spark, rows[-1:]), FIELDS), FIELDS)
        runs.append(len(store.manifest()["buckets"]["0"]["runs"]))
    assert runs == [2, 3, 4, 1]
    assert counts(store) == brute(rows)


def test_marks_lead(spark):
    rows = [(i, "the common words", "the note " + ("rareword " * 3 if i in (3, 4) else "other ")) for i in range(30)]
    r = relevance.marks_lead(relevance.relevance(table(spark, rows), FIELDS)).collect()
    assert sorted((x["id"], x["marks"], x["leading"]) for x in r) == [(3, 1, 1), (4, 1, 1)]
