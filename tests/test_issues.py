"""Issue lifecycle (C3-C5, H3-H5) incl. a property test, and the snapshot store."""

import pytest
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skywatch.operators import issues as iss
from skywatch.sources import store

FIELDS = StructType([StructField("thingName", StringType()), StructField("note", StringType())])
MON = iss.Monitor("uptime-checker", "uptime", FIELDS,
                  text=lambda: F.concat(F.col("thingName"), F.lit(" "), F.coalesce(F.col("note"), F.lit("-"))),
                  pk=lambda: F.col("thingName"))


def current(spark, rows):
    return iss.with_keys(MON, spark.createDataFrame(rows, FIELDS))


def stored(spark, rows):
    return spark.createDataFrame(
        [("uptime-checker", k, json.dumps({"thingName": k, "note": n})) for k, n in rows] + [("other", "x", "{}")],
        "monitor string, pk string, obj string")


def test_states_keep_stored_object_and_duplicates(spark):
    cur = current(spark, [("a", "new"), ("b", "x"), ("b", "y")])
    prev = stored(spark, [("a", "old"), ("c", "gone")])
    got = sorted((r.state, r.pk, r.text) for r in iss.issue_states(MON, cur, prev).collect())
    assert got == [("existing", "a", "a new"), ("fixed", "c", "c gone"), ("raised", "b", "b x"), ("raised", "b", "b y")]
    snap = sorted((r.pk, json.loads(r.obj)["note"]) for r in iss.next_snapshot(MON, cur, prev).collect())
    assert snap == [("a", "old"), ("b", "x")]  # stored object kept; a repeated new key stored once


def test_message_and_notify(spark):
    cur = current(spark, [("a", "n")])
    prev = stored(spark, [("a", "o")])
    states = iss.issue_states(MON, cur, prev)
    lines = [r.line for r in iss.message_lines(MON, states).orderBy("section", "kind", "line").collect()]
    assert lines == ["uptime issues found.", "No newly raised issues.", "previously raised issues:", "a n",
                     "No issues resolved."]
    import datetime as dt
    thursday, monday = dt.date(2024, 1, 18), dt.date(2024, 1, 15)
    counts = iss.state_counts(states)
    assert not iss.should_notify(counts, thursday).first().notify
    assert iss.should_notify(counts, monday).first().notify


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=10), st.lists(st.sampled_from("abcdefgh"), max_size=6, unique=True))
def test_lifecycle_properties(spark, cur_keys, prev_keys):
    cur = current(spark, [(k, "c") for k in cur_keys])
    prev = stored(spark, [(k, "p") for k in prev_keys])
    s = iss.issue_states(MON, cur, prev).collect()
    raised = [r.pk for r in s if r.state == "raised"]
    existing = [r.pk for r in s if r.state == "existing"]
    fixed = {r.pk for r in s if r.state == "fixed"}
    assert sorted(raised + existing) == sorted(cur_keys)
    assert fixed == set(prev_keys) - set(cur_keys)
    snap = {r.pk for r in iss.next_snapshot(MON, cur, prev).collect()}
    assert snap == set(cur_keys)


def test_store_roundtrip(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.read_issues(spark, root, "uptime-checker").count() == 0
    v1 = store.write_snapshot(spark, root, stored(spark, [("a", "1")]))
    assert store.read_issues(spark, root, "uptime-checker").count() == 1
    nxt = iss.next_snapshot(MON, current(spark, [("b", "2")]), store.read_issues(spark, root))
    v2 = store.write_snapshot(spark, root, nxt, monitors=["uptime-checker"])
    assert v1 != v2
    assert sorted(r.pk for r in store.read_issues(spark, root, "uptime-checker").collect()) == ["b"]
    assert store.read_issues(spark, root, "other").count() == 1  # other monitors are untouched


def test_store_interleaved_monitors_and_loud_failures(spark, tmp_path):
    """Two monitors that write around the same time both keep their rows; an unreadable pointer is not an empty store."""
    root = str(tmp_path / "store")
    rows = lambda m, k: spark.createDataFrame([(m, k, "{}")], "monitor string, pk string, obj string")
    a = store.write_snapshot(spark, root, rows("drift", "d1"), ["drift"], commit=False)
    b = store.write_snapshot(spark, root, rows("iam", "i1"), ["iam"], commit=False)
    store.commit_version(spark, root, b, ["iam"])
    store.commit_version(spark, root, a, ["drift"])
    assert sorted(r.pk for r in store.read_issues(spark, root).collect()) == ["d1", "i1"]
    store.write_snapshot(spark, root, rows("drift", "x").limit(0), ["drift"])
    assert [r.pk for r in store.read_issues(spark, root).collect()] == ["i1"]
    assert store.read_issues(spark, str(tmp_path / "none")).count() == 0
    for f in (tmp_path / "store" / "pointers" / "monitor=iam" / "seq=1").glob("pointer"):
        f.write_text("v-gone 32")
    with pytest.raises(Exception, match="is not whole"):
        store.read_issues(spark, root, "iam").collect()


def test_empty_sides(spark):
    empty_cur = current(spark, [])
    prev = stored(spark, [("a", "1")])
    s = sorted((r.state, r.pk) for r in iss.issue_states(MON, empty_cur, prev).collect())
    assert s == [("fixed", "a")]
    assert iss.next_snapshot(MON, empty_cur, prev).count() == 0
    no_prev = spark.createDataFrame([], "monitor string, pk string, obj string")
    s2 = sorted((r.state, r.pk) for r in iss.issue_states(MON, current(spark, [("b", "x")]), no_prev).collect())
    assert s2 == [("raised", "b")]


def test_of_two_runs_one_commits_and_the_other_repeats(spark, tmp_path):
    import pytest
    root = str(tmp_path / "store")
    rows = lambda *ks: spark.createDataFrame([("m", k, "{}") for k in ks], "monitor string, pk string, obj string")
    store.write_snapshot(spark, root, rows("a"), ["m"])
    seq, late = store.next_seq(spark, root, "m"), store.write_snapshot(spark, root, rows("a", "late"), ["m"], commit=False)
    builds = []

    def build(before):
        builds.append(sorted(r.pk for r in before.collect()))
        if len(builds) == 1:  # another run commits meanwhile
            store.commit_version(spark, root, late, ["m"], seq)
        return before.unionByName(rows("mine"))

    assert store.update(spark, root, "m", build) == seq + 1
    assert builds == [["a"], ["a", "late"]]
    assert sorted(r.pk for r in store.read_issues(spark, root, "m").collect()) == ["a", "late", "mine"]
    with pytest.raises(store.CommitConflict):
        store.commit_version(spark, root, late, ["m"], seq)


def test_stored_side_of_the_diff_is_not_shuffled(spark, tmp_path):
    import re
    root = str(tmp_path / "store")
    store.write_snapshot(spark, root, stored(spark, [(f"k{i}", "x") for i in range(100)]), [MON.type])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cur = current(spark, [(f"k{i}", "y") for i in range(50, 150)])
        states = iss.issue_states(MON, cur, store.read_issues(spark, root, MON.type))
        plan = states._jdf.queryExecution().executedPlan().toString()
        assert {r.state: r["count"] for r in states.groupBy("state").count().collect()} == {"raised": 50, "existing": 50, "fixed": 50}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert "SelectedBucketsCount: 32 out of 32" in plan
    # no exchange stands above a scan of the store
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "FileScan parquet" in line:
            depth = re.search(r"[A-Za-z*(]", line).start()
            for above in reversed(lines[:i]):
                at = re.search(r"[A-Za-z*(]", above).start()
                if at < depth:
                    depth = at
                    if "Join" in above:
                        break
                    assert "Exchange" not in above, plan
