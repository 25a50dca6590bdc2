"""Operators 6 and 7, oracles, and the pipeline."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from skywatch.llm import chat, decontaminate, jaccard, language, mixing, suffixes
from skywatch.llm.queries import ORACLE, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_oracle(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    df = QUERIES[name](spark, sf_small)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_targets_stop_at_twice_the_size_and_share_the_rest(spark):
    df = spark.createDataFrame([("b", 10), ("a", 100), (None, 50), ("c", 0), ("d", 300)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(df, "source", "size").collect()}
    # a 3, b 1, c 2, d 3, null 1: 690 words; b stops at 20 and a at 200 after the sharing
    left, caps, w = 690.0, {"a": 200.0, "b": 20.0, "c": 0.0, "d": 600.0, None: 100.0}, {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    fixed = {}
    while True:
        level = (left - sum(fixed.values())) / sum(w[k] for k in caps if k not in fixed)
        over = [k for k in caps if k not in fixed and level * w[k] > caps[k]]
        if not over:
            break
        fixed |= {k: caps[k] for k in over}
    want = {k: fixed.get(k, level * w[k]) for k in caps}
    assert {k: round(v[1], 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_mix_edge_cases(spark):
    rows = [(i, "w " * (i % 9), "hot") for i in range(900)] + [(1, None, None), (2, "", None), (3, "a b", None), (3, "a b", None), (None, "x y z", "s"), (7, " ", "blank")]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, source string, size int, rate string")
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "source", "rate", "size", "source_size", "target", "copies", "taken"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    by = Counter()
    for r in got:
        by[r.source] += r.taken
    assert all(abs(by[r.source] - r.target) <= 8 * 2 for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(3)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


MESSAGES = "conv_id long, turn long, kind string, call_id string, tool string, after string, payload string, level string"


def linked(spark, rows):
    return {(r.conv_id, r.call_id, r.turn): r for r in chat.link_tool_calls(spark.createDataFrame([(*r, "x") for r in rows], MESSAGES)).collect()}


def test_tool_calls(spark):
    good = '{"query":"q","limit":3}'
    rows = [(1, 2, "call", "a", "lookup", None, '{ "query":"é\\n", "limit": 3 }'), (1, 3, "result", "a", None, None, "ok"),
            (1, 1, "call", "b", "lookup", "a", good), (1, 4, "call", "c", "lookup", "b", '{"limit":"3","more":1}'), (1, 5, "result", "c", None, None, None),
            (1, 6, "call", "x", "lookup", "y", good), (1, 7, "call", "y", "lookup", "x", good), (1, 8, "call", "z", "lookup", "y", good),
            (1, 9, "result", "nobody", None, None, "r"), (1, 10, "call", None, "lookup", None, good), (1, 11, "note", "n", None, None, "t"),
            (2, 1, "call", "a", "nothing", None, good), (2, 2, "call", "d", "lookup", None, "[1]"), (2, 3, "call", "e", "lookup", None, None), (2, 4, "call", "f", "lookup", "missing", "{"),
            (None, 1, "call", "a", "lookup", None, good), (None, 2, "result", "a", None, None, "r"), (3, 5, "call", "a", "lookup", None, good), (3, 4, "call", "a", "lookup", None, good)]
    got = linked(spark, rows)
    assert got[1, "a", 2].status == "ok" and got[1, "a", 2].line == '{"arguments":{"limit":3,"query":"é\\n"},"id":"a","name":"lookup","result":"ok"}'
    assert [got[1, k, t].level for k, t in (("a", 2), ("b", 1), ("c", 4))] == [0, 1, 2]
    assert got[1, "b", 1].status == "dangling" and got[1, "c", 4].status == "invalid"
    assert got[1, "c", 4].errors == ["limit: not integer", "query: missing", "more: unknown field"]
    assert [(got[1, k, t].status, got[1, k, t].level) for k, t in (("x", 6), ("y", 7), ("z", 8))] == [("cycle", None)] * 3
    assert got[1, "nobody", None].status == "orphan" and got[1, None, 10].status == "unlinked" and got[1, "n", 11].status == "unlinked"
    assert got[2, "a", 1].errors == ["unknown tool"] and got[2, "d", 2].errors == got[2, "e", 3].errors == got[2, "f", 4].errors == ["not a JSON object"]
    assert got[2, "f", 4].level == 0 and got[None, "a", 1].status == "ok"
    assert got[3, "a", 4].copies == 1 and (3, "a", 5) not in got


def test_long_chain_and_empty(spark):
    rows = [(1, k, "call", f"c{k}", "lookup", f"c{k - 1}", '{"query":"q","limit":1}') for k in range(300)]
    got = linked(spark, rows)
    assert all(r.level == int(k[1][1:]) for k, r in got.items())
    assert linked(spark, []) == {}


def test_pipeline_stages(spark, sf_small):
    """Each stage does what its operator decides, and all but the last return the columns of documents."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    extra = spark.createDataFrame([(100_001, None, "en", "s", 0), (100_002, "123 456", "en", "s", 7), (None, docs.first().text, "en", None, 1)], docs.schema)
    docs = docs.unionByName(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_small)
        if name != "mix":
            assert out.columns == seen.get("columns", out.columns) == docs.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows, before = out.collect(), docs.collect()
        if name == "language":
            assert {r.doc_id for r in before} - {r.doc_id for r in rows} == {100_001, 100_002}
        elif name == "near_duplicates":
            gone = {r.id for r in jaccard.near_duplicates(docs).where("not kept").collect()}
            assert gone and sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before if r.doc_id not in gone)
        elif name == "repeated_passages":
            kept = {r.id: (r.n_removed, bytes(r.kept)) for r in suffixes.without_repeats(docs).collect()}
            assert any(n for n, _ in kept.values())
            assert all(r.text == kept[r.doc_id][1].decode("utf-8", "ignore") for r in rows)
            assert {r.doc_id for r in before} - {r.doc_id for r in rows} == {i for i, (n, b) in kept.items() if n and not b.decode("utf-8", "ignore").strip(" \t\n\v\f\r")}
        elif name == "decontaminate":
            bad = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{sf_small}/benchmark.parquet")).collect()}
            assert bad and {r.doc_id for r in rows} == {r.doc_id for r in before} - bad
        else:
            want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
            assert Counter(r.doc_id for r in rows) == Counter(want)
        docs = spark.createDataFrame(rows, out.schema)


def test_language_stage_finds_wrong_labels(spark):
    """Rows not learned from, every second of them with a wrong label: nearly all of these go, the others stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    unseen = F.coalesce(language.bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    wrong = unseen & (F.col("doc_id") % 2 == 0) & F.col("lang").isNotNull()
    planted = docs.withColumn("lang", F.when(wrong, F.when(F.col("lang") == "en", "fr").otherwise("en")).otherwise(F.col("lang")))
    left = {r.doc_id for r in corpus_pipeline.language_stage(spark, planted, "").select("doc_id").collect()}
    bad = {r.doc_id for r in docs.where(wrong).collect()}
    good = {r.doc_id for r in docs.where(unseen & ~wrong).collect()}
    assert len(bad) > 100 and len(bad - left) >= 0.9 * len(bad) and len(good & left) >= 0.99 * len(good)


def test_near_duplicate_stage_decides_by_row(spark):
    """Null ids and repeated ids are many documents, each judged by its own text."""
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefgh"]
    a, b, c, d, e, f, g, h = words
    rows = [(1, a), (None, a + " x"), (None, b), (None, c),  # one null id copies 1, the others are clean
            (2, d), (3, d + " x"), (3, e),  # id 3: a copy of 2, and another text
            (4, f), (4, f), (4, f + " x"),  # an id's own copies
            (None, g), (None, g), (None, g + " x"),  # copies without any id
            (6, h), (5, h + " x"), (None, None), (None, None), (None, " "), (8, ""), (8, "")]
    docs = spark.createDataFrame([(*r, "en", "s", k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, (r.text or "").removesuffix(" x")) for r in out.collect())
    assert got == Counter([(1, a), (None, b), (None, c), (2, d), (3, e), (4, f), (None, g), (5, h), (None, ""), (None, ""), (None, " "), (8, ""), (8, "")])
    again = corpus_pipeline.near_duplicate_stage(spark, docs.repartition(5), "")
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out.collect()))


def test_pipeline_runs_and_is_stable(spark, sf_small):
    a = Counter(map(tuple, corpus_pipeline.run(spark, sf_small).collect()))
    assert a and a == Counter(map(tuple, corpus_pipeline.run(spark, sf_small).collect()))


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count(F.lit(1))).first()[0] == 0
