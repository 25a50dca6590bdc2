"""Operators 1, 2, 8 and 9 against brute force, with nulls, empties, repeats and ties."""

import hashlib
import os
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skywatch.llm import decontaminate, embeddings, jaccard, suffixes
from skywatch.llm.packs import Pack, pack
from skywatch.session import checkpoint_dir, default_parallelism

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
LAST = 2**63 - 1


def prose(seed: int, n: int) -> list[str]:
    r = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(2, 8)))) for _ in range(n)]


def texts() -> list[tuple]:
    a, b = prose(1, 60), prose(2, 200)
    rows = [(5, " ".join(a)), (3, " ".join(a)), (3, " ".join(a)), (9, " ".join([*a[:-1], "changed"])), (1, " ".join(b)), (2, " ".join([*b[:150], *prose(3, 50)])),
            (7, " ".join(b[20:120])), (8, None), (10, ""), (11, " \n\t "), (None, " ".join(a).upper()), (12, "one two"), (13, "One  two"), (14, "x" * 120), (15, "x" * 60),
            (16, "é" * 40 + " ".join(a[:20])), (17, " ".join(prose(4, 3000))), (18, " ".join(prose(4, 3000)) + " end"), (None, None), (19, "one two")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cls string, part int")


def shingles(t, k=5):
    w = WORD.findall(LOW(t))
    return {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def brute_links(rows, linked):
    n = len(rows)
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    key = lambda i: LAST if rows[i][0] is None else rows[i][0]
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), LAST), key(i))
    out = []
    for i in range(n):
        c = least[root(i)]
        out.append((rows[i][0], None if c == LAST else c, links[i], key(i) == c))
    return out


def test_jaccard_against_brute_force(spark):
    rows = texts()
    sets = [shingles(t) for _, t in rows]
    want = brute_links(rows, lambda i, j: bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = [(r.id, r.class_id, r.n_links, r.kept) for r in jaccard.near_duplicates(frame(spark, rows)).collect()]
    assert Counter(got) == Counter(want)


def test_jaccard_tiles_and_hot_groups(spark, monkeypatch):
    """A large group of near copies cut into many small tiles, and many exact copies."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    base = prose(7, 120)
    rows = [(i, " ".join([*base[:110], *prose(100 + i, 3), *base[113:]])) for i in range(60)] + [(100 + i, " ".join(base)) for i in range(80)]
    sets = [shingles(t) for _, t in rows]
    want = brute_links(rows, lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = [(r.id, r.class_id, r.n_links, r.kept) for r in jaccard.near_duplicates(frame(spark, rows)).collect()]
    assert Counter(got) == Counter(want)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert jaccard.near_duplicates(none).count() == 0
    assert suffixes.without_repeats(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.clean(frame(spark, [(1, "a b c d e f")]), items).count() == 1
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def brute_suffixes(rows, length=50):
    key = lambda i: LAST if i is None else i
    first = {}
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p:p + length], key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < key(i):
                gone[p:p + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("pack_bytes", [300, 1 << 20])
def test_suffixes_against_brute_force(spark, pack_bytes):
    """Small packs make most repeats cross packs; one pack makes all of them local."""
    rows = texts() + [(20, "ab" * 200), (21, "ba" * 100), (22, "q" * 49), (23, "q" * 49), (24, "q" * 50), (25, "q" * 51)]
    got = suffixes.without_repeats(frame(spark, rows), pack_bytes=pack_bytes, keep=["cls", "part"])
    cols = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(brute_suffixes(rows))
    assert {r.rest for r in got.select("rest").collect()} == {'{"cls":"x","part":1}'}


def test_suffixes_of_one_id_in_two_packs(spark):
    """An id's texts in two packs share an anchor; the repeat of one stands beside the other."""
    for seed in (50, 60, 70):
        x, filler = " ".join(prose(seed, 60))[:50], " ".join(prose(seed + 1, 60))[:60]
        rows = [(3, x), (100, filler), (3, x[:-1] + "!"), (9, x)]
        got = suffixes.without_repeats(frame(spark, rows).coalesce(1), pack_bytes=150)
        cols = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(brute_suffixes(rows))


def test_entries_of_a_range_compared_in_slices():
    """A range's entries cost their width and a slice of work arrays, and come out as those of one slice do."""
    r = np.random.default_rng(9)
    n = 100_000
    parts = [suffixes._entries(r.integers(0, 60_000 * 8, n).astype(np.uint64), r.integers(1, 4, n).astype(np.uint64), r.integers(0, 500, n)) for _ in range(8)]
    got = suffixes._compare(iter(parts))  # what is loaded once is not counted
    tracemalloc.start()
    assert suffixes._compare(iter(parts)) == got
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * 8 * n
    keys, seconds, ids = (np.concatenate(x) for x in zip(*[suffixes._read(v) for v in parts], strict=True))
    wide = np.zeros((len(keys), 8), np.uint8)
    wide[:, :6] = seconds
    whole = suffixes._judge(keys, wide.view("<u8")[:, 0], ids)
    assert whole.any(0).all() and got == [np.packbits(whole[a:a + n].ravel()).tobytes() for a in range(0, 8 * n, n)]


def test_suffixes_of_cut_characters(spark):
    """Characters of which bytes are removed go whole where asked for; the digest is of all remaining bytes."""
    a, b = "x" * 49 + "é", "x" * 49 + "è" + "end"  # 50 bytes are alike, the last of them half a character
    plain = {r.id: r for r in suffixes.without_repeats(frame(spark, [(1, a), (2, b)])).collect()}
    whole = {r.id: r for r in suffixes.without_repeats(frame(spark, [(1, a), (2, b)]), whole_characters=True).collect()}
    assert bytes(plain[2].kept) == b.encode()[50:] and bytes(whole[2].kept) == b"end" and bytes(whole[1].kept) == a.encode()
    assert plain[2].kept_sha256 == whole[2].kept_sha256 == hashlib.sha256(b.encode()[50:]).hexdigest()


def test_packs_gathered_in_a_file_a_bucket(spark):
    docs = frame(spark, [(i, " ".join(prose(i, 20))) for i in range(200)]).repartition(16)
    n = default_parallelism(spark)
    packs = pack(docs, "doc_id", "text", 200, gather=True)
    assert packs.count() > 16 and len(packs.inputFiles()) <= n
    assert Counter(i for r in packs.collect() for i in Pack(bytes(r.body)).ids.tolist()) == Counter(range(200))


def test_repeats_stage_runs_one_worker_a_task(spark):
    """What follows the operator's last step stays in the JVM: a second Python step would hold two workers a task."""
    docs = spark.createDataFrame([(1, "a " * 60, "en", "s", 120), (2, "a " * 60 + "b", "en", "s", 121)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.repeats_stage(spark, docs, "")
    assert "EvalPython" not in out._jdf.queryExecution().toString()
    assert [tuple(r) for r in out.collect()] == [(1, "a " * 60, "en", "s", 120), (2, "b", "en", "s", 1)]


def test_suffixes_query_on_table(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, suffixes.op9_suffixes(spark, sf_small).collect())) == Counter(brute_suffixes(rows))


def test_jaccard_query_on_table(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    sets = [shingles(t) for _, t in rows]
    want = brute_links(rows, lambda i, j: bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert Counter((r.doc_id, r.class_id, r.n_links, r.kept) for r in jaccard.op2_jaccard(spark, sf_small).collect()) == Counter(want)


def brute_vectors(rows, cosine=0.98):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.sqrt(v @ v)

    units = [unit(r[1]) for r in rows]
    ok = lambda i, j: (units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2]
                       and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= cosine)
    return [(i, n, c, k) for i, c, n, k in brute_links([(r[0],) for r in rows], ok)]


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    r = np.random.default_rng(3)
    base = r.normal(size=(6, 16))
    rows = []
    for k in range(150):
        v = base[k % 6] + r.normal(size=16) * (0.02 if k % 3 else 0.3)
        rows.append((k, [float(np.float32(x)) for x in v], k % 2))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [1.0, None] + [0.0] * 14, 1), (203, [float("nan")] * 16, 1), (204, [float("inf")] + [1.0] * 15, 0), (205, rows[0][1], None),
             (206, rows[0][1], 0), (206, rows[0][1], 0), (None, rows[0][1], 0), (207, [1.0, 2.0], 0), (208, [2.0, 4.0], 0), (209, [], 0), (210, [3.0], 1), (211, [5.0], 1), (212, [-5.0], 1)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "vec_id long, embedding array<float>, label int, cell string")
    got = [tuple(r) for r in embeddings.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert Counter(got) == Counter(brute_vectors(rows))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_large_components_in_tiles(spark, monkeypatch, kind):
    monkeypatch.setattr(embeddings, "TILE", 64)  # a label's codes in several tiles, vectors of a component in tiles of 8
    monkeypatch.setattr(embeddings, "SMALL", 4)
    monkeypatch.setattr(embeddings, "ROWS", 16)
    r = np.random.default_rng(5)
    base, rows = r.normal(size=(3, 24)), []
    for k in range(330):  # a dense group whose cosines lie about the limit, a loose one, and vectors alone
        v = base[0] + r.normal(size=24) * 0.14 if k < 120 else base[1] + r.normal(size=24) * 0.2 if k < 180 else r.normal(size=24) * 10.0 ** r.integers(-3, 4)
        rows.append((k, [float(np.float32(x)) for x in v], "a" if k < 300 else "b"))
    rows += [(1000 + k, list(rows[7 * k][1]), "a") for k in range(10)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string")
    got = [tuple(x) for x in embeddings.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert Counter(got) == Counter(brute_vectors(rows))
    assert max(x[1] for x in got) > 20


def written(spark):
    """Bytes of shuffle files and of intermediate tables."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    tables = (os.path.join(d, f) for d, _, names in os.walk(checkpoint_dir(spark).removeprefix("file:")) for f in names)
    return sum(files.apply(k).length() for k in range(files.size())) + sum(map(os.path.getsize, tables))


def test_embeddings_write_a_vector_few_times(spark):
    n, dims = 6000, 64
    r = np.random.default_rng(6)
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(r.normal(size=(n, dims)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(2).localCheckpoint()
    before = written(spark)
    assert embeddings.near_duplicates(df).where("n_links = 0 and kept").count() == n
    assert written(spark) - before < 6 * n * dims * 4


def leaked(rows, items):
    """Brute force over all item-sized windows of documents that hold a shingle of the item."""
    out = set()
    for i, t in rows:
        w = (t or "").lower().encode().split()
        for item, it in items:
            v = (it or "").lower().encode().split()
            k = min(5, len(v))
            if not v or len(w) < k:
                continue
            bag = lambda x: Counter(tuple(x[j:j + k]) for j in range(len(x) - k + 1))  # noqa: E731, B023
            b, size = bag(v), min(len(v), len(w))
            for s in range(len(w) - size + 1):
                a = bag(w[s:s + size])
                if a & b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    out.add((i, item))
    return out


def test_leaks_against_brute_force(spark):
    a, b, c = prose(11, 40), prose(12, 18), prose(13, 300)
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, "yes no"), (4, None), (5, ""), (None, "what is this then really"), (6, " ".join(prose(14, 10)))]
    rows = [(1, " ".join([*c[:50], *a, *c[50:]])), (2, " ".join([*c[:5], *b[1:], *c[9:30]])), (3, " ".join(c)), (4, None), (5, ""), (6, " ".join(a[:20])), (7, " ".join(a[:37])),
            (8, "well yes  NO then"), (9, "yes, no"), (10, " ".join([*c[:50], *a[:39], "other", *c[50:]])), (None, " ".join(b).upper()), (11, "so what is this then really now"),
            (1, " ".join([*c[:50], *a, *c[50:]])), (3, "x " + " ".join(b)), (12, " ".join(a + c + a + b))]
    docs = frame(spark, rows)
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == leaked(rows, items)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    texts_kept = Counter((r.doc_id, r.text) for r in kept.collect())
    assert texts_kept == Counter(r for r in rows if not leaked([r], items))


def test_simhash_blocks_find_all_within_radius(spark):
    """Multi-index blocks: any two fingerprints within the radius agree on a block."""
    r = np.random.default_rng(5)
    base = int(r.integers(-2**62, 2**62))
    rows = [(k, base ^ sum(1 << int(b) for b in r.choice(63, size=k, replace=False))) for k in range(decontaminate.RADIUS + 1)]
    df = spark.createDataFrame(rows, "k int, f long").select("k", decontaminate._blocks(decontaminate.RADIUS).alias("b")).select("k", "b.*")
    own = df.where("k = 0").select(F.col("block").alias("b0"), F.col("bits").alias("v0"))
    hit = df.join(own, (F.col("block") == F.col("b0")) & (F.col("bits") == F.col("v0"))).select("k").distinct()
    assert hit.count() == len(rows)


def test_jaccard_rows_that_share_an_id_or_have_none(spark):
    """1000 rows without an id and 1000 of one id, in pairs of near copies: each text stands for one set at most."""
    def text(k):
        return " ".join(f"w{k // 2}x{j}" for j in range(60)) + (" end" if k % 2 else "")

    rows = [(None if k < 1000 else 7, text(k)) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == 2000 and all(r.n_links == 1 for r in got)
    texts = jaccard._texts(docs, "doc_id", "text")
    wanted = texts.select(F.monotonically_increasing_id().alias("cls"), F.col("id").alias("set_id"), F.col("hash").alias("set_hash"), F.lit(0).alias("k1"), F.lit(0).alias("k2"))
    assert jaccard._of_sets(texts, wanted).count() == 2000
