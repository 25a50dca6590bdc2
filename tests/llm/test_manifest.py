"""Operators 11, 12 and 13."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from skywatch.llm import collocations, merkle, sentence_pieces
from skywatch.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root, and the sides of every leaf's path from below."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i - i % 8:i - i % 8 + 8]
            paths[k].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
            at[k] = i // 8
        level = [h(*level[k:k + 8]) for k in range(0, len(level), 8)]
    return level[0], paths


@pytest.mark.parametrize("chunk_levels", [0, 1, 2])
def test_manifest_matches_a_tree_built_whole(spark, chunk_levels):
    rng = random.Random(chunk_levels)
    sizes = {None: 9, "a": 1, "b": 8, "c": 65, "d": 600, "é": 130} | {f"x{k:02}": 1 + k for k in range(8)}
    rows = [(k, "s" if k % 3 else None, lang, k, None if k % 11 == 0 else f"Text {k}" if k % 2 else f"text {k}")
            for k, lang in enumerate(lang for lang, n in sizes.items() for _ in range(n))]
    rows += [(None, None, "b", None, None), (5, "t", "b", 5, "X"), (5, "t", "b", 5, "X"), (7, "", "d", 0, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int, leaf string")
    got = merkle.manifest(merkle.leaves_of(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0), chunk_levels=chunk_levels).collect()

    def leaf(r):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    subs = {}
    for lang, rs in groups.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[lang] = tree([leaf(r) for r in rs])
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    root, upper = tree([subs[x][0] for x in langs])
    want = Counter()
    for k, lang in enumerate(langs):
        for r, path in zip(groups[lang], subs[lang][1], strict=True):
            sides = path + upper[k]
            low = r[4] if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 else r[4].lower()
            folded = leaf((*r[:4], low))
            for a, b in sides:
                folded = h(a, folded, b)
            want[r[0], leaf(r), subs[lang][0], root, h(*[a + b for a, b in sides]), folded, folded == root] += 1
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == want
    assert any(not r.verified for r in got)


def test_manifest_of_one_leaf_and_of_none(spark):
    docs = spark.createDataFrame([(4, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.manifest(merkle.leaves_of(docs)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == h("1:4----") and r.verified and r.proof_sha256 == h("")
    assert merkle.manifest(merkle.leaves_of(docs.limit(0))).count() == 0


@pytest.fixture(scope="module")
def codec():
    return sentence_pieces.load(public_tokenizers.path(sentence_pieces.MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentence_pieces.MODEL))


def test_codec_equals_the_library(codec, library):
    rng = random.Random(13)
    letters = " ▁\t\nabcdefghijklmnopqrstuvwxyzABC0123,.;:'\"ééß日本語😀\x00　  the in "
    for k in range(4000):
        n = rng.randrange(60)
        text = "".join(rng.choice(letters if k % 3 else "ab the  ") for _ in range(n)) if k % 2 else "".join(rng.choice(codec.pieces[259:]) for _ in range(n // 8))
        ids = codec.encode(text)
        assert ids == library.encode(text)
        assert codec.decode([*ids, 2]) == library.decode([*ids, 2])
        ids = [rng.randrange(32_000 if rng.random() < 0.7 else 262) for _ in range(n // 8)]
        assert codec.decode(ids) == library.decode(ids)


def test_codec_long_stretches(codec, library):
    for text in (" " * 5000, "ab" * 30_000, "日" * 3000, "\x00" * 100, "x" + " " * 77 + "y " * 3000):
        assert codec.encode(text) == library.encode(text)


def test_compatible_is_what_merging_the_pair_gives(codec):
    rng = random.Random(5)
    tokens = list(codec.split)
    follows = {}
    for i in tokens:
        follows.setdefault(codec.pieces[i][0], []).append(i)
    for _ in range(20_000):
        a = rng.choice(tokens)
        b = rng.choice(follows.get(codec.pieces[a][-1], tokens))  # likely to merge across
        assert codec.compatible(a, b) == codec._run(a, b)


def test_pairs_and_steps_that_are_dropped_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "MAX_PAIRS", 50)
    monkeypatch.setattr(sentence_pieces, "MAX_STEPS", 5)
    monkeypatch.setattr(sentence_pieces, "CACHE_WORDS", 3)
    own = sentence_pieces.load(public_tokenizers.path(sentence_pieces.MODEL))
    text = "The quick brown fox; it jumps over the lazy dogs' tails, again and again and again 2024 日本語."
    assert own.encode(text * 3) == library.encode(text * 3)


def test_digests(spark, codec, library):
    texts = [None, "", " ", "Hello  world", "naïve 日本語", "a" * 20_000, "\r\n\t"]
    docs = spark.createDataFrame([(k if k else None, t, 7, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int, pieces string")
    got = sentence_pieces.digests(docs, codec).collect()
    assert len(got) == len(texts) and set(got[0].asDict()) == {"doc_id", "pieces", "n_tokens", "ids_sha256", "decoded_sha256"}
    for r in got:
        text = texts[r.doc_id or 0] or ""
        ids = library.encode(text, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), h(" ".join(map(str, ids))), h(library.decode(ids)))
    assert sentence_pieces.digests(docs.limit(0), codec).count() == 0
    out = sentence_pieces.encoded(docs.select("doc_id", "text"), codec).where("doc_id = 3").first()
    assert list(out.pieces.ids) == library.encode("Hello  world", add_eos=True) and out.pieces.decoded == "Hello  world"


def test_op13_over_the_table(spark, sf_small, library):
    got = {r.doc_id: r for r in QUERIES["op13_sentencepiece"](spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), h(" ".join(map(str, ids))), h(library.decode(ids)))


def by_hand(rows, least, top):
    """Collocations of (lang, text) rows, one phrase after the other."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i:i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (x, q), b in found.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    got, rank = [], Counter()
    for lang, score, a, p, l, r, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, l, r, total, -score))
    return sorted(got)


def some_rows():
    rng = random.Random(3)
    words = ["a", "b", "c", "Die", "déjà", "vu", " ", "x\x00y", "日本"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "  "]) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(rng.choice([None, "und", "en", "en", "en", "fr"]), t) for t in texts] + [("en", None), ("en", ""), (None, "one two"), ("zz", "once")]
    rows += [("en", "red green blue " * 400), ("fr", "w " * 2000)] + [("de", "ab cd ef gh. ab cd")] * 12
    return rows


def test_tries_that_burst_spill_and_start_anew(monkeypatch):
    """The functions of the tasks, here, with limits so small that every one of them is met."""
    for name, value in {"MAX_ENTRIES": 40, "MAX_WORDS": 12, "BURST": 2, "STEP_BYTES": 30, "RUN_ENTRIES": 4}.items():
        monkeypatch.setattr(collocations, name, value)
    rows, least = some_rows(), 8
    batches = [pd.DataFrame([(x or "und", None if t is None else t.encode()) for x, t in rows[k::7]], columns=["lang", "text"]) for k in range(7)]
    want, found = Counter(), []
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            want.update((lang or "und", " ".join(w[i:i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))

    def filtered(phrases):
        data = np.zeros(1 << 5, np.uint8)  # 2^8 bits: chance hits
        for lang, p in phrases:
            at = int(collocations.Filter.slots(np.array([[collocations._word_hash(lang, w)] for w in p.encode().split(b" ")], np.uint64), 8)[0])
            data[at >> 3] |= 1 << (at & 7)
        return collocations.Filter(8, data)

    known, parts = None, None
    for lengths in ((1,), (2,), (3, 4)):
        got, runs = Counter(), 0
        for run in collocations._word_runs(iter(batches)) if lengths == (1,) else collocations._phrase_runs(lengths, known, parts)(iter(batches)):
            runs += 1
            for lang, p, n in run.itertuples(index=False):
                if p is not None:
                    got[lang, bytes(p).decode()] += n
        assert runs > len({x for x, _ in rows})
        frequent = {k: n for k, n in got.items() if n >= least}
        assert frequent == {k: n for k, n in want.items() if n >= least and k[1].count(" ") + 1 in lengths}
        parts = filtered(frequent)
        known = known or parts
        found.append(frequent)
    assert all(found)


def test_collocations_match_counting_by_hand(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(t, x, 1) for x, t in rows], "text string, lang string, f int").repartition(3)
    got = collocations.collocations(collocations.phrase_counts(docs, least=8), top=25)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 8, 25)
    assert {"en", "fr", "de", "und"} <= {r.lang for r in got.collect()}


def test_collocations_exact_beyond_64_bits(spark):
    big = 2**62
    counts = spark.createDataFrame([("en", 0, None, 2**62), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)], "lang string, words int, phrase string, f long")
    r = collocations.collocations(counts).first()
    assert r.score == 2_000_000 * (big - 2) // (2 * big - 1) and r.rank == 1


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(collocations.phrase_counts(docs)).count() == 0
