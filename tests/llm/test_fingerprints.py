"""SpotSigs, whitening and spelling variants against their brute-force versions, and the defined results of odd input."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.llm import spelling, spotsigs, whitening
from spendlake.llm.queries import QUERIES
from tests.conftest import SF_DIR
from tests.llm import brute
from tests.llm.test_operators import DOCS, ODD


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


# 11 SpotSigs


def edits(rows):
    """{doc_id: (n_chars, sha256, near_edited, near_next)} of rows in order."""
    out = {}
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, changed, other = (brute.spots(t, spotsigs.ANCHORS) for t in (text, edited, after))
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), brute.likeness(own, changed), brute.likeness(own, other))
    return out


def test_spotsigs_query(spark, documents):
    got = QUERIES["op11_spotsigs"](spark, SF_DIR).collect()
    want = edits(sorted((i, t or "") for i, t in documents))
    assert len(got) == len(documents)
    prints = {}
    text = dict(documents)
    for r in got:
        n, sha, near_edited, near_next = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["near_edited"] == pytest.approx(near_edited) and r["near_next"] == pytest.approx(near_next)
        assert prints.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


@pytest.mark.parametrize("bucket", [2, 7, 1 << 15])
def test_next_document_over_bucket_edges(spark, bucket):
    ids = [-5, 0, 1, 2, 3, 10**12, 10**12 + 1, *range(20, 60, 3)]
    rows = [(i, f"text {i} of the river and the hill") for i in ids]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(df, ("text",), bucket=bucket).collect()}
    rows.sort()
    assert got == {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}


def test_next_document_of_repeated_and_absent_ids(spark):
    rows = [(None, f"n{k}") for k in range(40)] + [(7, f"s{k}") for k in range(40)] + [(8, "same")] * 5 + [(9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = spotsigs.with_next(df, ("doc_id", "text"), bucket=4).collect()
    assert len(got) == len(rows)
    # each row is the next one of one row: a ring
    assert sorted((r["next_doc_id"] is not None, r["next_doc_id"] or 0, r["next_text"] or "") for r in got) == sorted((i is not None, i or 0, t or "") for i, t in rows)
    assert [r["next_doc_id"] for r in got if r["doc_id"] == 9] == [None]


def test_spotsigs_of_odd_rows(spark, odd):
    got = spotsigs.edits(odd).collect()
    assert len(got) == len(ODD)
    assert sorted(r["n_chars"] for r in got) == sorted(len(r[1] or "") for r in ODD)
    empty = [r for r in got if r["n_chars"] == 0]
    assert empty and all(r["signed"] == [] and r["near_edited"] == 1.0 for r in empty)
    assert spotsigs.edits(odd.limit(0)).collect() == []
    one = spotsigs.edits(odd.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    fallback = odd.select(F.size(spotsigs.signatures(F.lit("stone river hill"))), F.size(spotsigs.signatures(F.lit("stone"))), F.size(spotsigs.signatures(F.lit("stone river hill valley")))).first()
    assert tuple(fallback) == (1, 1, 2)


@pytest.mark.parametrize("least", [0.7])
def test_spotsigs_near_duplicates(spark, least):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(30):
        text = [rnd.choice(["the", "of", "and"]) if k % 3 == 0 else rnd.choice(words) for k in range(rnd.randint(20, 160))]
        for copy in range(rnd.randint(1, 5)):
            changed = list(text)
            for _ in range(rnd.choice([0, 0, 1, 3, 8])):
                changed[rnd.randrange(len(changed))] = rnd.choice(words)
            rows.append((base * 10 + copy, " ".join(changed)))
    rows += [(990, None), (991, " "), (992, "single"), (None, "lonely the cat sat on the mat")]
    sets = [brute.spots(t, spotsigs.ANCHORS) for _, t in rows]
    groups = brute.Sets(len(rows))
    near = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or (sets[i] and sets[j] and brute.likeness(sets[i], sets[j]) >= least - 1e-12):
                groups.join(i, j)
                if sets[i] != sets[j]:
                    near[i].add(frozenset(sets[j]))
                    near[j].add(frozenset(sets[i]))
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[groups.find(k)] = min(i, smallest.get(groups.find(k), i))
    want = sorted([(i, smallest.get(groups.find(k)), len(near[k])) for k, (i, _) in enumerate(rows)], key=repr)
    got = spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), least)
    assert sorted([(r["doc_id"], r["group_id"], r["n_near"]) for r in got.collect()], key=repr) == want


def test_length_partitions_hold_near_sizes(spark):
    sizes = spark.range(0, 400).select("id", spotsigs.length_partition(F.col("id")).alias("part")).collect()
    part = {r["id"]: r["part"] for r in sizes}
    assert part[0] == 0
    for a in range(1, 300):
        for b in range(a, 400):
            assert b * 0.8 > a + 1e-9 or part[b] - part[a] in (0, 1)


# 12 whitening


def vectors_of(df):
    return [(r["vec_id"], r["embedding"]) for r in df.collect()]


def check_whitening(got, rows, components=4):
    want, explained = brute.whitened(rows, components)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == len(want) * len(explained)
    signs = None
    for i, n, deviation, coordinates in want:
        own = [by_id[i][k + 1] for k in range(len(explained))]
        assert all(r["n"] == n and int(r["deviation"]) == deviation for r in own)
        white = np.array([r["whitened"] for r in own])
        if signs is None:
            signs = np.sign(white * coordinates)
        assert white == pytest.approx(signs * coordinates, rel=1e-6, abs=1e-6)
        assert [r["explained"] for r in own] == pytest.approx(list(explained), rel=1e-9)
        assert own[0]["identity_error"] < 1e-8


def test_whitening_query(spark):
    rows = vectors_of(spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding"))
    check_whitening(QUERIES["op12_polarisation"](spark, SF_DIR).collect(), rows)


@pytest.mark.parametrize("size", [1.0, 1e9, 1e12])
def test_whitening_of_small_and_large_entries(spark, size):
    rnd = np.random.default_rng(2)
    rows = [(k, (size * (7 + rnd.normal(size=5) * [1, 2, 3, 4, 5])).tolist()) for k in range(60)]
    rows += [(100, rows[0][1]), (101, None), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan] * 5), (104, [1.0, math.inf, 0.0, 0.0, 0.0]), (105, [size])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)).collect()
    assert {r["vec_id"] for r in got} == {*range(60), 100, 105}
    check_whitening(got, rows)


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>, n string, whitened string"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, "x", "y"), (2, [], "x", "y")], schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x", "y"), (1, [1.0, 2.0], "x", "y"), (None, [1.0, 2.0], None, None)], schema)).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in got)
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0], "x", "y") for k in range(4)], schema)).collect()
    assert [r["whitened"] is None for r in sorted(flat, key=lambda r: (r["component"], r["vec_id"]))] == [False] * 4 + [True] * 4


# 13 spelling variants


def table(df):
    return sorted(((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()), key=repr)


def test_spelling_query(spark, documents):
    want = brute.variants(documents)
    assert any(w[3] for w in want)
    assert table(QUERIES["op13_spelling_variants"](spark, SF_DIR)) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [3, 40, 1 << 15])
def test_spelling_in_blocks(spark, block):
    rnd = random.Random(block)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 9))) for _ in range(150)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(100))) for k in range(60)]
    # a chain of forms, each six times as frequent as the one before
    rows += [(1000, " ".join(["xaaaaaaaz"] * 6)), (1001, " ".join(["xaaaaaaz"] * 40)), (1002, " ".join(["xaaaaaz"] * 250)), (1003, "xaaaaaz-" * 3)]
    got = table(spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), block=block))
    assert got == sorted(brute.variants(rows), key=repr)
    assert {w: root for w, *_, root in got}["xaaaaaaaz"] == "xaaaaaz"


def test_spelling_of_odd_rows(spark, odd):
    rows = [(r[0], r[1]) for r in ODD]
    assert table(spelling.variants(odd)) == sorted(brute.variants(rows), key=repr)
    assert table(spelling.variants(odd.limit(0))) == []
    assert table(spelling.variants(odd.where("text IS NULL"))) == []


def test_runs_are_not_cut_between_pieces():
    raw = ("Abcdefgh ÄÖÜ× ijklmnop " * 50).lower().encode()
    assert [w for p in spelling.pieces(raw, 7) for w in spelling.RUN.findall(p)] == spelling.RUN.findall(raw)
    assert [x.decode() for x in spelling.RUN.findall("straße naïve €uro ÷x".encode())] == re.findall("[a-zÀ-ÿ]+", "straße naïve €uro ÷x")


def test_suffixes_are_sorted():
    rnd = random.Random(1)
    for n in (1, 2, 3, 50, 400):
        text = [rnd.randint(1, 3) for _ in range(n)] + [0]
        assert spelling.suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda k: text[k:])
