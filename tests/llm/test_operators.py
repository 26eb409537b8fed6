"""Each operator against its brute-force version or oracle, and the defined results of odd input."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from spendlake.llm import decontaminate, embeddings, language, mixing, ring, scan, shared, simhash, suffix_tree, token_counts, token_files, warc
from spendlake.llm.queries import ORACLES, QUERIES, public_tokenizer
from tests.conftest import SF_DIR
from tests.llm import brute
from tests.oracle import connect

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard string, slot string, hits string, copy string, fp string"
LONG = "the river ran over the old stones and then into a wide green valley of trees and birds " * 3000
WINDOW = "one two three four five six seven eight nine ten"

#: Nulls in any column, empty and very long texts, repeated rows and ids, columns named as results.
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", "a", 5, 0.5, "x", "y", "z", "c", "f"),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", "a", 5, 0.5, "x", "y", "z", "c", "f"),
    (2, None, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, 0.1, "x", "y", "z", "c", "f"),
    (None, "text without an id, " + WINDOW, "en", "b", 1, 0.1, "x", "y", "z", "c", "f"),
    (None, None, "en", "b", 1, 0.1, "x", "y", "z", "c", "f"),
    (4, LONG, "en", "b", 1, 0.1, "x", "y", "z", "c", "f"),
    (5, LONG + "end", None, "b", 1, 0.1, "x", "y", "z", "c", "f"),
    (5, "  \t\n ", "en", "b", 1, 0.1, "x", "y", "z", "c", "f"),
    (6, "ÄÖÜ straße – “quoted”  two spaces 你好 \U0001f600 <|endoftext|> it's 3,141", "de", "b", 1, 0.1, "x", "y", "z", "c", "f"),
    (7, "!!! ... 123", "en", None, 1, 0.1, "x", "y", "z", "c", "f"),
    (8, "Short item " + WINDOW.upper() + " " + WINDOW, "en", "a", 1, 0.1, "x", "y", "z", "c", "f"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    names = sorted(df.columns)
    rel = connect(SF_DIR).sql(ORACLES[name])
    want = [tuple(r[rel.columns.index(n)] for n in names) for r in rel.fetchall()]
    same([tuple(r) for r in df.select(*names).collect()], want)


# 1 token files


def test_token_query(spark, documents):
    got = QUERIES["op1_token_files"](spark, SF_DIR)
    same(map(tuple, got.collect()), brute.token_rows(pairs(documents), public_tokenizer()))


def test_token_files_of_odd_rows(spark, odd, none):
    path = shared.scratch(spark, "test")
    token_files.write(odd, path, public_tokenizer())
    got = token_files.read(spark, path, with_ids=True).orderBy("start").collect()
    want = brute.token_rows(pairs(odd), public_tokenizer())
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], [(w[0], w[2], w[3]) for w in want])
    assert [r["start"] for r in got] == np.cumsum([0, *(len(r["ids"]) for r in got)])[:-1].tolist()
    path = shared.scratch(spark, "test")
    assert token_files.write(none, path, public_tokenizer()).count() == 0
    assert token_files.read(spark, path).count() == 0


@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\t 'é–x1.,s 你᠎"), max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_pieces_encode_as_the_library_does(texts):
    code = token_files.encoder(public_tokenizer())
    ids, before = code.encode(*scan.buffers(pa.array(texts, pa.string())))
    for text, a, b in zip(texts, before, before[1:]):
        assert ids[a:b].tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.integers(1, 32), st.lists(st.integers(0, (1 << 32) - 1), max_size=300))
@settings(deadline=None)
def test_bits_round_trip(bits, ids):
    ids = np.array(ids, np.uint32) & np.uint32((1 << bits) - 1)
    assert (token_files.unpack(token_files.pack(ids, bits), bits, len(ids)) == ids).all()


@pytest.mark.parametrize("bits", [5, 15, 16, 17])
def test_random_access(tmp_path, bits):
    ids = np.random.Generator(np.random.PCG64(bits)).integers(0, 1 << bits, 3 * token_files.BLOCK + 77).astype(np.uint32)
    with pa.OSFile(str(tmp_path / "x"), "wb") as sink:
        writer = token_files.Writer(sink, bits)
        writer.add([3, None], ids, np.array([100, len(ids) - 100]))
        writer.close()
    file = token_files.Reader(pa.OSFile(str(tmp_path / "x"), "rb"))
    assert (file.docs.tolist(), file.null.tolist(), file.starts.tolist()) == ([3, 0], [False, True], [0, 100, len(ids)])
    for a, b in [(0, 0), (0, 1), (8191, 8193), (5, len(ids)), (2 * 8192, 3 * 8192), (len(ids) - 1, len(ids))]:
        assert (file.ids(a, b) == ids[a:b]).all()


# 2 token counts


def test_token_count_query(spark, documents):
    got = QUERIES["op2_separator_scan"](spark, SF_DIR).orderBy("start").collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(w[2] for w in brute.token_rows(pairs(documents), public_tokenizer()))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist() and all(r["ended"] for r in got)


@pytest.mark.parametrize("block", [1, 7, 100000])
def test_counts_across_blocks(spark, odd, none, block):
    path = shared.scratch(spark, "test")
    end = token_counts.write_flat(odd.where("length(coalesce(text, '')) < 500").repartition(3), path, public_tokenizer())
    got = token_counts.count_tokens(spark, path, end, block).orderBy("start").collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(w[2] for w in brute.token_rows([p for p in pairs(odd) if len(p[1] or "") < 500], public_tokenizer()))
    rest = token_counts.count_tokens(spark, path, end + 1, block).collect()
    assert [(r["start"], r["n_tokens"], r["ended"]) for r in rest] == [(0, sum(r["n_tokens"] for r in got), False)]
    path = shared.scratch(spark, "test")
    assert token_counts.count_tokens(spark, path, token_counts.write_flat(none, path, public_tokenizer())).count() == 0


# 3 mixing


def test_copies_of_odd_rows(odd, none):
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mix(odd).collect())
    assert got == brute.copies([(r[0], r[1], r[3]) for r in ODD])
    assert mixing.mix(none).count() == 0


def test_mixing_meets_weights(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "repeat('x', 9) AS text", "if(id < 15000, 'hot', if(id < 19900, 'mid', 'small')) AS source")
    weights = spark.createDataFrame([("hot", 1.0), ("mid", 2.0), ("small", 1.0), ("absent", 9.0)], "source string, weight double")
    mixed = mixing.mix(docs, weights)
    got = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    for source, share in (("hot", 0.25), ("mid", 0.5), ("small", 0.25)):
        assert math.isclose(got[source], share * 20000, rel_tol=0.1)
    keys = [r[0] for r in mixed.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    assert "hot" not in {r["source"] for r in mixing.mix(docs, weights.where("source <> 'hot'")).select("source").distinct().collect()}


# 4 embeddings


def test_embedding_query(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    same(map(tuple, QUERIES["op4_metric_range_join"](spark, SF_DIR).collect()), brute.near_vectors([(r["vec_id"], r["embedding"]) for r in vectors.collect()]))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_chunks_and_odd_vectors(spark, monkeypatch, kind):
    random = np.random.Generator(np.random.PCG64(4))
    centres = random.normal(size=(4, 8))
    points = np.concatenate([c + s * random.normal(size=(40, 8)) for c, s in zip(centres, (0.02, 0.1, 0.3, 0.6))] + [random.normal(size=(60, 8))])
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0], [1.0, 2.0] + [0.0] * 6, [2.0, 4.0]]
    vectors = [np.float32(p).astype(float).tolist() for p in points] + odd
    table = list(enumerate(vectors)) + [(5, vectors[0]), (None, vectors[1]), (None, None), (None, [-9.0] * 8)] + [(1000 + k, vectors[3]) for k in range(50)]
    for name, value in (("HOME", 16), ("ROWS", 7), ("SAMPLE", 100)):
        monkeypatch.setattr(embeddings, name, value)
    got = embeddings.near_duplicates(spark.createDataFrame(table, f"vec_id bigint, embedding array<{kind}>").repartition(3))
    want = [(i, n, None if i is None and n == 0 else c, i == c) for i, n, c, _ in brute.near_vectors(table)]
    same(map(tuple, got.collect()), want)


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


# 5 language


def test_language_accuracy(spark, documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    got = QUERIES["op5_language_masks"](spark, SF_DIR).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (brute.crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_of_odd_rows(documents, odd, none):
    model = language.train(documents)
    found = language.identify(odd, model)
    assert set(found.columns) == {*odd.columns, "lang_pred"}
    for r in found.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or r["score"] == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.train(none)).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


def test_filters_claim_all_members():
    members = [np.arange(k, 40000, 7, dtype=np.uint32) * np.uint32(2654435761) for k in range(10)]
    model = language.Model.build([f"l{k}" for k in range(10)], members)
    for k, own in enumerate(members):
        masks = np.bitwise_and.reduce([model.table[language._slot(own, h)] for h in language.HASHES])
        assert (masks[:, k // 8] >> k % 8 & 1).all()
        assert model.false[k] < 0.01


# 6 suffix tree


@pytest.mark.parametrize("frequent", [suffix_tree.FREQUENT, 1.0])
def test_unigram_part(spark, documents, odd, monkeypatch, frequent):
    monkeypatch.setattr(suffix_tree, "FREQUENT", frequent)
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    held = docs.selectExpr("doc_id", "text", "crc32(coalesce(string(doc_id), '')) % 10 = 0 AS held_out", "'kept' AS n_tokens", "1 AS extra")
    model, rare = suffix_tree.train(held.where("NOT held_out"))
    got = suffix_tree.score(held, model, rare)
    assert "extra" in got.columns
    key = lambda r: (repr(r[0]), r[1], r[2], r[3], round(r[5], 3))
    got = sorted((tuple(r) for r in got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=key)
    want = sorted(brute.unigram(pairs(docs)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and g[6] < 0 for g, w in zip(got, want))


def test_tree_is_a_distribution(documents):
    model, _ = suffix_tree.train(documents)
    tree = model.tree
    assert all(len(level.states) for level in tree.levels[:4])
    for context in ("", "th", " the", "zzzzzz", "e o", "\n\n\n"):
        before = int.from_bytes((b"\n" * suffix_tree.DEPTH + context.encode())[-suffix_tree.DEPTH :][::-1], "big")
        assert math.isclose((10 ** tree.score(np.arange(256) + (before << 8))).sum(), 1, rel_tol=1e-9)


def test_tree_beats_unigrams_on_held_out(spark):
    got = QUERIES["op6_suffix_tree"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_tree_looks_six_bytes_back(spark):
    model, rare = suffix_tree.train(spark.createDataFrame([("a12345x",), ("b12345y",)] * 200, "text string"))
    got = suffix_tree.score(spark.createDataFrame([(0, "a12345x"), (1, "a12345y")], "doc_id bigint, text string"), model, rare)
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    assert score[0] > score[1] + 2


@pytest.mark.parametrize("share", [0.0, 1e-7, 0.01, 1.0])
def test_tree_holds_rare_contexts(spark, monkeypatch, share):
    monkeypatch.setattr(suffix_tree, "MIN_SHARE", share)
    texts = ["abcabdacbddbaacbdabcdd " * 9] * 30 + ["xqzw"] * 12
    model, rare = suffix_tree.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = [(0, "xqzw abca"), (1, "new words"), (2, None)]
    got = suffix_tree.score(spark.createDataFrame(asked, "doc_id int, text string"), model, rare)
    for doc_id, score in rows(got, "doc_id", "score"):
        assert math.isclose(score, brute.tree_score(texts, asked[doc_id][1], suffix_tree.DEPTH, suffix_tree.DIVERGENCE), rel_tol=1e-9)


def test_tree_without_training(odd, none):
    model, rare = suffix_tree.train(none)
    got = suffix_tree.score(odd, model, rare).collect()
    assert len(got) == len(ODD)
    for r, (_, text) in zip(sorted(got, key=lambda r: r["score"]), sorted(pairs(odd), key=lambda p: -len(b" ".join(brute.BLANK_WORDS.findall(brute.lower(p[1])))))):
        n = len(b" ".join(brute.BLANK_WORDS.findall(brute.lower(text)))) + 1
        assert math.isclose(r["score"], -n * math.log10(256)) and r["n_known"] == 0 and r["train_tokens"] == 0
    assert suffix_tree.score(none, model, rare).count() == 0


@given(st.lists(st.text(alphabet="ab \n\tÄé", max_size=12), min_size=1, max_size=6))
@settings(deadline=None)
def test_sequences_and_contexts(texts):
    text, bounds, hashed, before = suffix_tree.sequence(*scan.buffers(pa.array(texts)))
    keys = suffix_tree.contexts(text, bounds)
    for k, t in enumerate(texts):
        words = brute.BLANK_WORDS.findall(brute.lower(t))
        want = b" ".join(words) + b"\n"
        assert text[bounds[k] : bounds[k + 1]].tobytes() == want
        assert before[k + 1] - before[k] == len(words)
        padded = b"\n" * suffix_tree.DEPTH + want
        for i, key in enumerate(keys[bounds[k] : bounds[k + 1]].tolist()):
            assert key.to_bytes(suffix_tree.DEPTH + 1, "big") == padded[i : i + suffix_tree.DEPTH][::-1] + want[i : i + 1]


# 7 SimHash


def test_simhash_query(spark, documents):
    same(map(tuple, QUERIES["op7_simhash_pivots"](spark, SF_DIR).collect()), brute.simhash_groups(pairs(documents)))


def test_simhash_of_odd_rows(odd, none):
    got = simhash.groups(odd).select("doc_id", simhash.fingerprint_hex(), "component_id")
    same(map(tuple, got.collect()), brute.simhash_groups(pairs(odd)))
    assert simhash.groups(none).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert rows(kept, "doc_id")[:2] == [(1,), (2,)] and kept.where("doc_id = 1").count() == 1
    assert simhash.deduplicate(none).count() == 0


def test_dense_cells_are_cut(spark):
    random = np.random.Generator(np.random.PCG64(8))
    base = random.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base[:6]:
        for _ in range(60):
            prints.add(int(b) ^ sum(1 << int(k) for k in random.choice(64, random.integers(1, 8), replace=False)))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    sets = brute.Sets(len(prints))
    for i, a in enumerate(prints):
        for j in range(i):
            if ((a ^ prints[j]) & ((1 << 64) - 1)).bit_count() <= 4:
                sets.join(i, j)
    want = {}
    for k, p in enumerate(prints):
        want.setdefault(sets.find(k), set()).add(p)
    for cell in (5, 4096):
        found = shared.components(simhash.links(spark.createDataFrame([(p, [p], p) for p in prints], "node bigint, fp array<bigint>, label bigint"), cell=cell)).collect()
        got = {}
        for r in found:
            got.setdefault(r["component"], set()).add(r["node"])
        same(got.values(), [w for w in want.values() if len(w) > 1])


@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=25))
@settings(max_examples=50, deadline=None)
def test_forest(links):
    forest, sets = shared.Forest(16), brute.Sets(16)
    for a, b in links:
        sets.join(a, b)
    for part in (links[:9], links[9:]):
        forest.union(np.array([a for a, _ in part], int), np.array([b for _, b in part], int))
    assert forest.label.tolist() == [sets.find(k) for k in range(16)]


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(50)] + [(7, 7), (None, 3)] + [(140, 160)]
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in [*range(100, 151), 160]}
    assert shared.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 8 WARC


def test_warc_of_odd_pages(spark):
    big = "x" * 200
    pages = [(1, "http://a/b?c", "small"), (2, "http://a/", "small"), (9, "http://z/", big), (3, "http://b/\r\nX: y", big), (3, "http://b/\r\nX: y", big), (None, None, big), (4, None, None), (5, "bad [url", "é" * 60), (6, "::", ""), (None, "u", "only" * 50)]
    path = shared.scratch(spark, "test")
    warc.write(spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", duck_null()), path)
    captures = warc.assemble(warc.read(spark, path)).collect()
    got = []
    for c in captures:
        fields, response = c["metadata"]["fields"], c["response"]
        got.append((fields.get("page-id"), response["record_type"], fields.get("refers-to-page-id"), response["payload"].decode() if response["record_type"] == "response" else None))
        assert c["request"]["http_headers"].startswith("GET ")
    full = lambda i, html: (i, "response", None, html)
    same(got, [full("1", "small"), full("2", "small"), ("9", "revisit", "3", None), full("3", big), full("3", big), (None, "revisit", "3", None), full("4", ""), full("5", "é" * 60), full("6", ""), full(None, "only" * 50)])
    path = shared.scratch(spark, "test")
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.assemble(warc.read(spark, path)).count() == 0


def duck_null():
    from pyspark.sql import functions as F

    return F.lit("a column named as a result")


def test_records_without_a_capture(spark):
    other = [warc.parse(m) for m in warc.members(b"".join(warc.capture(1, "u", "h", "d", None)))]
    assert [r["record_type"] for r in other] == ["response", "request", "metadata"]
    schema = warc.RECORDS
    names = [c.split()[0] for c in schema.split(", ")]
    frame = spark.createDataFrame([tuple(dict(r[n]) if n == "fields" and r[n] else r[n] for n in names) for r in other[1:]], schema)
    got = warc.assemble(frame).collect()
    assert len(got) == 1 and got[0]["response"] is None and got[0]["metadata"]["fields"] == {"page-id": "1"}
    with pytest.raises(ValueError):
        list(warc.members(b"".join(warc.capture(1, "u", "h", "d", None))[:-5]))


# 9 decontamination


def digest(found):
    from pyspark.sql import functions as F

    found = found.withColumn("ids", decontaminate.items_hit())
    return found.select("doc_id", "n_words", decontaminate.words_hit(), F.size("ids"), F.sha2(F.concat_ws(",", "ids"), 256), F.size("hits") > 0)


def test_contamination_query(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    got = list(map(tuple, QUERIES["op9_phrase_index"](spark, SF_DIR).collect()))
    same(got, brute.contamination(pairs(documents), items))
    assert any(g[-1] for g in got)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_contamination_of_odd_rows(spark, odd, none, block):
    items = [(1, WINDOW + " eleven"), (1, WINDOW + " eleven"), (2, "Short item"), (10, WINDOW), (None, "three four"), (4, None), (5, " .. "), (11, LONG[:300])]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    index = decontaminate.build_index(odd, shared.scratch(spark, "test"))
    same(map(tuple, digest(decontaminate.search(index, table, block=block)).collect()), brute.contamination(pairs(odd), items))
    assert digest(decontaminate.search(index, table.limit(0))).where("`n_words` > 0").count() == sum(w[1] > 0 for w in brute.contamination(pairs(odd), items))
    assert decontaminate.search(decontaminate.build_index(none, shared.scratch(spark, "test")), table).count() == 0
    clean = decontaminate.decontaminate(odd, table)
    assert clean.columns == odd.columns
    same([tuple(r) for r in clean.select("doc_id", "text").collect()], [p for p, c in zip(pairs(odd), brute.contamination(pairs(odd), items)) if not c[-1]])


def test_proximity(spark):
    docs = [(1, "red x x blue y green"), (2, "green red x x x x x blue"), (3, "blue green red"), (4, "red blue")]
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"), shared.scratch(spark, "test"))
    items = spark.createDataFrame([(1, "red green blue")], "item_id bigint, text string")
    hits = {r["doc_id"]: [(h["start"], h["end"]) for h in r["hits"]] for slop in (0, 3) for r in decontaminate.search(index, items, window=None, slop=slop).collect() if slop == 3}
    assert hits == {1: [(0, 6)], 2: [], 3: [(0, 3)], 4: []}


# 10 ring


def test_ring_against_serial_arrival(spark, odd, documents, none):
    columns = ("doc_id", "text")
    docs = documents.select(*columns).union(odd.select(*columns))
    slots, shards = 64, 7
    got = ring.assign(docs, shards, virtual_nodes=5, slots=slots).collect()
    node_of, shard_of = ring.owners(shards, 5, slots)
    import hashlib

    def at(r):
        key = f"{'' if r['doc_id'] is None else r['doc_id']}|{zlib.crc32((r['text'] or '').encode())}"
        return int(hashlib.md5(key.encode()).hexdigest()[:12], 16)

    room, load, want = ring.row_capacities(len(got), shards).tolist(), [0] * shards, []
    for place in sorted(at(r) for r in got):
        node = int(node_of[place * slots >> 48])
        while not room[shard_of[node]]:
            node = (node + 1) % len(shard_of)
        s = int(shard_of[node])
        want.append((place, s, load[s]))
        room[s], load[s] = room[s] - 1, load[s] + 1
    same([(at(r), r["shard"], r["slot"]) for r in got], want)
    assert max(load) - min(load) <= 1
    assert ring.assign(none, shards).count() == 0


def test_ring_moves_little(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    place = lambda n, slack, least=0: {r["doc_id"]: r["shard"] for r in ring.assign(docs.where(f"doc_id >= {least}"), n, slack).collect()}
    loose = place(10, 0.25)
    assert max(Counter(loose.values()).values()) <= 2500
    more = place(11, 0.25)
    assert sum(loose[k] != more[k] for k in loose) < 0.3 * len(loose)
    fewer = place(10, 0.25, 200)
    assert sum(loose[k] != s for k, s in fewer.items()) < 0.1 * len(loose)


def test_shards_of_odd_rows(spark, odd):
    got = ring.write_shards(odd, shared.scratch(spark, "test"), 5)
    assert set(got.columns) == set(odd.columns)
    same([(r["doc_id"], r["text"]) for r in got.collect()], pairs(odd))
    by = {}
    for r in got.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


# the pipeline


def in_files(df):
    """The rows of a stored table in the order of its files."""
    return sorted(df.select("doc_id", "text", "_metadata.file_path", "_metadata.row_index").collect(), key=lambda r: (r["file_path"], r["row_index"]))


def test_pipeline_stage_by_stage(spark, documents):
    docs, items = documents, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    kept = shared.stored(corpus_pipeline.identify_language(spark, docs, SF_DIR), "test")
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    one = shared.stored(corpus_pipeline.drop_near_duplicates(spark, kept, SF_DIR), "test")
    heads, near, found = brute.near_copies(pairs(kept))
    assert {r[0] for r in rows(one, "doc_id")} == heads and one.count() == len(heads)
    assert found <= near  # recall is measured on more documents: see the README
    clean = shared.stored(corpus_pipeline.drop_contaminated(spark, one, SF_DIR), "test")
    good = {c[0] for c in brute.contamination(pairs(one), items) if not c[-1]}
    assert {r[0] for r in rows(clean, "doc_id")} == good and len(good) < len(heads)
    mixed = shared.stored(corpus_pipeline.mix_sources(spark, clean, SF_DIR), "test")
    assert Counter(tuple(r) for r in mixed.select("doc_id", "text", "source").collect()) == brute.copies([tuple(r) for r in clean.select("doc_id", "text", "source").collect()])
    want = brute.token_rows([(k, r["text"]) for k, r in enumerate(in_files(mixed))], public_tokenizer())
    want = [(r["doc_id"], *w[1:]) for r, w in zip(in_files(mixed), want)]
    out = corpus_pipeline.write_token_files(spark, mixed, SF_DIR)
    same(map(tuple, out.collect()), want)
    same(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()), want)


def test_files_in_stored_order(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text", "explode(sequence(1, 5))").drop("col")
    mixed = shared.stored(mixing.mix(docs.withColumn("source", (docs.doc_id % 3).cast("string"))).select("doc_id", "text"), "test")
    got = [r["doc_id"] for r in corpus_pipeline.write_token_files(spark, mixed, SF_DIR).orderBy("start").collect()]
    assert got == [r["doc_id"] for r in in_files(mixed)]
    plan = corpus_pipeline.write_token_files(spark, docs.repartition(3), SF_DIR).orderBy("start").collect()  # not from files: stored first
    assert Counter(r["doc_id"] for r in plan) == {k: 5 for k in range(200)}


def test_mixing_draws_documents_without_id_apart(spark):
    docs = spark.range(4000).selectExpr("if(id % 2 = 0, id, NULL) AS doc_id", "concat('text ', id) AS text", "'s' AS source")
    got = mixing.mix(docs)  # a source that is a literal, too
    assert 3600 < got.count() < 4400 and 1800 < got.where("doc_id IS NULL").count() < 2200
    assert got.where("doc_id IS NULL").select("shuffle_key").distinct().count() == got.where("doc_id IS NULL").count()


def test_parts_of_files_are_read_in_many_tasks(spark):
    parts = spark.range(20000).selectExpr("concat('f', id % 20) AS file", "id * 8388608 AS start", "8388608L AS size").coalesce(1)
    dealt = shared.spread(parts, "size", "file", "start").groupBy(F.spark_partition_id()).count()
    assert dealt.count() > 1500 and dealt.agg({"count": "max"}).first()[0] < 60
    few = shared.spread(parts.limit(3), "size", "file", "start")
    assert few.rdd.getNumPartitions() == 3 and shared.spread(parts.limit(0), "size", "file").rdd.getNumPartitions() == 1


def test_language_against_brute_force(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op5_language_masks"](spark, SF_DIR).collect()}
    want = brute.languages([(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()])
    assert {i: (r["held_out"], r["lang_pred"]) for i, r in got.items()} == {i: w[:2] for i, w in want.items()}
    assert all(abs(r["score"] - want[i][2]) < 1e-9 for i, r in got.items())


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["ab cd", "", "x", "hello  World. ", "é1é", "a b c d"]

    def found(raw):
        own, bounds = language.grams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        return [own[a:b].tolist() for a, b in zip(bounds, bounds[1:])]

    raw = [t.encode() for t in texts]
    assert found(raw) == [found([t])[0] for t in raw] and found(raw)[3][0] == int.from_bytes(b" hel", "little")


def test_letters_are_unicode_letters():
    model = language.Model.build(["en"], [np.array([1], np.uint32)])
    texts = ["½² ③", "Ⅷ ⅳ", "٣٤ _", "ß", "中", "", "a"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    assert model.decide(np.frombuffer(data, np.uint8), offsets)[0] == ["und", "und", "und", "en", "en", "und", "en"]


@pytest.mark.parametrize("cell, part", [(40, simhash.PART), (simhash.CELL, 20_000)])
def test_texts_just_below_the_likeness_are_judged_where_they_meet(spark, monkeypatch, cell, part):
    draw = np.random.Generator(np.random.PCG64(12))
    texts = []
    for k in range(200):  # to most others 0.7 to 0.8
        words = [f"w{j}" for j in range(400)]
        for at in draw.choice(400, 6, replace=False):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    for k in range(20):  # to one of them above
        texts.append(texts[k] + f" more{k}")
    wide = simhash.torn_links
    monkeypatch.setattr(simhash, "torn_links", lambda *a: wide(*a, cell=cell, part=part))
    judged, store = [], simhash.stored

    def counted(df, name):
        out = store(df, name)
        if name in ("judged", "candidates"):
            judged.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()}
    own = [np.frombuffer(simhash.packed_set(x), np.uint8).reshape(-1, simhash.HASH) for x in simhash.shingles(pa.array(texts))]
    own = [{bytes(h) for h in x} for x in own]
    prints = np.array([simhash.wide_fingerprint(x) for x in simhash.shingles(pa.array(texts))])
    cells = np.stack(list(simhash.Pivots.narrow(simhash.NEAR_BLOCKS, simhash.NEAR_BITS, simhash.NEAR_WORDS, agree=1).cells(prints)), axis=1)
    sets, close = brute.Sets(len(texts)), 0
    for a in range(len(texts)):
        for b in range(a):
            if np.bitwise_count((prints[a] ^ prints[b]).view(np.uint64)).sum() <= simhash.NEAR_LIMIT and (cells[a] == cells[b]).any():
                close += 1
                if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]) - 1e-9:
                    sets.join(a, b)
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(sets.find(k), []).append(k)
    assert got == {min(g) for g in groups.values()} and 20 <= len(texts) - len(groups)
    assert close > 10_000 and sum(judged) < 40 * len(texts)


def test_parity_of_sets_differs_in_no_more_than_members():
    draw = np.random.Generator(np.random.PCG64(13))
    sets = [np.unique(draw.integers(0, 4000, n, dtype=np.uint64)) for n in (0, 1, 30, 900, 3000, 3000)]
    odd = simhash.parity(sets)
    assert odd.shape == (6, simhash.PARITY // 64)
    for x, a in zip(sets, odd):
        for y, b in zip(sets, odd):
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_rows_that_stay_are_not_shuffled(spark):
    rows = [(k, f"{'the river and the hill and a bridge ' * 3}{k % 90} {k % 90 * 7} {k % 90 * 11}") for k in range(100)] + [(3, None), (3, None), (None, "alone"), (None, "alone")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"))
    plan = kept._jdf.queryExecution().optimizedPlan()
    assert plan.getClass().getSimpleName() == "Union" and "Join" not in plan.children().apply(0).toString()
    held = shared.sieve(spark.range(0, 3000, 3).toDF("key"))
    inside = [r["id"] for r in spark.range(30000).where(held(F.col("id"))).collect()]
    assert set(range(0, 3000, 3)) <= set(inside) and len(inside) < 1010
    full = shared.sieve(spark.range(3000).toDF("key"), 64)
    assert spark.range(3000).where(full(F.col("id"))).count() == 3000
    assert spark.range(10).where(shared.sieve(spark.range(0).toDF("key"))(F.col("id"))).count() == 0


def test_pipeline_stages_take_odd_rows(spark, odd, none, documents):
    for docs in (odd.select(documents.columns), none.select(documents.columns)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            out.count()


