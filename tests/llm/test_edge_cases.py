"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import decontaminate, mixing, near_dedup, pii, quality_classifier, quality_rules, substring_dedup, token_files, toxicity, warc
from factloom.llm._shared import shared_dir

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = "score double, kept string, n_words string, slot string, spans string, items string, component_id string, key string, q string, k string, at string, block string, pii_spans string, __label string, start string, __judged string, __found string, __row string, __part string, __gone string"
PROSE = "the quick brown fox of the north is here and the people in the town were glad to see it come by the river on a cold day "
LONG = " ".join(f"word{i % 977} of the" for i in range(60_000))


def rows():
    return [
        (1, PROSE * 4, "en", "a", 1), (1, PROSE * 4, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "", 0), (4, " \n\t ", "en", "a", 4),
        (None, PROSE * 4, "en", "b", 9), (5, LONG, "en", "a", len(LONG)), (6, "a@b.co or +1 (949) 555-8112 or 4802264633377894 or 10.0.0.1", "en", "b", 1), (7, PROSE * 4, "en", "a", 1), (8, "é" * 30_000, "fr", "b", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    """The same rows with more columns, named like those of the operators' results."""
    return spark.createDataFrame([(*r, 1.0, *["x"] * 19) for r in rows()], f"{SCHEMA}, {CLASH}")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, n=0):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id bigint, quality int, toxic int")


def benchmark(spark, items=()):
    return spark.createDataFrame(list(items), "item_id bigint, text string")


def test_pii(spark, docs, clashing, empty):
    got = {r["doc_id"]: r["pii_spans"] for r in pii.find_personal_data(clashing).collect()}
    assert [s["kind"] for s in got[6]] == ["email", "ip", "card", "phone"]
    assert all(got[i] == [] for i in (2, 3, 4, 5, 8))
    assert pii.find_personal_data(docs).count() == 10
    assert pii.find_personal_data(empty).count() == 0
    assert "score" in pii.find_personal_data(clashing).columns


def test_mixing(spark, docs, clashing, empty):
    got = mixing.mix(clashing, block_docs=2)
    assert got.count() == 10 and set(clashing.columns) <= set(got.columns)
    places = [tuple(r) for r in got.select("slot", "pos").collect()]
    assert len(set(places)) == 10
    assert mixing.mix(empty).count() == 0
    some = {r["doc_id"]: r for r in mixing.mix(docs, weights={"a": 1.0}).collect()}
    assert some[6]["slot"] is None and not some[6]["in_mix"] and some[7]["slot"] is not None


def test_substring_dedup(spark, docs, clashing, empty):
    got = {}
    for r in substring_dedup.remove_repeats(clashing, with_text=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
    n = len((PROSE * 4).split())
    assert [r["n_removed"] for r in got[1]] == [0, 0]
    assert got[7][0]["n_removed"] == n and got[7][0]["kept_text"] == "" and got[None][0]["n_removed"] == n
    assert got[5][0]["n_removed"] == 0 and got[5][0]["n_words"] == 180_000
    assert got[2][0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_of_rows_that_share_an_id(spark):
    """Each row loses what repeats in it alone, and columns may have any name."""
    w = lambda p: " ".join(f"{p}{k}" for k in range(40))
    rows = [(1, w("a"), "x"), (None, w("a"), "y"), (None, w("b"), "z"), (1, w("c"), "v"), (2, w("c") + " " + w("d"), "u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __id string").withColumns({c: F.lit(1) for c in ("__ranges", "row", "ranges", "text_hash")})
    got = {r["__id"]: r for r in substring_dedup.remove_repeats(df).collect()}
    assert {k: r["n_removed"] for k, r in got.items()} == {"x": 0, "y": 40, "z": 0, "v": 0, "u": 40}
    assert got["x"]["text_hash"] == 1 and got["x"]["doc_id"] == 1 and got["z"]["doc_id"] is None


def test_quality_rules(spark, docs, clashing, empty):
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(clashing).collect()}
    assert got[2]["base_failed"] and not got[2]["kept"] and got[3]["n_words"] == 0
    assert got[5]["n_words"] == 180_000 and got[8]["n_words"] == 1
    assert got[1]["n_repeat_words"] > 0 and got[6]["q"] == "x"
    assert quality_rules.apply_rules(empty).count() == 0
    assert quality_rules.apply_rules(docs, rules=()).count() == 10


def test_token_files(spark, docs, clashing, empty):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    got = {}
    for r in token_files.read_digests(spark, token_files.write_token_files(clashing, shared_dir(spark), path)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [r["n_tokens"] for i in (2, 3, 4) for r in got[i]] == [1, 1, 1]
    assert got[2][0]["ids_crc32"] == zlib.crc32(b"\2\0\0\0") and len(got[1]) == 2 and got[None][0]["start"] == 0
    assert token_files.read_digests(spark, token_files.write_token_files(empty, shared_dir(spark), path)).count() == 0


def test_near_dedup(spark, docs, clashing, empty):
    got = {}
    for r in near_dedup.near_duplicates(clashing).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in got[1]] == [1, 1] and got[7][0]["component_id"] == 1 and not got[7][0]["kept"]
    assert all(got[i][0]["component_id"] == i and got[i][0]["n_shingles"] == 0 for i in (2, 3, 4))
    assert got[None][0]["component_id"] is None and got[None][0]["kept"]
    assert near_dedup.near_duplicates(empty).count() == 0
    left = near_dedup.drop_near_duplicates(clashing)
    assert left.columns == clashing.columns and left.count() == 9


def test_classifiers(spark, docs, clashing, empty):
    for train, accept in ((quality_classifier.train, 0.3), (toxicity.train, 0.5)):
        for n in (0, 9):
            model = train(clashing, labels(spark, n))
            got = quality_classifier.score(clashing, model, accept=accept).collect()
            assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
            assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1
            assert quality_classifier.score(empty, model).count() == 0
        assert quality_classifier.score(docs, train(empty, labels(spark, 9))).count() == 10


def test_warc(spark):
    pages = [(1, "http://a.b.c/x?q=1", "same", 1), (2, None, "same", 1), (3, "http://[bad", None, 1), (4, "no host", "", 1), (None, "http://a.b.c/x?q=1", "same", 1), (5, "http://a.b.c:8080/", "é" * 100_000, 1), (1, "http://a.b.c/x?q=1", "same", 1)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, offset int")
    df = df.withColumns({c: F.lit("x") for c in ("url_key", "file", "first", "sha1", "length")})
    index = warc.write_archive(df, shared_dir(spark))
    got = {}
    for r in warc.read_pages(df, index).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert [r["record_type"] for r in got[1]] == ["response", "response"] and got[2][0]["refers_to"] == 1 and got[None][0]["refers_to"] == 1
    assert got[3][0]["record_type"] == "response" and got[4][0]["refers_to"] == 3 and got[3][0]["payload_bytes"] == 0 and got[5][0]["payload_bytes"] == 200_000
    assert sorted(str(x["page_id"]) for x in index.find("http://A.b.c/x?q=1")) == ["1", "1", "None"]
    none = spark.createDataFrame([], df.schema)
    index = warc.write_archive(none, shared_dir(spark))
    assert warc.read_pages(none, index).count() == 0 and index.find("http://a/") == []


def test_decontamination(spark, docs, clashing, empty):
    items = [(1, "quick brown FOX of the north is here and the"), (2, None), (3, ""), (None, "people in the town"), (4, "zz")]
    got = {r["doc_id"]: r for r in decontaminate.find_benchmark(clashing, benchmark(spark, items)).collect()}
    assert got[1]["items"] == ["1"] and got[1]["n_hit"] == 40 and got[2]["n_words"] == 0 and got[5]["n_hit"] == 0
    assert decontaminate.find_benchmark(docs, benchmark(spark)).where("n_hit > 0").count() == 0
    assert decontaminate.find_benchmark(empty, benchmark(spark, items)).count() == 0
    clean = decontaminate.remove_benchmark(clashing, benchmark(spark, items))
    assert clean.columns == clashing.columns and clean.count() == 10 and clean.where("text like '%brown fox%'").count() == 0
    # one block an item gives what one block gives
    parts = decontaminate.find_benchmark(docs, benchmark(spark, [*items, (9, "the river on a cold day the quick brown fox of the")]), block_bytes=1)
    whole = decontaminate.find_benchmark(docs, benchmark(spark, [*items, (9, "the river on a cold day the quick brown fox of the")]))
    assert parts.select("doc_id", "n_hit", "items", "spans").exceptAll(whole.select("doc_id", "n_hit", "items", "spans")).count() == 0


def good(spark, table):
    """table and a text that the rules keep."""
    text = " ".join("the" if k % 10 == 0 else f"word{k}" for k in range(160))
    return table.unionByName(spark.createDataFrame([(50, text, "en", "a", len(text))], SCHEMA), allowMissingColumns=True)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, clashing, empty, tmp_path, name):
    benchmark(spark, [(1, "quick brown fox of the north is here and the")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    counts = {"quality_rules": 1, "near_dedup": 10, "decontaminate": 11, "mix": 11, "tokens": 11}
    for table in (good(spark, docs), good(spark, clashing), empty):
        out = stage(spark, table, str(tmp_path))
        if name == "tokens":
            assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        else:
            assert out.dtypes == table.dtypes
        assert out.count() == (0 if table is empty else counts[name])


def test_run(spark, docs, tmp_path):
    benchmark(spark, [(1, "quick brown fox of the north is here and the")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    good(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [50]


def test_classifiers_with_both_labels_of_a_document(spark, docs):
    both = spark.createDataFrame([(i, y, y) for i in range(9) for y in (0, 1, None)], "doc_id bigint, quality int, toxic int")
    for train in (quality_classifier.train, toxicity.train):
        got = quality_classifier.score(docs, train(docs, both)).collect()
        assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
