"""The registered queries over whole tables, against their SQL or brute force; and the pipeline, stage by stage."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from factloom.llm import decontaminate, mixing, queries, token_files
from factloom.llm._shared import keep, table

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "documents pages benchmark labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(rows):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert plain(got.select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    doubled = [int(c) * 2 if k % 2 else int(c) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    valid = {
        "email": lambda x: True,
        "ip": lambda x: all(int(p) <= 255 for p in x.split(".")),
        "card": lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x)),
        "phone": lambda x: 9 <= len(digits(x)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if valid[k](m.group())] for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))}


def test_op1(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, LARGER, "documents").collect()}
    got = queries.QUERIES["op1_pii"](spark, LARGER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = base_spans(texts[r["doc_id"]])
        written = [f"{k}:{a}:{b}" for k, own in base.items() for a, b in own]
        assert [r[f"n_{k}"] for k in base] == [len(x) for x in base.values()]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r["spans"].split(","))  if written else True


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_tokens(rows, texts, tokenizer):
    """rows by start hold the ids of texts, in this order."""
    start = 0
    for r, (doc_id, text) in zip(rows, texts, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op5(spark, tokenizer):
    texts = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    got = queries.QUERIES["op5_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    check_tokens(got, texts, tokenizer)


@pytest.mark.parametrize(("name", "label", "least"), [("op7_quality_classifier", "quality", 0.9), ("op10_toxicity", "toxic", 0.93)])
def test_classifiers(spark, name, label, least):
    labels = {r["doc_id"]: r[label] for r in table(spark, LARGER, "labels").collect()}
    got = queries.QUERIES[name](spark, LARGER).collect()
    assert len(got) == table(spark, LARGER, "documents").count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= (0.3 if label == "quality" else 0.5)) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    majority = max(sum(y for _, y in held), sum(1 - y for _, y in held)) / len(held)
    assert sum(p == y for p, y in held) / len(held) >= max(least, majority)


def test_pipeline(spark, tokenizer, duck):
    from test_brute_force import exact_components

    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontaminate", "mix", "tokens"]
    kept = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op4_quality_rules']}) WHERE kept").fetchall()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = keep(stage(spark, docs, SF))
    rows = lambda name: {r["doc_id"]: r for r in out[name].collect()}
    first = rows("quality_rules")
    assert set(first) == kept
    components = exact_components([(k, r["text"]) for k, r in first.items()])
    second = rows("near_dedup")
    assert set(second) == {k for k, (_, c) in components.items() if k == c}
    items = {str(r["item_id"]): r["text"] for r in table(spark, SF, "benchmark").collect()}
    found = dict(zip(second, decontaminate.brute_force([r["text"] for r in second.values()], items)))
    third = rows("decontaminate")
    assert set(third) == {k for k, x in found.items() if not x[1] or x[1] < x[0]}
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x))
    for k, r in third.items():
        assert len(split(r["text"])) == found[k][0] - found[k][1] and (found[k][1] or r["text"] == second[k]["text"]) and r["n_chars"] == len(r["text"])
    # the mix keeps all rows, in the order of the slots
    mixed = [r["doc_id"] for r in mixing.mix(out["decontaminate"]).orderBy("slot", "source", "pos").collect()]
    assert sorted(mixed) == sorted(third)
    got = docs.orderBy("start").collect()
    assert [r["doc_id"] for r in got] == mixed
    check_tokens(got, [(k, third[k]["text"]) for k in mixed], tokenizer)
    assert plain(corpus_pipeline.run(spark, SF).collect()) == plain(got)


def test_encoding_by_words_needs_a_tokenizer_that_splits_there(tmp_path):
    """Whole texts are encoded where matches may cross white space."""
    import public_tokenizers

    assert token_files.splits_at_space(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert not token_files.splits_at_space('{"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": true}, "normalizer": null, "model": {"type": "BPE"}, "added_tokens": []}')
