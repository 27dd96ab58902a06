import os

import pytest
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.engine import Engine
from factloom.operators import evaluation, revisions, search
from factloom.operators.embedding import FixedEmbedder, KeywordEmbedder, ModelEmbedder, choose_embedder, remote_loader
from factloom.operators.index import ChunkIndex
from factloom.schemas import E2E_ITEMS, VERIFIER_ITEMS
from factloom.sources.jsonl import read_jsonl
from factloom.sources.vault import read_notes, text_notes, walk
from factloom.streaming import changes


def write(root, **files):
    for name, content in files.items():
        path = root / name.replace("__", "/").replace("_md", ".md")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_walk(spark, tmp_path):
    write(tmp_path, a_md="x", sub__b_md="y", **{"notes.txt": "t", ".hidden/c.md": "z", "node_modules/d.md": "w", "E.MD": "v"})
    assert sorted(walk(str(tmp_path))) == ["E.MD", "a.md", "sub/b.md"]
    assert sorted(r["path"] for r in read_notes(spark, str(tmp_path)).collect()) == ["E.MD", "a.md", "sub/b.md"]


def test_knn(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.8, 0.2, 0.0, 0.0]), (3, [0.0, 0.0, 0.0, 1.0]), (4, [0.8, 0.2, 0.0, 0.0])], "chunk_id bigint, embedding array<double>")
    one = search.nearest(base, [1.0, 0, 0, 0], 2).collect()
    assert [r["chunk_id"] for r in one] == [1, 2] and one[0]["distance"] == 0
    many = search.search(base, base.withColumnRenamed("chunk_id", "query_id"), 3)
    assert [r["chunk_id"] for r in many.where("query_id = 2").orderBy("rank").collect()] == [2, 4, 1]
    assert search.search(base, base.withColumnRenamed("chunk_id", "query_id").limit(0), 3).count() == 0
    score = lambda d: spark.range(1).select(search.relevance(F.lit(d))).first()[0]
    assert [score(0.0), score(1.0), score(2.0)] == [1.0, 0.5, 0.0]


def test_engine(spark, tmp_path):
    vault = tmp_path / "vault"
    write(vault, Port__Berths_md="# Berths\n\n## Plans\n\nThe team plans Rotterdam for the next release. ^p4n1\n", **{"Daily/2026-01-01.md": "# Diary\n\nGulls at the pier this morning.\n"})
    engine = Engine(spark, str(vault), str(tmp_path / "home"))
    assert engine.ping()["message"] == "pong"
    assert engine.index_all() == {"notes": 2, "chunks": 2, "skipped": 0, "errored": 0, "pruned": 0}
    top = engine.search("release plan of the team", 3).orderBy("rank").first()
    assert (top["path"], top["anchor"], top["citation"]) == ("Port/Berths.md", "#^p4n1", "Port/Berths.md#^p4n1") and top["quote"].endswith("^p4n1")
    assert engine.index_all() == {"notes": 0, "chunks": 0, "skipped": 2, "errored": 0, "pruned": 0}
    write(vault, Binary_md=bytes([0, 1, 2, 0]), Temp_md="# T\n\nSome data.\n")
    assert engine.index_all()["notes"] == 1 and engine.index.vector_count() == 3
    os.remove(vault / "Temp.md")
    assert engine.index_all()["pruned"] == 1
    engine.index.remove("Port/Berths.md")
    assert engine.index.chunks().select("path").distinct().count() == 1
    with pytest.raises(ValueError):
        engine.search("x", 51)

    first = engine.safe_edit("Port/Berths.md", "plans Rotterdam", "plans Antwerp")
    done = engine.safe_edit("Port/Berths.md", "plans Rotterdam", "plans Antwerp", first.token)
    assert done.reindexed_chunks == 1 and "Antwerp" in (vault / "Port/Berths.md").read_text()
    back = engine.restore("Port/Berths.md", done.snapshot)
    assert "Rotterdam" in (vault / "Port/Berths.md").read_text() and "Antwerp" in open(back.pre_restore_snapshot).read()
    assert engine.verify("The team plans Rotterdam for the next release.").first()["verdict"] == "grounded"
    cited = engine.cite("The team plans Rotterdam for the next release.").first()
    assert cited["cited"] and cited["note"] == "Supported by 1 note passage(s)." and cited["statement"].startswith("The team")


def test_first_search_waits_for_an_index_and_edits_touch_one_note(spark, tmp_path):
    vault = tmp_path / "vault"
    write(vault, a_md="# A\n\nThe team meets on Monday.\n", b_md="# B\n\nGulls again.\n")
    engine = Engine(spark, str(vault), str(tmp_path / "home"))
    assert engine.search("team", 1).count() == 1
    write(vault, b_md="# B\n\nchanged outside\n")
    token = engine.safe_edit("a.md", "Monday", "Friday").token
    assert engine.safe_edit("a.md", "Monday", "Friday", token).reindexed_chunks == 1
    assert {r["path"]: r["text"] for r in engine.index.chunks().collect()} == {"a.md": "The team meets on Friday.", "b.md": "Gulls again."}
    many = spark.createDataFrame([(0, "s", "#S", "x")] * 51, "answer_id bigint, path string, anchor string, text string")
    with pytest.raises(ValueError):
        engine.verify("The team meets.", many)


def test_one_unreadable_note(spark, tmp_path):
    write(tmp_path, a_md="# A\n\none\n", b_md="# B\n\ntwo\n")
    engine = Engine(spark, str(tmp_path), str(tmp_path / "home"))
    engine.index_all()
    os.remove(tmp_path / "b.md")
    os.symlink(tmp_path / "nowhere", tmp_path / "b.md")
    write(tmp_path, a_md="# A\n\nthree\n")
    assert engine.index_all() == {"notes": 1, "chunks": 1, "skipped": 0, "errored": 1, "pruned": 0}
    assert {r["text"] for r in engine.index.chunks().collect()} == {"three", "two"}


def test_settings_choose_models(spark, tmp_path):
    got = Engine(spark, str(tmp_path), config=EngineConfig(embedding="remote", verify_timeout_ms=7), api_key="key", post=post, ask=lambda claim, passages: "{}")
    assert got.embedder.id == "remote" and got.judge.timeout_ms == 7
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path), config=EngineConfig(embedding="remote"))


def test_model_change_rebuilds(spark, tmp_path):
    notes = spark.createDataFrame([("a.md", 1, "# A\n\ntext\n")], "path string, mtime_ms bigint, content string")
    index = ChunkIndex(spark, str(tmp_path))
    assert index.update(notes, FixedEmbedder((1.0, 0.0), "a"))["notes"] == 1
    assert index.update(notes, FixedEmbedder((1.0, 0.0), "a"))["skipped"] == 1
    assert index.update(notes, FixedEmbedder((1.0, 0.0, 0.0), "b"))["notes"] == 1 and index.manifest()["dim"] == 3
    assert index.update(notes, FixedEmbedder((1.0, 0.0, 0.0), "b"), force=True)["notes"] == 1


def post(request):
    return 200, {"data": [{"index": k, "embedding": [3.0 + k, 0.0]} for k in reversed(range(len(request["input"])))]}


def test_embedders(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    got = ModelEmbedder("m", 2, remote_loader(post, "m"), batch=2).embed(df).collect()
    assert [r["embedding"][0] for r in got] == [1.0, 1.0]
    assert sorted(len(r["embedding"]) for r in KeywordEmbedder().embed(df).collect()) == [12, 12]
    with pytest.raises(RuntimeError, match="500"):
        remote_loader(lambda r: (500, "x" * 999), "m")()(["a"])
    with pytest.raises(ValueError):
        choose_embedder("remote")
    assert choose_embedder("local").dim == 12


def test_editor(tmp_path):
    root = tmp_path / "v"
    write(root, a_md="# A\n\nThe pier is wood.\n", b_md="x x")
    editor = revisions.NoteEditor(str(root), str(tmp_path / "s"))
    seen = editor.edit("a.md", "The pier is wood.", "The pier is stone.")
    assert "-The pier is wood." in seen.diff and "+The pier is stone." in seen.diff and len(seen.token) == 16 and "wood" in (root / "a.md").read_text()
    assert seen.diff.startswith("@@ -3,1 +3,1 @@\n # A\n \n-The")
    for args, message in ((("a.md", "The pier is wood.", "y", "0" * 16), "token"), (("../e.md", "x", "y"), "outside the vault"), (("a.txt", "x", "y"), "Markdown"), (("a.md", "absent", "y"), "not found"), (("b.md", "x", "y"), "2 times"), (("a.md", "wood", "wood"), "nothing")):
        with pytest.raises(revisions.EditError, match=message):
            editor.edit(*args)
    done = editor.edit("a.md", "The pier is wood.", "The pier is stone.", seen.token)
    assert "wood" in open(done.snapshot).read() and "stone" in (root / "a.md").read_text()
    with pytest.raises(revisions.EditError):
        editor.restore("a.md", str(root / "b.md"))
    for _ in range(25):
        editor.restore("a.md", done.snapshot) if os.path.exists(done.snapshot) else editor._snapshot("a.md", "z")
    assert len(editor.listing("a.md")) == 20


def test_config():
    assert EngineConfig() == EngineConfig(knn=6, grounded=0.8, refuse=0.5, decisive=0.5, evidence_min_score=0.35, verify_timeout_ms=30_000)
    got = EngineConfig.from_args(["--knn", "9", "--grounded-threshold=0.7", "--refuse-threshold", "x", "--odd", "--decisive", "0.1", "--reindex"], {"FACTLOOM_VERIFIER": "local"})
    assert (got.knn, got.grounded, got.refuse, got.decisive, got.reindex, got.verifier) == (9, 0.7, 0.5, 0.5, True, "local")


def test_metrics(spark):
    rows = spark.createDataFrame([("supported", "supported"), ("supported", "neutral"), ("contradicted", "contradicted"), ("neutral", "supported")], "gold string, predicted string")
    m = evaluation.verifier_metrics(rows).first()
    assert (m["refusal_precision"], m["grounding_precision"], m["contradiction_precision"], m["balanced_accuracy"]) == (0.5, 0.5, 1.0, 0.5)
    assert evaluation.verifier_metrics(rows.limit(0)).first()["balanced_accuracy"] == 1.0
    e = evaluation.e2e_metrics(spark.createDataFrame([("grounded", "flagged"), ("refused", "refused"), ("refused", "grounded")], "expected string, verdict string")).first()
    assert (e["grounding_recall"], e["refusal_recall"], e["grounding_precision"], e["false_refusal_rate"]) == (1.0, 0.5, 0.5, 0.0)
    assert evaluation.passes(e.asDict()) == {"grounding_precision": False, "false_refusal_rate": True, "refusal_recall": False}
    values = spark.createDataFrame([(float(x),) for x in (4, 2, 3, 1)], "v double")
    assert [evaluation.percentile(values, "v", p).first()[0] for p in (0.0, 0.5, 1.0)] == [1.0, 3.0, 4.0]
    assert evaluation.percentile(values.limit(0), "v", 0.5).first()[0] == 0.0


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"claim": "a", "passages": ["p"], "gold": "supported"}\n\n// note\n  {"claim": "b", "passages": [], "gold": "neutral", "note": "n"}\n')
    assert [r["claim"] for r in read_jsonl(spark, str(tmp_path / "x.jsonl"), VERIFIER_ITEMS, comments=True).collect()] == ["a", "b"]
    assert read_jsonl(spark, str(tmp_path / "x.jsonl"), E2E_ITEMS).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame(
        [("a.md", "add", "2024-01-01 00:00:00", "# A\n\nold\n"), ("a.md", "change", "2024-01-01 00:00:00.2", "# A\n\nnew\n"), ("b.md", "add", "2024-01-01 00:00:01", "b"), ("b.md", "unlink", "2024-01-01 00:00:02", None), (".c.md", "add", "2024-01-01 00:00:01", "c"), ("d.txt", "add", "2024-01-01 00:00:01", "d")],
        "path string, op string, ts string, content string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r["path"], r["op"], r["events"]) for r in changes.debounce(changes.relevant(log)).collect()) == [("a.md", "change", 2), ("b.md", "add", 1), ("b.md", "unlink", 1)]
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    index = ChunkIndex(spark, str(tmp_path / "index"))
    index.update(spark.createDataFrame([("b.md", 0, "b"), ("k.md", 0, "kept")], "path string, mtime_ms bigint, content string"), FixedEmbedder())
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    changes.follow(stream, changes.merge_into(index, FixedEmbedder()), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert sorted((r["path"], r["text"]) for r in index.chunks().collect()) == [("a.md", "new"), ("k.md", "kept")]
    closed = changes.debounce(stream, watermark="1 second").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    closed.awaitTermination(120)
    assert {r["path"] for r in spark.table("closed").collect()} <= {"a.md", "b.md", ".c.md", "d.txt"}


def test_decoding(spark):
    raw = spark.createDataFrame([("a", 0, bytearray(b"ok \xff x")), ("b", 0, bytearray(b"a\x00b"))], "path string, mtime_ms bigint, content binary")
    assert [(r["path"], r["content"]) for r in text_notes(raw).collect()] == [("a", "ok � x")]


def test_small_changes_rewrite_their_buckets_only(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path))
    rows = [(f"n{k}.md", 0, f"# Note {k}\n\nThe pier number {k}.") for k in range(60)]
    notes = lambda some: spark.createDataFrame(some, "path string, mtime_ms bigint, content string")
    paths = lambda some: spark.createDataFrame([(x,) for x in some], "path string")
    index.update(notes(rows), KeywordEmbedder())
    first = index.manifest()
    assert first["buckets"] == ChunkIndex.LEAST_BUCKETS and first["n_notes"] == 60
    stats = index.merge(notes([("n3.md", 1, "# Note 3\n\nThe pier is gone.")]), paths(["n5.md", "none.md"]), KeywordEmbedder())
    second = index.manifest()
    assert stats["notes"] == 1 and stats["pruned"] == 1 and second["n_notes"] == 59 == index.notes().count()
    assert 1 <= sum(first["chunks"][k] != second["chunks"].get(k) for k in first["chunks"]) <= 2
    assert {r["text"] for r in index.chunks().where("path = 'n3.md'").collect()} == {"The pier is gone."}
    assert index.chunks().where("path = 'n5.md'").isEmpty() and index.vector_count() == 59


def test_buckets_are_dealt_anew_as_notes_become_many(spark, tmp_path):
    class Small(ChunkIndex):
        BUCKET_NOTES, LEAST_BUCKETS = 2, 1

    index = Small(spark, str(tmp_path))
    rows = [(f"n{k}.md", 0, f"The pier number {k}.") for k in range(30)]
    notes = lambda some: spark.createDataFrame(some, "path string, mtime_ms bigint, content string")
    index.update(notes(rows[:2]), KeywordEmbedder())
    assert index.manifest()["buckets"] == 1
    index.merge(notes(rows[2:]), notes([]).select("path"), KeywordEmbedder())
    assert index.manifest()["buckets"] == 15
    assert sorted((r["path"], r["text"]) for r in index.chunks().collect()) == sorted((p, c) for p, _, c in rows)
    assert index.update(notes(rows[:1]), KeywordEmbedder())["pruned"] == 29 and index.notes().count() == 1 == index.chunks().count()
    index.remove("n0.md")
    assert index.notes().count() == 0 == index.vector_count() and index.manifest()["n_notes"] == 0
    index.merge(notes(rows[4:6]), notes([]).select("path"), KeywordEmbedder())
    assert index.notes().count() == 2 == index.vector_count()
