"""Search and verify do each piece of work once, and lose nothing by what they pass over."""

import numpy as np

from factloom import engine
from factloom.operators import search
from factloom.operators.embedding import FixedEmbedder
from factloom.operators.judge import LexicalJudge


def test_leaves_that_are_passed_over_hold_none_of_the_nearest():
    rng = np.random.default_rng(3)
    for x, q in ((rng.integers(0, 5, (3000, 4)), rng.integers(0, 5, (200, 4))), (rng.random((3000, 8)), rng.random((200, 8))), (rng.random((4, 3)), rng.random((9, 3)))):
        x, q = x.astype(float), q.astype(float)
        d = np.floor(np.sqrt(((q[:, None, :] - x[None]) ** 2).sum(2)) * 1e9 + 0.5) / 1e9
        want = {(i, j, d[i, j]) for i in range(len(q)) for j in np.lexsort((np.arange(len(x)), d[i]))[:6]}
        own, few = search._few(np.arange(len(x)), x, 6)
        got = {(int(a), int(b), float(c)) for part in search._Part(own, few).best(np.arange(len(q)), q, 6) for a, b, c in zip(*part)}
        assert {(a, b, round(c, 8)) for a, b, c in got} == {(int(a), int(b), round(float(c), 8)) for a, b, c in want}


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    asked = []
    real = search.search
    monkeypatch.setattr(engine.S, "search", lambda base, queries, k: asked.append(queries.count()) or real(base, queries, k))
    texts = [f"The {w} pier opens in June." for w in ("north", "south", "west")]
    chunks = spark.createDataFrame([(k, f"n{k}.md", "#a", None, None, t) for k, t in enumerate(texts)], "chunk_id long, path string, anchor string, block_id string, heading_path string, text string")
    answers = spark.createDataFrame(list(enumerate(texts)), "answer_id long, text string")
    got = engine.verify(answers, FixedEmbedder().embed(chunks), FixedEmbedder(), LexicalJudge()).collect()
    assert asked == [1] and [r["n_claims"] for r in got] == [1, 1, 1]
