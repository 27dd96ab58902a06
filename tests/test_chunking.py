from pyspark.sql import functions as F

from factloom.operators.chunking import chunk_notes, link_table, split_oversize

NOTE = (
    "---\ndate: 2031-04-02\n---\n# Harbour\n\nThree berths, one crane.\n\n## Berths\n\nBerth two is closed for repair. ^b2\n\n"
    "Ask [[People/Ines|the harbour master]] first.\n\n## Crane\n\n```\n# turn off\nlift(3)\n```\n\n* hook\n* chain\n"
)


def chunks(spark, **notes):
    made = chunk_notes(spark.createDataFrame(list(notes.items()), "path string, content string"))
    return made.orderBy("path", "ordinal").collect()


def test_note(spark):
    want = [
        ("Three berths, one crane.", "Harbour", None, "#Harbour", []),
        ("Berth two is closed for repair. ^b2", "Harbour > Berths", "b2", "#^b2", []),
        ("Ask [[People/Ines|the harbour master]] first.", "Harbour > Berths", None, "#Berths", [("People/Ines", None, "the harbour master")]),
        ("```\n# turn off\nlift(3)\n```", "Harbour > Crane", None, "#Crane", []),
        ("* hook\n* chain", "Harbour > Crane", None, "#Crane", []),
    ]
    got = chunks(spark, a=NOTE)
    assert [(r["text"].rstrip("\n"), r["heading_path"], r["block_id"], r["anchor"], [tuple(w) for w in r["wikilinks"]]) for r in got] == want
    assert [(r["ordinal"], r["char_start"], r["token_est"]) for r in got] == [(k, NOTE.index(w[0]), -(-len(r["text"]) // 4)) for k, (w, r) in enumerate(zip(want, got))]


def test_offsets_are_the_text(spark):
    notes = {"a": NOTE, "b": "# H\n\n" + "word " * 500 + "\n", "c": "a\r\n\r\nb\r\n", "d": "é😀x\n\n| é |\n| - |\n| 😀 |\n", "e": "```\nopen\n\n| a |\n| b |", "f": "", "g": "\n \n"}
    for r in chunks(spark, **notes):
        assert notes[r["path"]][r["char_start"] : r["char_end"]] == r["text"] and len(r["text"]) <= 1000


def test_oversize(spark):
    got = chunks(spark, b="# H\n\n" + "word " * 500 + "\n")
    assert len(got) == 3 and [r["ordinal"] for r in got] == [0, 1, 2]
    pieces = lambda t: [(p["at"], len(p["text"])) for p in spark.createDataFrame([(t,)], "t string").select(split_oversize(F.col("t"))).first()[0]]
    assert pieces("x" * 2500) == [(0, 1000), (1000, 1000), (2000, 500)]
    assert pieces("a" * 600 + "\n" + "b" * 900)[0] == (0, 601)
    assert pieces("a" * 300 + "\n" + "b" * 300 + " " + "c" * 900)[0] == (0, 602)
    assert pieces("") == [] and pieces(" " * 1500) == []


def test_frontmatter(spark):
    got = chunks(spark, a="---\naliases: [moorings]\ntags: [x]\n---\n# A\n\nx\n", b="---\ntitle: x\n---\ny\n", c="---\n---\ny\n")
    assert [(r["path"], r["anchor"]) for r in got] == [("a", "#L0"), ("a", "#A"), ("b", "#L0"), ("c", "#L0")]
    assert "moorings" in got[0]["text"] and got[0]["char_start"] == 0


def test_table(spark):
    got = chunks(spark, a="# T\n\n| Berth | Depth |\n| --- | --- |\n| Two | 9 m |\n^gone\n")
    assert [(r["text"], r["anchor"]) for r in got] == [("| Berth | Depth |", "#T"), ("| Two | 9 m |", "#T")]


def test_headings(spark):
    got = chunks(spark, a="# A\n\nx\n\n### C\n\ny\n\n## B\n\nz\n\n# D\n\nw\n\n~~~\n# no\n```\n\nq\n")
    assert [r["heading_path"] for r in got] == ["A", "A > C", "A > B", "D", "D", "D"]


def test_links(spark):
    made = chunk_notes(spark.createDataFrame([("a", "[[x]] [[ y #h|z]] ![[im]] [[#own]] [[ ]]")], "path string, content string"))
    assert [tuple(r)[2:] for r in link_table(made).collect()] == [("x", None, None), ("y", "#h", "z"), ("im", None, None)]
