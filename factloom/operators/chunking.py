"""Notes to chunks, the units of citation.

A note is worked on within its row: one Arrow pass finds its lines and blocks, in time
linear in its length, and column expressions do the rest, so nothing is shuffled. Offsets
are code points, so substring(content, char_start + 1, char_end - char_start) is the
text of every chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import SPACE, is_blank, last_index, let, trim, trim_end

MAX_CHARS = 1000

# The patterns of the note format.
FRONTMATTER = r"\A---\r?\n[\s\S]*?\r?\n---\r?\n?"
FRONTMATTER_KEYS = r"(?i)(\A|\n)(aliases|tags)\s*:"
FENCE = r"\A\s*(```|~~~)"
HEADING = r"\A(#{1,6})\s+(.*\S)\s*\z"
PIPE = r"\A\s*\|"
TABLE_SEPARATOR = r"\A\s*\|[\s:|-]+\|?\s*\z"
BLOCK_ID = r"(?:\A|\s)\^([A-Za-z0-9-]+)\z"
WIKILINK = r"\[\[([^\]|#]+)(#[^\]|]+)?(\|[^\]]+)?\]\]"


def frontmatter(content: Column) -> Column:
    """The frontmatter block in front of a note, or ''."""
    return F.regexp_extract(content, FRONTMATTER, 0)


# the same patterns for the Arrow pass; "." stops at the line ends that it stops at in the JVM
_FENCE = re.compile(FENCE, re.ASCII)
_HEADING = re.compile(HEADING.replace(".*", r"[^\n\r\u0085\u2028\u2029]*").replace(r"\z", r"\Z"), re.ASCII)
_FULL = re.compile("[^" + re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", SPACE) + "]", re.ASCII)
_LINE = ("i", "at", "line", "marker", "in_fence", "level", "outside", "block", "headings")
_LINE_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.string()))
_STRUCTURE = "i int, at int, line string, marker boolean, in_fence boolean, level int, outside boolean, block int, headings array<string>"
_BLOCKS = "array<struct<block: int, headings: array<string>, lines: array<struct<i: int, at: int, line: string>>>>"
_BLOCKS_ARROW = pa.list_(pa.struct([("block", pa.int32()), ("headings", pa.list_(pa.string())), ("lines", pa.list_(pa.struct([("i", pa.int32()), ("at", pa.int32()), ("line", pa.string())])))]))


def _lines(body: str, at: int) -> Iterator[tuple]:
    """The lines of a note's body, which begins at `at`, as _LINE: fences, headings, blocks and the headings in force."""
    fenced, closed, block, active = False, True, 0, {}
    for i, line in enumerate(body.split("\n")):
        marker = _FENCE.match(line) is not None
        fenced ^= marker
        inside = fenced and not marker
        heading = None if marker or inside else _HEADING.match(line)
        level = len(heading[1]) if heading else 0
        outside = level > 0 or not (marker or inside or _FULL.search(line))
        block += (marker and fenced) or closed
        closed = outside or (marker and not fenced)
        if level:  # ends all headings of its level and below
            active = {k: t for k, t in active.items() if k < level} | {level: heading[2]}
        yield i, at, line, marker, inside, level, outside, block, list(active.values())
        at += len(line) + 1


def _bodies(notes: DataFrame) -> DataFrame:
    """(path, front, body): the frontmatter and what is behind it."""
    front = notes.select("path", frontmatter(F.col("content")).alias("front"), "content")
    return front.select("path", "front", F.expr("substr(content, length(front) + 1)").alias("body"))


def structure(notes: DataFrame) -> DataFrame:
    """A row a line behind the frontmatter: its number, its place in the note, and _lines()."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "front", "body")]
            rows = [(path, *x) for path, front, body in zip(*columns) if body is not None for x in _lines(body, len(front))]
            kinds = (batch.column("path").type, *_LINE_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", *_LINE])

    return _bodies(notes).mapInArrow(run, T.StructType([notes.schema["path"], *T._parse_datatype_string(_STRUCTURE).fields]))


def note_blocks(notes: DataFrame) -> DataFrame:
    """(path, front, blocks): of each note its blocks that are not blank, in order, with their lines and the headings in force."""

    def of_note(front, body):
        out: list[dict] = []
        for i, at, line, _, _, _, outside, block, headings in _lines(body, len(front)):
            if outside:
                continue
            if not out or out[-1]["block"] != block:
                out.append({"block": block, "headings": headings, "lines": []})
            out[-1]["lines"].append({"i": i, "at": at, "line": line})
        return [x for x in out if any(_FULL.search(y["line"]) for y in x["lines"])]

    def run(batches):
        for batch in batches:
            fronts, bodies = (batch.column(c).to_pylist() for c in ("front", "body"))
            found = [of_note(f, b) if b is not None else [] for f, b in zip(fronts, bodies)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("front"), pa.array(found, _BLOCKS_ARROW)], ["path", "front", "blocks"])

    schema = T.StructType([notes.schema["path"], T.StructField("front", T.StringType()), T.StructField("blocks", T._parse_datatype_string(_BLOCKS))])
    return _bodies(notes).mapInArrow(run, schema)


def blocks(notes: DataFrame) -> DataFrame:
    """(path, block, headings, lines): a row a block."""
    return note_blocks(notes).select("path", F.explode("blocks").alias("b")).select("path", "b.*")


def is_table(block_lines: Column) -> Column:
    """At least two non-blank lines, of which all but one at most begin with a bar, and two at least do."""
    full = F.size(F.filter(block_lines, lambda x: ~is_blank(x["line"])))
    pipes = F.size(F.filter(block_lines, lambda x: x["line"].rlike(PIPE)))
    return (full >= 2) & (pipes >= 2) & (pipes >= full - 1)


def split_oversize(text: Column, limit: int = MAX_CHARS) -> Column:
    """Pieces (at, text) of at most `limit` characters: cut behind the last line break if it lies past the middle, else behind the last space, else hard."""

    def cut(window: Column) -> Column:
        line = last_index(window, "\n")
        return let(F.when(line > limit // 2, line).otherwise(last_index(window, " ")), lambda b: F.when(b > 0, b + 1).otherwise(F.lit(limit)))

    def step(state: Column, _: Column) -> Column:
        def add(size: Column) -> Column:
            piece = F.struct(state["at"].alias("at"), state["rest"].substr(F.lit(1), size).alias("text"))
            return F.struct((state["at"] + size).alias("at"), state["rest"].substr(size + 1, F.length(state["rest"])).alias("rest"), F.concat(state["pieces"], F.array(piece)).alias("pieces"))

        whole = F.length(state["rest"]) <= limit
        size = F.when(whole, F.length(state["rest"])).otherwise(cut(state["rest"].substr(F.lit(1), F.lit(limit))))
        return F.when(state["rest"] == "", state).otherwise(let(size, add))

    turns = F.sequence(F.lit(1), 2 * F.ceil(F.length(text) / limit).cast("int") + 1)
    start = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.array().cast("array<struct<at: int, text: string>>").alias("pieces"))
    return F.filter(F.aggregate(turns, start, step, lambda s: s["pieces"]), lambda p: ~is_blank(p["text"]))


def block_pieces(block_lines: Column) -> Column:
    """The pieces (at, text) of one block: table rows, or its text, split if it is too long."""
    rows = F.filter(block_lines, lambda x: x["line"].rlike(PIPE) & ~x["line"].rlike(TABLE_SEPARATOR))
    start = block_lines[0]["at"]
    text = F.array_join(F.transform(block_lines, lambda x: x["line"]), "\n")
    as_text = let(start, lambda at: F.transform(split_oversize(text), lambda p: F.struct((at + p["at"]).alias("at"), p["text"].alias("text"))))
    return F.when(is_table(block_lines), F.transform(rows, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("text")))).otherwise(as_text)


def block_id(text: Column) -> Column:
    """The id behind ^ at the end of the last line that is not blank, or null."""
    return F.nullif(F.regexp_extract(trim_end(text), BLOCK_ID, 1), F.lit(""))


def wikilinks(text: Column) -> Column:
    """(target_note, target_anchor, alias) of the links of a text."""

    def parts(m: Column) -> Column:
        group = lambda k: F.nullif(F.regexp_extract(m, WIKILINK, k), F.lit(""))
        return F.struct(trim(F.regexp_extract(m, WIKILINK, 1)).alias("target_note"), group(2).alias("target_anchor"), group(3).substr(F.lit(2), F.length(m)).alias("alias"))

    found = F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(0)), parts)
    return F.filter(found, lambda x: x["target_note"] != "")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def chunk_notes(notes: DataFrame) -> DataFrame:
    """Chunks of notes (path, content): path, ordinal, heading_path, block_id, anchor, char_start, char_end, text, token_est, wikilinks."""
    none = F.array().cast("array<struct<at: int, text: string, headings: array<string>>>")
    front = F.struct(F.lit(0).alias("at"), F.col("front").alias("text"), F.array().cast("array<string>").alias("headings"))
    head = F.when(F.col("front").rlike(FRONTMATTER_KEYS), F.array(front)).otherwise(none)
    body = F.transform("blocks", lambda b: F.transform(block_pieces(b["lines"]), lambda p: F.struct(p["at"].alias("at"), p["text"].alias("text"), b["headings"].alias("headings"))))
    pieces = note_blocks(notes).select("path", F.posexplode(F.concat(head, F.flatten(body))).alias("ordinal", "p"))
    chunks = pieces.select("path", "ordinal", F.col("p.at").alias("char_start"), "p.text", "p.headings").withColumn("block_id", block_id(F.col("text")))
    anchor = F.coalesce(F.concat(F.lit("#^"), "block_id"), F.concat(F.lit("#"), F.try_element_at("headings", F.lit(-1))), F.concat(F.lit("#L"), F.col("ordinal").cast("string")))
    return chunks.select(
        "path", "ordinal", F.when(F.size("headings") > 0, F.array_join("headings", " > ")).alias("heading_path"), "block_id", anchor.alias("anchor"),
        "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "text", token_estimate(F.col("text")).alias("token_est"), wikilinks(F.col("text")).alias("wikilinks"),
    )


def link_table(chunks: DataFrame) -> DataFrame:
    """(path, ordinal, target_note, target_anchor, alias): a row a link."""
    return chunks.select("path", "ordinal", F.explode("wikilinks").alias("w")).select("path", "ordinal", "w.*")
