"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Each source's documents form blocks of `block_docs` in the order of md5(doc_id).
With whole weights w that add up to W, block b of a source may not run before slot
floor(b * W / w) and must run before slot ceil((b + 1) * W / w). Earliest deadline
first among the released blocks fills every slot. As each block runs in its window,
at any slot t each source has run between w * t / W - 1 and w * t / W + 1 blocks:
windows follow from the weights themselves, so no error adds up.

The slots are worked out in frames, each by itself, of twice the longest window W / w, so
that no window meets two edges, and of `frame` slots at least; where that passes the last
slot there is one frame. At the edge T of a frame a source has run floor(w * T / W) blocks
for certain; the block behind them may lie on either side. The blocks that go before T are taken by earliest deadline, as long
as all of them and all certain ones fit between their releases and T: among all sets
that fit this one has the most blocks due up to any later slot, so both frames can be
filled. Within a frame the schedule is a fold over its slots in SQL. Frames are rows,
dealt out over the tasks; the work is slots times sources, with at most SOURCES sources,
and one task's part of it grows with the inverse of the smallest weight.

The number of a document within its source comes from counts by md5 prefix and row
numbers within a prefix, so that a source with a third of all rows is ranked in many
tasks. The documents of one prefix hold consecutive blocks, so their slots reach them
as one array a prefix, without another shuffle of the documents.

No row is dropped. The horizon is the first slot whose block is missing or not full: up
to it the mix follows the weights, and `in_mix` is true. Slots are scheduled up to it;
rows behind it get the last slot of their window, which several sources may share, so
they follow by deadline, source and position.

Defined cases: a null source is the source ''; a null doc_id sorts by the digest of
''; repeated rows are rows of their own; sources without a positive weight, if
weights are given, get no slot (null) and in_mix false; weights of sources without
documents do not count; an empty table gives an empty result; other columns travel as
they are (very long texts are moved once by mix() and once by in_order()), but for those
with names of output columns.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm._shared import keep, table

FRAME = 1000
SOURCES = 5000
BLOCK_DOCS = 8
_OUT = ("block", "pos", "slot", "release", "deadline", "in_mix")


def whole_weights(weights: dict[str, float]) -> list[tuple[str, int]]:
    """Positive weights as whole numbers in the same proportion: exact for fractions of denominators up to 100,000, else to 15 digits."""
    parts = {k: Fraction(v).limit_denominator(100_000) for k, v in weights.items() if v > 0}
    if any(abs(float(parts[k]) - v) > 1e-15 * v for k, v in weights.items() if v > 0) or math.lcm(*(x.denominator for x in parts.values())) > 10**15:
        return [(k, max(1, round(v / sum(weights.values()) * 10**15))) for k, v in weights.items() if v > 0]
    scale = math.lcm(*(x.denominator for x in parts.values()))
    return [(k, int(x * scale)) for k, x in parts.items()]


def _run_before(edge: str) -> str:
    """SQL: how many blocks of each source of s (source, n, w; total: their w) run before slot `edge`, a whole number."""
    parts = f"""transform(s, (x, i) -> struct(i AS i, x.w AS w, cast(x.w * {edge} div total AS decimal(19,0)) AS b, x.w * {edge} % total > 0 AS cut))"""
    windows = f"""transform({parts}, x -> struct(x.i AS i, x.w AS w, x.b AS b, x.cut AS cut, cast(x.b * total div x.w AS decimal(19,0)) AS r, cast(((x.b + 1) * total + x.w - 1) div x.w AS decimal(19,0)) AS d))"""
    # room between each release and the edge, besides the blocks that run before the edge for certain
    room = f"""transform(array_distinct(transform(open, x -> x.r)), r -> struct(r AS r, aggregate(p, cast({edge} - r AS bigint), (a, y) -> a - greatest(0L, cast(y.b AS bigint) - (r * y.w + total - 1) div total)) AS left))"""
    chosen = f"""aggregate(array_sort(transform(open, x -> struct(x.d AS d, x.i AS i, x.r AS r))), struct({room} AS room, cast(array() AS array<int>) AS took),
        (acc, x) -> if(size(acc.took) < need AND forall(acc.room, y -> y.r > x.r OR y.left > 0),
            struct(transform(acc.room, y -> struct(y.r AS r, y.left - if(y.r <= x.r, 1L, 0L) AS left)) AS room, concat(acc.took, array(x.i)) AS took), acc)).took"""
    need = f"cast({edge} AS bigint) - aggregate(p, 0L, (a, y) -> a + cast(y.b AS bigint))"
    return f"""transform(array({windows}), p -> transform(array(filter(p, x -> x.cut)), open -> transform(array({need}), need -> transform(array({chosen}),
        took -> transform(p, x -> cast(x.b AS bigint) + if(array_contains(took, x.i), 1L, 0L))))))[0][0][0][0]"""


def schedule(shares: DataFrame, slots: DataFrame, frame: int) -> DataFrame:
    """(slot, source, block) of the slots up to `slots` (one row, one number) for shares (source, w), by earliest deadline first; frames are multiples of `frame`."""
    one = shares.agg(F.array_sort(F.collect_list(F.struct("source", F.col("w").cast("decimal(19,0)").alias("w")))).alias("s"), F.sum("w").cast("decimal(19,0)").alias("total"), F.min("w").cast("decimal(19,0)").alias("least"))
    one = one.where(F.size("s") > 0).join(slots.select(F.col(slots.columns[0]).alias("slots")))
    one = one.withColumn("chunks", F.expr(f"least(2 * (total div least + 1), slots) div {frame} + 1")).withColumn("len", F.expr(f"chunks * {frame}L"))
    edges = one.select("s", "total", "chunks", "len", F.explode(F.expr("sequence(0L, slots div len)")).alias("f")).repartition("f")
    edge = lambda k: f"cast((f + {k}) * len AS decimal(19,0))"
    # the blocks of each source in this frame, with their windows as slots of the frame
    jobs = """transform(s, (x, i) -> if(q2[i] > q[i], transform(sequence(q[i], q2[i] - 1), b -> struct(
        cast(greatest(0L, cast(b AS decimal(19,0)) * total div x.w - f * len) AS int) AS r,
        cast(least(len, (cast(b + 1 AS decimal(19,0)) * total + x.w - 1) div x.w - f * len) AS int) AS d)), cast(array() AS array<struct<r: int, d: int>>)))"""
    due = "transform(jobs, (j, i) -> if(acc.next[i] < size(j), if(j[acc.next[i]].r <= t, struct(j[acc.next[i]].d AS d, i AS i), null), null))"
    step = "struct(transform(acc.next, (n, i) -> if(i = pick, n + 1, n)) AS next, concat(acc.picked, array(pick)) AS picked)"
    # slots are picked in chunks, so that the list that grows slot by slot stays short
    chunk = f"""aggregate(sequence(c * {frame}, (c + 1) * {frame} - 1), struct(run.next AS next, cast(array() AS array<int>) AS picked),
        (acc, t) -> transform(array(array_min({due}).i), pick -> {step})[0])"""
    fold = f"""aggregate(sequence(0, cast(chunks - 1 AS int)), struct(transform(jobs, j -> 0) AS next, cast(array() AS array<array<int>>) AS picked),
        (run, c) -> transform(array({chunk}), x -> struct(x.next AS next, concat(run.picked, array(x.picked)) AS picked))[0], run -> flatten(run.picked))"""
    # what a fold reads is bound to variables, as Spark would else put its expression into the fold's steps
    bound = f"""transform(array({_run_before("a")}), q -> transform(array({_run_before("z")}), q2 -> transform(array({jobs}), jobs -> struct(q AS q, {fold} AS picked))))[0][0][0]"""
    bound = f"transform(array({edge(0)}), a -> transform(array({edge(1)}), z -> {bound}))[0][0]"
    picked = edges.select("s", "f", "len", F.expr(bound).alias("x")).select("s", "f", "len", "x.q", F.posexplode("x.picked").alias("at", "i"))
    slots_ = picked.select("f", F.expr("f * len + at").alias("slot"), F.expr("s[i].source").alias("source"), F.expr("q[i]").alias("first"))
    number = F.row_number().over(Window.partitionBy("f", "source").orderBy("slot")) - 1
    return slots_.withColumn("block", F.col("first") + number).select("slot", "source", "block")


def mix(docs: DataFrame, weights: dict[str, float] | DataFrame | None = None, block_docs: int = BLOCK_DOCS, frame: int = FRAME) -> DataFrame:
    """docs with block, pos, slot, release, deadline and in_mix; (slot, source, pos) is the order of the mix.

    weights: by source, or a table (source, w) of whole numbers; by default the square root of the number of documents.
    """
    others = [c for c in docs.columns if c not in _OUT]
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    name = F.coalesce(F.col("source"), F.lit(""))
    # other columns travel as one, so that their names cannot meet those used here
    rows = docs.select(F.struct(*others).alias("__row"), name.alias("__source"), digest.alias("__md5"), F.col("doc_id").alias("__id"))
    counts = keep(docs.groupBy(name.alias("source")).agg(F.count("*").alias("n")))
    n, sources = counts.agg(F.sum("n"), F.count("*")).first()
    if sources > SOURCES:
        raise ValueError(f"{sources} sources; at most {SOURCES} can be mixed")
    if weights is None:
        weights = default_weights(counts)
    elif isinstance(weights, dict):
        weights = docs.sparkSession.createDataFrame(whole_weights(weights), "source string, w bigint")
    shares = counts.join(F.broadcast(weights.where("w > 0")), "source")
    shares = shares.withColumn("total", F.sum("w").over(Window.partitionBy()))
    window = lambda b: (f"cast({b} AS decimal(19,0)) * cast(total AS decimal(19,0)) div cast(w AS decimal(19,0))", f"(cast({b} + 1 AS decimal(19,0)) * cast(total AS decimal(19,0)) + w - 1) div cast(w AS decimal(19,0))")
    # the first block of each source that is missing or not full runs before the end of its window
    gaps = shares.withColumn("gap", F.expr(f"n div {block_docs}"))
    slots = keep(schedule(shares, gaps.agg(F.min(F.expr(window("gap")[1])).alias("slots")), frame))
    horizon = slots.join(F.broadcast(gaps.select("source", F.col("gap").alias("block"))), ["source", "block"]).agg(F.min("slot").alias("horizon"))

    digits = max(1, math.ceil(math.log(max(1.0, (n or 0) / max(2000.0, math.sqrt(n or 0))), 16)))
    rows = rows.withColumn("__prefix", F.substring("__md5", 1, digits))
    by_prefix = docs.groupBy(name.alias("source"), F.substring(digest, 1, digits).alias("prefix")).agg(F.count("*").alias("m"))
    before = by_prefix.withColumn("before", F.sum("m").over(Window.partitionBy("source").orderBy("prefix")) - F.col("m"))
    # the slots of the blocks that the rows of one prefix lie in, as an array
    held = before.select("source", "prefix", F.expr(f"before div {block_docs}").alias("b0"), F.explode(F.expr(f"sequence(before div {block_docs}, (before + m - 1) div {block_docs})")).alias("block"))
    placed = held.join(slots, ["source", "block"]).groupBy("source", "prefix").agg(F.map_from_entries(F.collect_list(F.struct((F.col("block") - F.col("b0")).cast("int"), "slot"))).alias("__slots"))
    own = before.join(shares.select("source", "w", "total"), "source", "left").join(placed, ["source", "prefix"], "left")
    own = own.select(F.col("source").alias("__source"), F.col("prefix").alias("__prefix"), F.col("before").alias("__before"), F.col("w").alias("__w"), F.col("total").alias("__total"), "__slots")
    in_prefix = F.row_number().over(Window.partitionBy("__source", "__prefix").orderBy("__md5", "__id")) - 1
    ranked = rows.withColumn("__n", in_prefix).join(own, ["__source", "__prefix"]).join(F.broadcast(horizon.select(F.col("horizon").alias("__horizon"))))
    ranked = ranked.select("__row", F.col("__before").alias("before"), (F.col("__before") + F.col("__n")).alias("rank"), F.col("__w").alias("w"), F.col("__total").alias("total"), F.col("__slots").alias("slots"), F.col("__horizon").alias("horizon"))
    blocks = ranked.withColumns({"block": F.expr(f"rank div {block_docs}"), "pos": F.expr(f"cast(rank % {block_docs} AS int)")})
    run = F.expr(f"slots[cast(block - before div {block_docs} AS int)]")
    blocks = blocks.withColumns({"release": F.expr(window("block")[0]), "deadline": F.expr(window("block")[1]), "run": run})
    in_mix = F.coalesce(F.col("run") < F.col("horizon"), F.lit(False))
    blocks = blocks.withColumn("in_mix", in_mix).withColumn("slot", F.when(F.col("in_mix"), F.col("run")).otherwise(F.col("deadline") - 1))
    return blocks.select("__row.*", *_OUT)


def default_weights(counts: DataFrame) -> DataFrame:
    """(source, w) for counts (source, n): the square root of n, so that large sources count for more, but not in proportion."""
    return counts.select("source", F.floor(F.sqrt("n") * 1_000_000).cast("bigint").alias("w"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of mix() in the order of their slots, over all partitions; rows without a slot come last."""
    order = [F.col("slot").asc_nulls_last(), F.coalesce(F.col("source"), F.lit("")).asc(), F.col("pos").asc()]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def op2_weights(counts: DataFrame) -> DataFrame:
    """The registered query's target weights: default_weights() times 1 to 4 by the last character of the source's name."""
    factor = F.when(F.col("source") == "", F.lit(1)).otherwise(1 + F.ascii(F.expr("right(source, 1)")) % 4)
    return default_weights(counts).withColumn("w", F.col("w") * factor)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, op2_weights(docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))))


#: Earliest deadline first over windows worked out from the weights, slot by slot from the first one on.
OP2_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, source, coalesce(source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
counts AS (SELECT s, count(*) AS n, CAST(floor(sqrt(count(*)) * 1000000) AS HUGEINT) * CASE WHEN s = '' THEN 1 ELSE 1 + ascii(right(s, 1)) % 4 END AS w FROM docs GROUP BY s),
shares AS (SELECT s, n, w, sum(w) OVER () AS total, n // {BLOCK_DOCS} AS gap FROM counts),
lists AS (SELECT list(w ORDER BY s) AS ws, list(s ORDER BY s) AS names, CAST(max(total) AS HUGEINT) AS total, min(((gap + 1) * total + w - 1) // w) AS slots FROM shares),
edf AS (
    SELECT CAST(0 AS BIGINT) AS t, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS nxt, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS BIGINT) AS block FROM lists
    UNION ALL
    SELECT t + 1, list_transform(range(1, len(ws) + 1), lambda i: nxt[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p, nxt[p]
    FROM (SELECT edf.t, edf.nxt, lists.ws,
            CAST(list_sort(list_filter(list_transform(range(1, len(ws) + 1), lambda i:
                CASE WHEN nxt[i] * total // ws[i] <= t THEN (((nxt[i] + 1) * total + ws[i] - 1) // ws[i]) * 100000 + i END), lambda y: y IS NOT NULL))[1] % 100000 AS BIGINT) AS p
          FROM edf, lists WHERE t < slots)
),
run AS (SELECT t - 1 AS slot, names[pick] AS s, block FROM edf, lists WHERE pick IS NOT NULL),
horizon AS (SELECT min(slot) AS g FROM run JOIN shares ON run.s = shares.s AND run.block = shares.gap),
ranked AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 1 AS r FROM docs),
blocks AS (SELECT doc_id, source, s, r // {BLOCK_DOCS} AS block, r % {BLOCK_DOCS} AS pos FROM ranked),
placed AS (SELECT blocks.*, CAST(blocks.block * total // w AS BIGINT) AS "release", CAST(((blocks.block + 1) * total + w - 1) // w AS BIGINT) AS deadline, coalesce(run.slot < g, false) AS in_mix, run.slot AS spot
    FROM blocks JOIN shares ON shares.s = blocks.s LEFT JOIN run ON run.s = blocks.s AND run.block = blocks.block, horizon)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN in_mix THEN spot ELSE deadline - 1 END AS BIGINT) AS slot, "release", deadline, in_mix FROM placed
"""
