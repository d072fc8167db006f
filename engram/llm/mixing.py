"""Mixing sources to target weights (operator 1); DataFrame functions only.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating; all targets together are all
words; no target exceeds ``CAP`` times its source's words, and what is cut off is shared by weight among
the others (the level at which the shares come out is found with running sums over the sources).

Blocks: the documents of a source are in the order of a hash of their id, and equal ranges of the hash
are the source's permuted blocks; their number follows the source's rows, ``BLOCKS`` over all sources.
A source's target fixes its quota of block draws exactly: whole passes over all its blocks, then blocks
from the front until the target is reached; the last block gives documents from its front, and the last
document the words that are still missing.

Splitting tree: the root holds every source's quota.  A node gives half of its draws to its left child; how many
of each source go there is a multivariate hypergeometric draw, made of one hypergeometric count a source by
inversion from a hash of node and source (``HYPERGEOMETRIC``: weights from the mode outwards, all values but those
beyond ``REACH`` standard deviations).  Sources are dealt to groups of ``GROUP``: one tree splits the groups' quotas,
then every group splits its own within the sizes that this gave it, so no array grows with the sources.  A leaf is an
output shard with its quota of every source.  The quotas of the leaves, one after the other, cut the permuted draws
of a source into disjoint runs; draw k is block k modulo the number of blocks, in its pass k div that number.  What a
document gives to the mix (``taken``) is what these draws take.  The tree handles draws (at most about ``CAP + 1``
per block), never documents.  Documents follow their block's draws, and every shard is shuffled on its own.

Defined results: null texts have size 0; a source without words has the target 0; rows that repeat an
id are separate documents next to each other in the order, each at its own place; rows without an id are ordered by
their text; very long texts are documents like others, the last one of a source is cut within; a table without rows
gives none; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparktools import bare, cut

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCKS = 4096
BLOCK_ROWS = 64
SHARDS = 32
#: Sources whose quotas one row of the tree holds; standard deviations that a count may lie from its mode.
GROUP, REACH = 512, 12
#: Plan tables of at most this many rows (a few MB) are broadcast; larger ones are joined by shuffle.
SMALL = 50_000
WORD = r"[^\\x20\\x09-\\x0D]+"


def word_count(text: str) -> Column:
    return F.expr(f"CAST(regexp_count(coalesce(`{text}`, ''), '{WORD}') AS BIGINT)")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sid, source, rows, source_size, target from one row (source, size, rows) per source."""
    weight = "CASE pmod(sid - 1, {n}) {cases} END".format(n=len(weights), cases=" ".join(f"WHEN {i} THEN {w}L" for i, w in enumerate(weights)))
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", F.expr(weight))
    # sources by the level at which they are full; below it they are capped
    before = Window.orderBy(F.expr(f"{cap} * source_size / weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("full", F.coalesce(F.sum(F.expr(f"{cap} * source_size")).over(before), F.lit(0)))
        .withColumn("left_weight", F.expr("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.expr("(total - full) / left_weight"))
        .withColumn("holds", F.expr(f"level <= {cap} * source_size / weight"))
        .withColumn("level", F.min(F.when(F.col("holds"), F.struct("full", "level"))).over(everything)["level"])
    )
    return levels.select("sid", "source", "rows", "source_size", F.expr(f"least(CAST({cap} * source_size AS DOUBLE), level * weight)").alias("target"))


def _up(x: str) -> str:
    """Chance of x + 1 against that of x."""
    return f"((p.good - {x}) * (p.need - {x})) / ((CAST({x} AS DOUBLE) + 1) * (p.pool - p.good - p.need + {x} + 1))"


def _down(x: str) -> str:
    """Chance of x - 1 against that of x."""
    return f"(CAST({x} AS DOUBLE) * (p.pool - p.good - p.need + {x})) / ((p.good - {x} + 1) * (p.need - {x} + 1))"


def hypergeometric(good: str, pool: str, need: str, chance: str) -> str:
    """SQL: how many of ``need`` draws from ``pool`` fall on its ``good`` ones, the value at which the cumulated chance reaches ``chance``."""
    low, high = f"greatest(0L, {need} + {good} - {pool})", f"least({good}, {need})"
    spread = f"sqrt(CAST({need} AS DOUBLE) * {good} / {pool} * ({pool} - {good}) / {pool} * ({pool} - {need}) / greatest(1L, {pool} - 1))"
    mode = f"least({high}, greatest({low}, CAST(floor((CAST({need} AS DOUBLE) + 1) * ({good} + 1) / ({pool} + 2)) AS BIGINT)))"
    given = f"named_struct('good', {good}, 'pool', {pool}, 'need', {need}, 'low', {low}, 'high', {high}, 'mode', {mode}, 'reach', CAST({REACH} * {spread} + {REACH} AS BIGINT), 'u', {chance})"
    upward, downward = "sequence(p.mode, least(p.high, p.mode + p.reach))", "sequence(p.mode, greatest(p.low, p.mode - p.reach), -1L)"
    total = (
        f"aggregate({upward}, named_struct('w', 1D, 't', 0D), (s, x) -> named_struct('w', s.w * ({_up('x')}), 't', s.t + s.w), s -> s.t)"
        f" + aggregate({downward}, named_struct('w', 1D, 't', 0D), (s, x) -> named_struct('w', s.w * ({_down('x')}), 't', s.t + s.w * ({_down('x')})), s -> s.t)"
    )
    start = f"named_struct('w', 1D, 'left', p.u * ({total}), 'found', -1L)"
    up = f"aggregate({upward}, {start}, (s, x) -> named_struct('w', s.w * ({_up('x')}), 'left', s.left - s.w, 'found', if(s.found < 0 AND s.left < s.w, x, s.found)))"
    walk = (
        f"aggregate({downward}, named_struct('w', 1D, 'left', q.left, 'found', q.found),"
        f" (s, x) -> named_struct('w', s.w * ({_down('x')}), 'left', s.left - s.w * ({_down('x')}), 'found', if(s.found < 0 AND s.left < s.w * ({_down('x')}), x - 1, s.found)), s -> if(s.found < 0, p.mode, s.found))"
    )
    inner = f"transform(array({up}), q -> {walk})[0]"
    return f"if({pool} <= 0 OR {need} <= 0 OR {good} <= 0, 0L, transform(array({given}), p -> {inner})[0])"


def _split_levels(nodes: DataFrame, shards: int, seed: str) -> DataFrame:
    """Splits rows (own, node 0, quotas: array<struct<name, n>>, sizes: map of node to draws that go left) down to ``shards`` leaves.

    ``sizes`` null means half of a node's draws, the odd one by a hash.
    """
    total = "aggregate(quotas, 0L, (n, x) -> n + x.n)"
    half = f"({total} DIV 2 + ({total} % 2) * pmod(xxhash64('{seed}', level, node), 2L))"
    chance = f"(pmod(xxhash64('{seed}', s.level, s.node, x.name), 9007199254740992L) + 0.5D) / 9007199254740992D"
    draw = hypergeometric("x.n", "s.pool", "s.need", chance)
    merge = f"(s, x) -> transform(array({draw}), k -> named_struct('level', s.level, 'node', s.node, 'pool', s.pool - x.n, 'need', s.need - k, 'left', concat(s.left, array(k))))[0]"
    for level in range(max(0, shards.bit_length() - 1)):
        nodes = nodes.withColumn("level", F.lit(level)).withColumn("need", F.expr(f"coalesce(sizes[concat(level, '/', node)], {half})"))
        nodes = nodes.withColumn("left", F.expr(f"aggregate(quotas, named_struct('level', level, 'node', node, 'pool', {total}, 'need', need, 'left', CAST(array() AS ARRAY<BIGINT>)), {merge}, s -> s.left)"))
        sides = "array(named_struct('node', 2 * node, 'quotas', zip_with(quotas, left, (x, k) -> named_struct('name', x.name, 'n', k))), named_struct('node', 2 * node + 1, 'quotas', zip_with(quotas, left, (x, k) -> named_struct('name', x.name, 'n', x.n - k))))"
        nodes = nodes.withColumn("side", F.explode(F.expr(sides))).select("own", "sizes", F.col("side.node").alias("node"), F.col("side.quotas").alias("quotas"))
    return nodes


def split_quotas(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """(sid, shard, n, start): the leaves of the splitting tree of (sid, quota); ``start`` is the source's draws in earlier shards.

    ``shards`` is a power of two.
    """
    levels = max(0, shards.bit_length() - 1)
    grouped = cut(quotas.where("quota > 0").select("sid", "quota", F.expr(f"CAST((sid - 1) DIV {GROUP} AS BIGINT)").alias("own")))
    packed = grouped.groupBy("own").agg(F.expr("array_sort(collect_list(named_struct('name', CAST(sid AS BIGINT), 'n', quota)))").alias("quotas"))
    # the groups' quotas: one row of a number per group
    root = grouped.groupBy("own").agg(F.sum("quota").alias("n")).agg(F.expr("array_sort(collect_list(named_struct('name', own, 'n', n)))").alias("quotas"))
    root = root.select(F.lit(-1).cast("long").alias("own"), F.lit(None).cast("map<string,bigint>").alias("sizes"), F.lit(0).cast("long").alias("node"), F.coalesce("quotas", F.expr("CAST(array() AS ARRAY<STRUCT<name: BIGINT, n: BIGINT>>)")).alias("quotas"))
    leaves = cut(_split_levels(root, shards, f"{seed}/groups")).select(F.col("node").alias("leaf"), F.explode("quotas").alias("q")).select("leaf", F.col("q.name").alias("own"), F.col("q.n").alias("n"))
    # what a node of any level sends to its left child is the sum over the leaves below that child
    sent = leaves.select("own", "n", F.posexplode(F.expr(f"transform(sequence(0, {max(levels - 1, 0)}), l -> leaf DIV shiftleft(1L, CAST({levels} - l - 1 AS INT)))")).alias("level", "child")) if levels else None
    if sent is not None:
        sizes = sent.groupBy("own", "level", F.expr("child DIV 2").alias("node")).agg(F.sum(F.when(F.col("child") % 2 == 0, F.col("n")).otherwise(0)).alias("need"))
        sizes = sizes.groupBy("own").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "level", "node"), "need"))).alias("sizes"))
        rows = packed.join(sizes, "own")
    else:
        rows = packed.withColumn("sizes", F.lit(None).cast("map<string,bigint>"))
    rows = _split_levels(rows.select("own", "sizes", F.lit(0).cast("long").alias("node"), "quotas"), shards, seed)
    leaf = cut(rows.select(F.col("node").cast("int").alias("shard"), F.explode("quotas").alias("q")).select(F.col("q.name").cast("int").alias("sid"), "shard", F.col("q.n").alias("n")))
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


class Plan:
    """What a mix takes: ``sources``, and one row per drawn block with its draws."""

    def __init__(self, sized: DataFrame, weights: tuple[int, ...], cap: int, shards: int, seed: str):
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        self.sources = cut(targets(sizes, weights, cap))
        self.n_sources = self.sources.count()
        rows = self.sources.agg(F.sum("rows")).head()[0] or 0
        per_block = max(BLOCK_ROWS, -(-rows // BLOCKS))
        self.by_source = self.sources.select(
            F.col("source").alias("__source"), "sid", "source_size", "target",
            F.ceil(F.col("rows") / per_block).cast("long").alias("n_blocks"),
            F.expr("CAST(floor(target + 0.5) AS BIGINT)").alias("goal"),
        )
        placed = self.place(sized)
        blocks = placed.groupBy("sid", "block", "source_size", "goal").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("sid").orderBy("block")
        blocks = (
            blocks.withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
            .withColumn("passes", F.expr("CASE WHEN source_size > 0 THEN goal DIV source_size ELSE 0 END"))
            .withColumn("rest", F.expr("goal - passes * source_size"))
            .withColumn("extra", F.expr("CASE WHEN before < rest THEN 1 ELSE 0 END"))
        )
        blocks = blocks.withColumn("nth", F.row_number().over(upto) - 1).withColumn("n_filled", F.count("*").over(Window.partitionBy("sid")))
        self.filled = cut(blocks)
        quotas = self.filled.groupBy("sid").agg(F.sum(F.expr("passes + extra")).alias("quota"))
        self.leaves = split_quotas(quotas, shards, seed)
        # a shard's run of the source's permuted draws; draw k is block k % n_filled in pass k DIV n_filled
        runs = self.leaves.where("n > 0").select("sid", "shard", F.explode(F.expr("sequence(start, start + n - 1)")).alias("k"))
        drawn = runs.join(_small(self.filled.select("sid", "n_filled").distinct(), self.n_sources), "sid")
        drawn = drawn.select("sid", "shard", F.expr("k DIV n_filled").alias("epoch"), F.expr("CAST(k % n_filled AS INT)").alias("nth"))
        # words of the block that this draw may take, from the block's front
        self.draws = cut(drawn.join(self.filled, ["sid", "nth"]).select("sid", "block", "epoch", "shard", "words", F.expr("CASE WHEN epoch < passes THEN words ELSE least(words, rest - before) END").alias("room")))
        packed = F.sort_array(F.collect_list(F.struct("epoch", "shard", F.when(F.col("room") < F.col("words"), F.col("room")).alias("room"))))
        self.blocks = self.draws.groupBy("sid", "block").agg(packed.alias("draws"))
        self.n_blocks = self.filled.count()

    def place(self, rows: DataFrame) -> DataFrame:
        """Adds the source's plan and the row's block; needs source and __order (hex digits of a hash)."""
        joined = rows.join(_small(self.by_source, self.n_sources), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        return joined.withColumn("block", F.expr("CAST(CAST(conv(substring(__order, 1, 8), 16, 10) AS BIGINT) * n_blocks DIV 4294967296 AS INT)"))

    def drawn(self, placed: DataFrame) -> DataFrame:
        """Adds each row's draws (null: none) and, in blocks that a draw cuts, the words before it in the block."""
        rows = placed.join(_small(self.blocks, self.n_blocks), ["sid", "block"], "left").withColumn("__cut", F.expr("exists(draws, d -> d.room IS NOT NULL)"))
        return rows


def order_key(key: str, text: str, seed: str) -> Column:
    """Hex digits by which a source's documents are permuted: those of the id, without an id those of the text."""
    own = F.coalesce(F.col(f"`{key}`").cast("string"), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))
    return F.sha2(F.concat(F.lit(f"{seed}|"), own).cast("binary"), 256)


#: Words that a draw takes of a document that has ``before`` words of its block before it.
TAKE = "CASE WHEN d.room IS NULL THEN size ELSE greatest(0L, least(size, d.room - before)) END"


def _with_before(rows: DataFrame) -> DataFrame:
    """Adds ``before`` to the rows of blocks that a draw cuts (one a source), each row at its own place."""
    in_block = Window.partitionBy("sid", "block").orderBy("__order", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("size").over(in_block), F.lit(0)))


def taken_words(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken, shards (of its draws)."""
    sized = cut(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(text).alias("size"), order_key(key, text, seed).alias("__order")))
    plan = Plan(sized, weights, cap, shards, seed)
    rows = plan.drawn(plan.place(sized))
    whole = rows.where("NOT coalesce(__cut, false)").withColumn("before", F.lit(0).cast("long"))
    both = whole.unionByName(_with_before(rows.where("coalesce(__cut, false)")))
    both = both.withColumn("taken", F.expr(f"coalesce(aggregate(draws, 0L, (n, d) -> n + {TAKE}), 0L)"))
    return both.select(F.col("doc_id").alias(key), "source", "size", "source_size", "target", "taken", F.expr(f"coalesce(transform(filter(draws, d -> {TAKE} > 0 OR size = 0), d -> d.shard), array())").alias("shards"))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """The mixed rows: all columns of ``docs``, then mix_shard, mix_epoch, mix_words (with ``_`` behind the name where ``docs`` has a column of that name).

    A document stands once for every draw that takes words of it, with whole text; mix_words says how
    many of its words the draw takes (fewer than all only for a source's last document).  Every output
    partition holds whole pieces of shards in shuffled order.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*columns).alias("__row"), F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(text).alias("size"), order_key(key, text, seed).alias("__order"))
    sized = cut(packed.drop("__row"))
    plan = Plan(sized, weights, cap, shards, seed)
    # places in the blocks that a draw cuts: of names that one row has, looked up; rows that share a name are ranked themselves
    places = cut(_with_before(plan.drawn(plan.place(sized)).where("__cut")).groupBy("sid", "block", "__order").agg(F.min("before").alias("before"), F.count("*").alias("__n")))
    n_places, shared = places.count(), places.where("__n > 1").limit(1).count()
    rows = plan.drawn(plan.place(packed)).join(_small(places, n_places), ["sid", "block", "__order"], "left")
    if shared:
        # copies of one name take the room from its place on, in the order of their sizes
        many = rows.where("__n > 1").withColumn("__base", F.col("before"))
        in_name = Window.partitionBy("sid", "block", "__order").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
        many = many.withColumn("before", F.col("__base") + F.coalesce(F.sum("size").over(in_name), F.lit(0))).drop("__base")
        rows = rows.where("coalesce(__n, 1) = 1").unionByName(many)
    rows = rows.withColumn("d", F.explode("draws")).withColumn("mix_words", F.expr(TAKE))
    rows = rows.where("mix_words > 0").withColumn("__at", F.xxhash64(F.lit(seed), "__order", "d.epoch"))
    out = rows.select("__row", F.col("d.shard").alias("mix_shard"), F.col("d.epoch").alias("mix_epoch"), "mix_words", "__at", F.pmod("__at", F.lit(64)).alias("__piece"))
    out = out.repartition("mix_shard", "__piece").sortWithinPartitions("mix_shard", "__at")
    taken = {c.lower() for c in docs.columns}
    return out.select("__row.*", *[F.col(c).alias(_free(c, taken)) for c in ("mix_shard", "mix_epoch", "mix_words")])


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name


TAKEN_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         sha256('mix|' || coalesce(CAST(doc_id AS VARCHAR), sha256(coalesce(text, '')))) AS ord
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS BIGINT) AS remaining,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS left_weight,
         coalesce(sum(3 * source_size) OVER b, 0) AS filled
  FROM r WINDOW b AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT remaining / left_weight AS level FROM l WHERE remaining / left_weight <= 3 * source_size / weight ORDER BY filled LIMIT 1
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM l, v
), g AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t
), c AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.goal,
         CASE WHEN g.source_size > 0 THEN g.goal // g.source_size ELSE 0 END AS passes,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       passes * size + greatest(0, least(size, goal - passes * source_size - before)) AS taken
FROM c
"""
