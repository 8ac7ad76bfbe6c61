"""Random walks over a weighted graph: first order, uniform and second order (node2vec).

A walk is a row; a step is a join of the walk table with the adjacency pieces.  All draws
are hashes of (seed, walk, step, try), so a lost executor recomputes the same walks and
SQL can replay them.

A step proposes a neighbour and may refuse it:

* a hub's neighbours lie in several pieces.  A piece is drawn uniformly, a neighbour in it
  by weight, and the proposal is kept with probability piece weight / heaviest piece;
* a second-order walk keeps it with probability bias / largest bias, where the bias is 1/p
  for going back, 1 for a neighbour of the previous vertex, else 1/q.

Refused walks try again, so the outcome follows the exact distribution and neither hubs
nor the neighbour sets of the previous vertex are ever gathered in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import hashing
from flowloom.operators import subgraph
from flowloom.operators.skew import HEAVY_SHARE, lookup_join, repeated, salted
from flowloom.session import checkpoint_layout, cut_lineage
from flowloom.sources.flows import ROW_NUMBER, with_order_row_number

CHUNK_ROWS = 4096
SECOND_ORDER_TRIES = 6
MOST_TRIES = 400  # of a walk at once
CUT_EVERY = 5
WALK = ["round", "start"]


@dataclass
class WalkGraph:
    """Adjacency ready for walking; build it once with `prepare_graph` and reuse it."""

    pieces: DataFrame  # cur, chunk, nbrs, total, _salt
    heavy: DataFrame  # cur, _salts: vertices at which a large share of the walks may arrive
    hubs: DataFrame | None  # cur, chunks, heaviest
    pairs: DataFrame | None  # prev, dst: the edge set, for second-order walks


def _busy_vertices(weighted: DataFrame) -> DataFrame:
    """Vertices with a large share of all edges or of all weight, with the tasks to spread them over."""
    ends = weighted.groupBy(F.col("dst").alias("cur")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    shares = [F.col(c) / ends.agg(F.sum(c)).scalar() for c in ("n", "w")]
    busy = ends.select("cur", F.greatest(*shares).alias("share")).filter(F.col("share") > HEAVY_SHARE)
    return busy.select("cur", F.ceil(F.col("share") / HEAVY_SHARE).cast("int").alias("_salts"))


def prepare_graph(weighted: DataFrame, second_order: bool = False, chunk_rows: int = CHUNK_ROWS) -> WalkGraph:
    """Write the adjacency, laid out by join key, to the checkpoint folder.

    Later steps shuffle only the walks: the checkpoint keeps the partitioning.  Runs the
    jobs that write it and one count.  `weighted` is read several times, so give a stored table.
    """
    heavy = cut_lineage(_busy_vertices(weighted))
    partitions = int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = checkpoint_layout(
        repeated(subgraph.adjacency(weighted, chunk_rows), heavy).repartition(partitions, "cur", "chunk", "_salt")
    )
    hubs = (
        pieces.filter("chunk > 0")
        .select("cur")
        .distinct()
        .join(pieces.filter("_salt = 0"), "cur")
        .groupBy("cur")
        .agg((F.max("chunk") + 1).alias("chunks"), F.max("total").alias("heaviest"))
    )
    hubs = cut_lineage(hubs)
    pairs = None
    if second_order:
        edge_set = weighted.select(F.col("src").alias("prev"), "dst").distinct()
        pairs = checkpoint_layout(edge_set.repartition(partitions, "prev", "dst"))
    return WalkGraph(pieces, heavy, hubs if hubs.count() else None, pairs)


def start_nodes(
    weighted: DataFrame, offset: int = 0, limit: int | None = None, only: str | None = None
) -> DataFrame:
    """Vertices with an out-edge, in id order from `offset` on; or the one asked for."""
    starts = weighted.select(F.col("src").alias("start")).distinct()
    if only is not None:
        return starts.filter(F.col("start") == only)
    if not offset and limit is None:
        return starts
    ranked = with_order_row_number(starts, "start")
    upto = F.lit(True) if limit is None else F.col(ROW_NUMBER) <= offset + limit
    return ranked.filter((F.col(ROW_NUMBER) > offset) & upto).select("start")


def all_vertices(weighted: DataFrame) -> DataFrame:
    """Starts of the variant that also walks from vertices without out-edges."""
    return weighted.select(F.col("src").alias("start")).union(weighted.select("dst")).distinct()


def fan_out(starts: DataFrame, num_walks: int) -> DataFrame:
    """`round`, `start`: every start once per round."""
    return starts.select(F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("round"), "start")


def filter_edges(edges: DataFrame, relations: list[str] | None = None, max_delta: int | None = None) -> DataFrame:
    out = edges
    if relations is not None:
        out = subgraph.of_relations(out, relations)
    if max_delta is not None:
        out = subgraph.within_delta(out, max_delta)
    return out


def _pick(nbrs: Column, threshold: Column, chunk_rows: int) -> Column:
    """First neighbour whose running weight exceeds the threshold, by binary search."""
    step = 1
    steps = [step]
    while step < 4 * chunk_rows:
        step *= 2
        steps.insert(0, step)

    def advance(pos: Column, jump: Column) -> Column:
        passed = F.get(nbrs, pos + jump - 1)["upto"] <= threshold
        return F.when(F.coalesce(passed, F.lit(False)), pos + jump).otherwise(pos)

    return F.get(nbrs, F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance))["dst"]


def _draw(seed: int, step: int, kind: str) -> Column:
    return hashing.draw(F.lit(seed), *[F.col(c) for c in WALK], F.lit(step), F.col("try"), F.lit(kind))


def _propose(state: DataFrame, graph: WalkGraph, seed: int, step: int, chunk_rows: int) -> DataFrame:
    """Add `dst` (NULL for none), `share` (piece weight / heaviest) and `hub` to walks with a `try`."""
    if graph.hubs is None:
        placed = state.withColumn("chunk", F.lit(0).cast("bigint")).withColumn("heaviest", F.lit(None).cast("bigint"))
    else:
        chunk = F.floor(_draw(seed, step, "chunk") * F.col("chunks")).cast("bigint")
        placed = (
            lookup_join(state, graph.hubs, ["cur"], [*WALK, "try"], heavy=graph.heavy)
            .withColumn("chunk", F.coalesce(chunk, F.lit(0).cast("bigint")))
            .drop("chunks")
        )
    joined = salted(placed, graph.heavy, [*WALK, "try"]).join(graph.pieces, ["cur", "chunk", "_salt"], "left")
    threshold = F.floor(_draw(seed, step, "pick") * F.col("total")).cast("bigint")
    share = F.coalesce(F.col("total") / F.col("heaviest"), F.lit(1.0))
    return (
        joined.withColumn("dst", _pick(F.col("nbrs"), threshold, chunk_rows))
        .withColumn("share", share)
        .withColumn("hub", F.col("heaviest").isNotNull())
        .drop("nbrs", "total", "heaviest", "chunk", "_salt")
    )


def _first_order_step(state: DataFrame, graph: WalkGraph, seed: int, step: int, chunk_rows: int) -> DataFrame:
    """`state` plus `next`; NULL at a dead end."""
    tried = _propose(state.withColumn("try", F.lit(0)), graph, seed, step, chunk_rows)
    if graph.hubs is None:
        return tried.withColumnRenamed("dst", "next").drop("try", "share", "hub")
    return _retry(state, tried, graph, seed, step, chunk_rows, None)


def _second_order_step(
    state: DataFrame, graph: WalkGraph, seed: int, step: int, chunk_rows: int, p: float, q: float
) -> DataFrame:
    tries = F.explode(F.sequence(F.lit(0), F.lit(SECOND_ORDER_TRIES - 1)))
    tried = _propose(state.withColumn("try", tries), graph, seed, step, chunk_rows)
    return _retry(state, tried, graph, seed, step, chunk_rows, (p, q))


def _accepted(tried: DataFrame, graph: WalkGraph, seed: int, step: int, pq: tuple[float, float] | None) -> DataFrame:
    chance = F.col("share")
    if pq is not None:
        back, away = 1.0 / pq[0], 1.0 / pq[1]
        known = graph.pairs.withColumn("known", F.lit(True))
        tried = tried.join(known, ["prev", "dst"], "left")
        bias = F.when(F.col("dst") == F.col("prev"), back).when(F.col("known"), 1.0).otherwise(away)
        chance = chance * bias / F.lit(max(back, 1.0, away))
    verdict = F.when(F.col("dst").isNull() & ~F.col("hub"), F.lit("stop"))
    verdict = verdict.when(F.col("dst").isNotNull() & (_draw(seed, step, "accept") < chance), F.lit("go"))
    return tried.withColumn("verdict", verdict.otherwise(F.lit("again")))


def _retry(
    state: DataFrame,
    tried: DataFrame,
    graph: WalkGraph,
    seed: int,
    step: int,
    chunk_rows: int,
    pq: tuple[float, float] | None,
) -> DataFrame:
    """Take each walk's first accepted try; draw again for walks that have none yet."""
    # Each round tries more often than the one before: few walks are left, and a round is a shuffle whatever
    # its size.  Tries are numbered, so the walk that comes out does not depend on it.
    per_round = SECOND_ORDER_TRIES if pq else 1
    settled: DataFrame | None = None
    first_try = 0
    while True:
        judged = _accepted(tried, graph, seed, step, pq)
        best = F.min_by(F.struct("verdict", F.col("dst").alias("next")), F.when(F.col("verdict") != "again", F.col("try")))
        outcome = judged.groupBy(*WALK).agg(best.alias("best"))
        merged = cut_lineage(state.join(outcome, WALK, "left"))
        done = merged.filter("best IS NOT NULL").select(*state.columns, F.col("best.next").alias("next"))
        settled = done if settled is None else settled.unionByName(done)
        left = merged.filter("best IS NULL").select(*state.columns)
        if left.isEmpty():
            return settled
        first_try += per_round
        per_round = min(4 * per_round, MOST_TRIES)
        numbers = F.explode(F.sequence(F.lit(first_try), F.lit(first_try + per_round - 1)))
        state = left
        tried = _propose(left.withColumn("try", numbers), graph, seed, step, chunk_rows)


def walk(
    graph: WalkGraph,
    walks: DataFrame,
    length: int,
    seed: int,
    p: float = 1.0,
    q: float = 1.0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """`round`, `start`, `tokens` for each (round, start): at most `length` vertices.

    A walk stops at a vertex without out-edges.  With p = q = 1 a step is one join; the
    walk table is checkpointed every few steps so that a late failure does not replay all.
    """
    second = p != 1.0 or q != 1.0
    if second and graph.pairs is None:
        raise ValueError("a second-order walk needs prepare_graph(second_order=True)")
    none = F.lit(None).cast("string")
    state = walks.select(
        "round", "start", none.alias("prev"), F.col("start").alias("cur"), F.array("start").alias("tokens")
    )
    finished: list[DataFrame] = []
    for step in range(1, length):
        if second and step > 1:
            moved = _second_order_step(state, graph, seed, step, chunk_rows, p, q)
        else:
            moved = _first_order_step(state, graph, seed, step, chunk_rows)
        grown = F.when(F.col("next").isNull(), F.col("tokens")).otherwise(F.array_append("tokens", F.col("next")))
        state = moved.select(
            "round",
            "start",
            F.when(F.col("next").isNotNull(), F.col("cur")).alias("prev"),
            F.col("next").alias("cur"),
            grown.alias("tokens"),
        )
        if step % CUT_EVERY == 0 and step + 1 < length:
            # Stopped walks leave the table here and are not shuffled again.
            state = cut_lineage(state)
            finished.append(state.filter("cur IS NULL").select("round", "start", "tokens"))
            state = state.filter("cur IS NOT NULL")
    out = state.select("round", "start", "tokens")
    for part in finished:
        out = out.unionByName(part)
    return out


def uniform_edges(edges: DataFrame, src: str = "src_record_id", dst: str = "dst_record_id") -> DataFrame:
    """Equal weights: the unweighted step."""
    return subgraph.weighted_edges(edges, src, dst, None)


def to_lines(walks: DataFrame) -> DataFrame:
    """Corpus lines, tokens joined by a space."""
    return walks.select(F.concat_ws(" ", "tokens").alias("value"))


def next_batch(starts: DataFrame, done: DataFrame, size: int) -> DataFrame:
    """The next `size` starts in id order that no earlier batch has walked."""
    todo = starts.join(done.select("start").distinct(), "start", "left_anti")
    return with_order_row_number(todo, "start").filter(F.col(ROW_NUMBER) <= size).select("start")


def append_batch(walks: DataFrame, path: str, batch: int) -> None:
    """Write one batch into its own folder, so that a rerun replaces only that batch."""
    (
        walks.withColumn("batch", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )


def touched_vertices(walks: DataFrame) -> DataFrame:
    return walks.select(F.explode("tokens").alias("token")).distinct()


def id_map(walks: DataFrame) -> DataFrame:
    """`vid` (0-based, in token order) and `token` of every vertex on a walk."""
    ranked = with_order_row_number(touched_vertices(walks), "token")
    return ranked.select((F.col(ROW_NUMBER) - 1).alias("vid"), "token")


def token_names(walks: DataFrame, names: DataFrame) -> DataFrame:
    """Replace vertex ids by names (`id`, `name`), keeping the id where there is no name."""
    steps = walks.select("round", "start", F.posexplode("tokens").alias("pos", "id"))
    named = lookup_join(steps, names, ["id"], [*WALK, "pos"])
    step = F.struct("pos", F.coalesce(F.nullif("name", F.lit("")), F.col("id")).alias("token"))
    ordered = named.groupBy(*WALK).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return ordered.select(*WALK, F.transform("steps", lambda s: s["token"]).alias("tokens"))


def run_counters(walks: DataFrame, weighted: DataFrame, rejected_edges: int | None = None) -> DataFrame:
    """`counter`, `n`: walks, starts, vertices touched, weights replaced because not positive."""
    fallbacks = weighted.agg(F.count_if("fallback").alias("n")).select(F.lit("weight_fallbacks").alias("counter"), "n")
    counts = subgraph.graph_counts(
        walks=walks, completed_starts=walks.select("start").distinct(), touched_vertices=touched_vertices(walks)
    ).withColumnRenamed("element", "counter")
    return counts.unionByName(fallbacks)


def filtered_edge_count(edges: DataFrame, relations: list[str] | None = None, max_delta: int | None = None) -> DataFrame:
    """Edges a walk filter keeps and rejects."""
    kept = F.lit(True)
    if relations is not None:
        kept = kept & F.col("relation_type").isin(relations)
    if max_delta is not None:
        kept = kept & (F.col("delta_seconds") <= max_delta)
    return edges.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"))


def corpus_stats(walks: DataFrame, min_length: int = 2) -> DataFrame:
    """One row of counts over a walk corpus; the median is the upper of the two middle ones."""
    from flowloom.operators.skew import histogram_positions

    sizes = walks.select(F.size("tokens").cast("bigint").alias("length"))
    spread = histogram_positions(sizes, "length")
    middle = F.expr("total div 2").between(F.col("first"), F.col("last"))
    stats = spread.agg(
        F.sum("n").alias("lines"),
        F.coalesce(F.sum(F.when(F.col("length") == 0, F.col("n"))), F.lit(0)).alias("empty_lines"),
        F.coalesce(F.sum(F.when(F.col("length") == 1, F.col("n"))), F.lit(0)).alias("length_one"),
        F.coalesce(F.sum(F.when(F.col("length").between(1, min_length - 1), F.col("n"))), F.lit(0)).alias("short_walks"),
        F.min("length").alias("min_length"),
        (F.sum(F.col("n") * F.col("length")) / F.sum("n")).alias("avg_length"),
        F.max(F.when(middle, F.col("length"))).alias("p50_length"),
        F.max("length").alias("max_length"),
    )
    unique = touched_vertices(walks).agg(F.count(F.lit(1)).alias("n")).scalar()
    return stats.withColumn("unique_tokens", unique)


def token_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tokens present on one side only: `token`, `only_in` (left or right)."""
    a, b = left.select("token").distinct(), right.select("token").distinct()
    return (
        a.join(b, "token", "left_anti")
        .select("token", F.lit("left").alias("only_in"))
        .unionAll(b.join(a, "token", "left_anti").select("token", F.lit("right").alias("only_in")))
    )
