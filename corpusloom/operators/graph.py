"""Levels, closures and subtrees over edge tables, by rounds of joins.

Levels and closures jump: a node with one open dependency passes on where that leads, so the steps of a chain or a
tree double with every round and the rounds grow with the logarithm of its length.  No round makes more rows than
there are nodes and edges.  Each round is checkpointed, so lineage stays short and a lost executor costs one round.
Rounds of levels are written as Parquet, a few bytes a row, and removed when the next one is there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.scale import join_small_side
from corpusloom.session import ensure_checkpoint_dir, narrow_tasks, remove_folder, scratch_folder, written, written_to


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of every node: 0 without dependencies, else one more than the deepest one.

    ``nodes``: ``graph_id, node``; ``edges``: ``graph_id, node, depends_on``.
    Dependencies on unknown nodes are ignored.  A graph with a cycle gives no
    rows.  Needs about as many rounds as the logarithm of the longest chain, and
    one more for each layer of nodes that wait for several open ones.
    """
    levels, _ = levels_and_rounds(nodes, edges)
    return levels


def _in_narrow_tasks(rounds: Callable) -> Callable:
    """Run the rounds in tasks of bounded size; all they return is checkpointed."""

    @wraps(rounds)
    def run(first: DataFrame, second: DataFrame) -> tuple[DataFrame, int]:
        with narrow_tasks(first.sparkSession):
            return rounds(first, second)

    return run


@_in_narrow_tasks
def levels_and_rounds(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """:func:`dependency_levels` with the number of rounds it took."""
    spark = nodes.sparkSession
    nodes_folder, folder = (scratch_folder(spark, f"levels-{name}") for name in ("nodes", "start"))
    all_nodes = written_to(nodes.select("graph_id", "node").distinct(), nodes_folder)
    largest = all_nodes.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    known = all_nodes.select("graph_id", F.col("node").alias("depends_on"))
    own = edges.select("graph_id", "node", "depends_on").distinct()
    own = join_small_side(join_small_side(own, known, ["graph_id", "depends_on"], "left_semi"), all_nodes, ["graph_id", "node"], "left_semi")
    # A row says that the level is at least ``base`` and, with a dependency, ``add`` more than that one's level.
    rows = own.select("graph_id", "node", "depends_on", F.lit(0).cast("long").alias("base"), F.lit(1).cast("long").alias("add"))
    depends_on = own.schema["depends_on"].dataType
    rows = rows.unionByName(
        all_nodes.select("graph_id", "node", F.lit(None).cast(depends_on).alias("depends_on"), F.lit(0).cast("long").alias("base"), F.lit(None).cast("long").alias("add"))
    )
    rows = written_to(rows.withColumn("cycle", F.lit(False)), folder)
    remove_folder(spark, nodes_folder)
    rounds, left = 0, rows.agg(F.count("depends_on")).first()[0]
    while left:
        before, folder = folder, scratch_folder(spark, "levels-round")
        rows, moved, left = _jumped(rows, largest, folder)
        remove_folder(spark, before)
        rounds += 1
        if not moved:
            break  # what is left waits for a cycle
    cyclic = rows.filter(F.col("depends_on").isNotNull() | F.col("cycle")).select("graph_id").distinct() if rounds else None
    levels = rows.groupBy("graph_id", "node").agg(F.max("base").alias("level"))
    found = written(levels if cyclic is None else join_small_side(levels, cyclic, "graph_id", "left_anti"), "levels")
    remove_folder(spark, folder)
    return found, rounds


def _jumped(rows: DataFrame, largest: int, folder: str) -> tuple[DataFrame, int, int]:
    """One round, written to ``folder``: rows, how many dependencies were resolved or led on, and how many are left."""
    opens = F.when(F.col("depends_on").isNotNull(), F.struct(F.col("depends_on").alias("to"), F.col("add")))
    nodes = rows.groupBy("graph_id", F.col("node").alias("depends_on")).agg(
        F.max("base").alias("its_base"), F.count("depends_on").alias("its_open"), F.max(opens).alias("its_one")
    )
    met = rows.join(nodes, ["graph_id", "depends_on"], "left")
    waits = F.col("depends_on").isNotNull()
    done, leads = waits & (F.col("its_open") == 0), waits & (F.col("its_open") == 1)
    add = F.when(done, F.lit(None)).when(leads, F.col("add") + F.col("its_one.add")).otherwise(F.col("add"))
    # A way of more steps than any graph has nodes goes round a cycle.
    round_trip = F.coalesce(add > largest, F.lit(False))
    base = F.when(done | leads, F.greatest("base", F.col("add") + F.col("its_base"))).otherwise(F.col("base"))
    depends_on = F.when(done | round_trip, F.lit(None)).when(leads, F.col("its_one.to")).otherwise(F.col("depends_on"))
    moved = met.select(
        "graph_id", "node", depends_on.alias("depends_on"), base.alias("base"), F.when(~round_trip, add).alias("add"),
        (F.col("cycle") | round_trip).alias("cycle"), (done | leads).alias("moved"),
    )
    kept = written_to(
        moved.groupBy("graph_id", "node", "depends_on")
        .agg(F.max("base").alias("base"), F.max("add").alias("add"), F.max("cycle").alias("cycle"), F.max("moved").alias("moved")),
        folder,
    )
    steps, left = kept.agg(F.count_if("moved"), F.count("depends_on")).first()
    return kept.drop("moved"), steps, left


def dependency_closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The seeds and everything they depend on, directly or not: ``graph_id, node``."""
    visited, _ = closure_and_rounds(seeds, edges)
    return visited


@_in_narrow_tasks
def closure_and_rounds(seeds: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """:func:`dependency_closure` with the number of rounds it took.

    Nodes with one dependency also carry a pointer that leads twice as far each round; all nodes reached
    so far follow it, and the dependencies of new ones are followed as they are, so nothing is left out.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    links = edges.select("graph_id", "node", "depends_on").distinct().checkpoint()
    ways = links.groupBy("graph_id", "node").agg(F.count("*").alias("n"), F.min("depends_on").alias("to")).filter("n = 1").select("graph_id", "node", "to")
    visited = seeds.select("graph_id", "node").distinct().checkpoint()
    new, rounds = visited, 0
    while not new.isEmpty():
        near = join_small_side(links, new, ["graph_id", "node"], "left_semi").select("graph_id", F.col("depends_on").alias("node"))
        far = join_small_side(ways, visited, ["graph_id", "node"], "left_semi").select("graph_id", F.col("to").alias("node"))
        new = join_small_side(near.unionByName(far).distinct(), visited, ["graph_id", "node"], "left_anti").checkpoint()
        visited = visited.unionByName(new).checkpoint()
        further = ways.select("graph_id", F.col("node").alias("to"), F.col("to").alias("next"))
        ways = ways.join(further, ["graph_id", "to"], "left").select("graph_id", "node", F.coalesce("next", "to").alias("to")).checkpoint()
        rounds += 1
    return visited, rounds


def children(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Direct children of the given nodes (``space_id, node_token``)."""
    parents = roots.select("space_id", F.col("node_token").alias("parent_node_token")).distinct()
    return join_small_side(nodes, parents, ["space_id", "parent_node_token"], "left_semi")


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """All descendants of the roots in discovery order.

    ``nodes``: ``space_id, node_token, parent_node_token, has_child, position``
    (place among its siblings) and more.  Each parent is opened once, children
    of a parent are listed together, and the last listed child is opened first.
    Adds ``parent_path, position`` as the order within a space, and ``depth``.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    listed = nodes.checkpoint()
    opening = roots.select("space_id", F.col("node_token").alias("parent_node_token")).distinct().withColumn(
        "parent_path", F.array().cast("array<int>")
    )
    opened = opening.select("space_id", "parent_node_token")
    opening_count = opened_count = opening.count()
    found: DataFrame | None = None
    depth = 1
    while opening_count:
        level = join_small_side(
            listed, opening, ["space_id", "parent_node_token"], "inner"
        ).withColumn("depth", F.lit(depth)).checkpoint()
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        candidates = level.filter("has_child").select(
            "space_id",
            F.col("node_token").alias("parent_node_token"),
            F.concat("parent_path", F.array((-F.col("position")).cast("int"))).alias("parent_path"),
        )
        opening = join_small_side(
            candidates, opened, ["space_id", "parent_node_token"], "left_anti"
        ).checkpoint()
        opening_count = opening.count()
        opened_count += opening_count
        opened = opened.unionByName(opening.select("space_id", "parent_node_token"))
        depth += 1
    if found is None:
        return listed.limit(0).withColumn("parent_path", F.array().cast("array<int>")).withColumn("depth", F.lit(0))
    return found.select(*nodes.columns, "parent_path", "depth")
