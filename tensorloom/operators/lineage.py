"""Lineage: an operation log and one global table of edges (child, parent, operation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.sources.cut import forget, written

OPERATIONS = "operation_id string, operation_type string, status string, started_at timestamp, completed_at timestamp, user_id string, error_message string"
EDGES = "child long, parent long, operation_id string"
#: Steps whose tables a closure reads one by one; then they become one table.
MERGED = 16
#: Pairs that one node may make in one task of a doubling, and pairs whose least depths a task finds.
PART, ROWS = 100_000, 1 << 19


def _closure(edges: DataFrame, start: DataFrame, source: str, target: str, depth: int | None) -> DataFrame:
    """(origin, node, depth), the least depth of each; depth, if given, asks for the nodes within so many steps.

    From few nodes it goes breadth-first, from many by doubling; cycles end as a pair is kept with its least depth.
    """
    ways = written(edges.select(F.col(source).alias("node"), F.col(target).alias("_to")).where("node IS NOT NULL AND _to IS NOT NULL").distinct(), "lineage")
    begin = written(start.select(F.col("node").alias("origin")).distinct(), "lineage")
    if 2 * begin.count() >= ways.count():
        return _doubled(ways, depth).join(begin, "origin", "left_semi").select("origin", "node", "depth")
    return _breadth_first(ways, begin.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth")), depth)


def _doubled(ways: DataFrame, depth: int | None) -> DataFrame:
    """The pairs of all nodes: after k rounds those up to 2**k steps apart, so that rounds grow with the logarithm of the depth."""
    pairs = written(ways.select(F.col("node").alias("origin"), F.col("_to").alias("node"), F.lit(1).alias("depth")).where("origin <> node"), "lineage")
    reach = 1
    while depth is None or reach < depth:
        longest = pairs.agg(F.max("depth")).first()[0]
        if longest is None or longest < reach:
            break
        # a way longer than reach begins with one of just reach steps
        first = pairs.where(F.col("depth") == reach).select("origin", F.col("node").alias("_by"))
        rest = pairs.select(F.col("origin").alias("_by"), "node", F.col("depth").alias("_more"))
        joined, n = _by_parts(first, rest)
        longer = joined.select("origin", "node", (F.lit(reach) + F.col("_more")).alias("depth")).where("origin <> node")
        # no combining on the map side, which rarely finds a pair twice and holds all pairs of a task
        dealt = pairs.union(longer).repartition(-(-(pairs.count() + n) // ROWS), "origin", "node")
        before, pairs = pairs, written(dealt.groupBy("origin", "node").agg(F.min("depth").alias("depth")), "lineage")
        forget(before)
        reach *= 2
    return pairs if depth is None else pairs.where(F.col("depth") <= depth)


def _by_parts(first: DataFrame, rest: DataFrame) -> tuple[DataFrame, int]:
    """The join on _by and its number of rows, where the rows of a node that makes more than PART pairs are dealt to parts of about that many.

    Late rounds pass through a few nodes near the roots, each with very many rows; their pairs would lie in few tasks.
    """
    n = written(first.groupBy("_by").agg(F.count("*").alias("_n")).join(rest.groupBy("_by").agg(F.count("*").alias("_m")), "_by"), "lineage")
    # at most a PARTth of the pairs has rows here
    many = F.broadcast(written(n.where(F.col("_n") * F.col("_m") > PART).select("_by", F.ceil(F.col("_n") * F.col("_m") / PART).cast("int").alias("_parts")), "lineage"))
    dealt = first.join(many, "_by", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("origin"), "_parts"), F.lit(0).cast("long"))).drop("_parts")
    every = rest.join(many, "_by", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)).cast("long") - 1))).drop("_parts")
    return dealt.join(every, ["_by", "_part"]), n.agg(F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0))).first()[0]


def _breadth_first(ways: DataFrame, frontier: DataFrame, depth: int | None) -> DataFrame:
    """Step by step; known nodes aren't visited again, and it ends when a step reaches nothing new."""
    found, step = frontier, 0
    while depth is None or step < depth:
        step += 1
        reached = frontier.join(ways, "node").select("origin", F.col("_to").alias("node")).distinct()
        new = written(reached.join(found.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(step)), "lineage")
        if new.isEmpty():
            break
        found = found.union(new)
        if step % MERGED == 0:
            found = written(found, "lineage")
        frontier = new
    return found.where("depth > 0")


def ancestors(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(origin, node, depth) above each start node; start: a table with column node."""
    return _closure(edges, start, "child", "parent", depth)


def descendants(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    return _closure(edges, start, "parent", "child", depth)


def _one(spark, node: int) -> DataFrame:
    return spark.range(1).select(F.lit(int(node)).cast("long").alias("node"))


def recursive_closure(spark, edges: DataFrame, node: int, up: bool = True, depth: int | None = None) -> DataFrame:
    """(node, depth) above or below one node."""
    return (ancestors if up else descendants)(edges, _one(spark, node), depth).select("node", "depth")


def shortest_path(spark, edges: DataFrame, source: int, target: int, depth: int | None = None) -> DataFrame:
    """(nodes, hops): the first in order of the shortest paths from an ancestor down to a descendant; no row if there is none."""
    source, target = int(source), int(target)
    ways = written(edges.select(F.col("child").alias("node"), F.col("parent").alias("_to")).where("node IS NOT NULL AND _to IS NOT NULL").distinct(), "lineage")
    frontier = found = written(_one(spark, target).select("node", F.array("node").alias("nodes"), F.lit(0).alias("hops")), "lineage")
    step = 0
    while frontier.where(F.col("node") == source).isEmpty() and (depth is None or step < depth):
        step += 1
        # of the paths of one length from a node down, the first one in order is the only one that can be part of the answer
        reached = frontier.join(ways, "node").groupBy(F.col("_to").alias("node")).agg(F.min("nodes").alias("nodes"))
        new = reached.join(found.select("node"), "node", "left_anti")
        frontier = written(new.select("node", F.concat(F.array("node"), "nodes").alias("nodes"), F.lit(step).alias("hops")), "lineage")
        if frontier.isEmpty():
            break
        found = found.select("node").union(frontier.select("node"))
        if step % MERGED == 0:
            found = written(found, "lineage")
    return frontier.where(F.col("node") == source).select("nodes", "hops")


def recorded(operations: DataFrame, edges: DataFrame, new_operations: DataFrame, inputs: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log and the edges with more operations; inputs and outputs: (operation_id, tensor).

    Every output of an operation descends from each of its inputs; an operation without inputs makes roots. One that
    is recorded again changes nothing.
    """
    fresh = new_operations.join(operations.select("operation_id"), "operation_id", "left_anti").dropDuplicates(["operation_id"])
    made = outputs.select("operation_id", F.col("tensor").alias("child")).join(inputs.select("operation_id", F.col("tensor").alias("parent")), "operation_id", "left")
    made = made.join(fresh.select("operation_id"), "operation_id", "left_semi").select("child", "parent", "operation_id").distinct()
    return operations.unionByName(fresh), edges.unionByName(made)


def with_depths(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth) of known nodes and the children of new edges (child, parent): one more than the deepest parent, 0 for roots.

    Edges among new nodes are followed level by level; a node whose parents aren't known yet waits for them, and what
    waits for itself is an error.
    """
    done = known.select("node", "depth")
    todo = written(edges.select("child", "parent").distinct(), "lineage")
    left = todo.select("child").distinct().count()
    while left:
        reached = todo.join(done.withColumnRenamed("node", "parent"), "parent", "left")
        # parents that are neither known nor made by a new edge count as roots
        open_ = todo.select(F.col("child").alias("parent")).distinct().withColumn("_open", F.lit(True))
        ready = reached.join(open_, "parent", "left").groupBy("child").agg(F.max(F.coalesce("_open", F.lit(False))).alias("_waits"), F.max(F.coalesce("depth", F.when(F.col("parent").isNotNull(), F.lit(0)))).alias("d"))
        new = written(ready.where("NOT _waits").select(F.col("child").alias("node"), F.coalesce(F.col("d") + 1, F.lit(0)).alias("depth")), "lineage")
        n = new.count()
        if not n:
            raise ValueError("the edges form a cycle")
        done = written(done.join(new.select("node"), "node", "left_anti").union(new), "lineage")
        todo = written(todo.join(new.select(F.col("node").alias("child")), "child", "left_anti"), "lineage")
        left -= n
    return done


def parents(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("child") == node).select("parent").distinct()


def children(edges: DataFrame, node: int) -> DataFrame:
    return edges.where((F.col("parent") == node) & (F.col("child") != node)).select("child").distinct()


def roots_and_leaves(edges: DataFrame) -> DataFrame:
    """(node, is_root, is_leaf) of every node of the edges."""
    up, down = edges.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), edges.select(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    return up.union(down).groupBy("node").agg((F.max("up") == 0).alias("is_root"), (F.max("down") == 0).alias("is_leaf"))


def statistics(operations: DataFrame, kind: str = "operation_type", status: str = "status", milliseconds: str = "ms") -> DataFrame:
    done = F.col(status) == "completed"
    return operations.groupBy(kind).agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col(status) == "failed").alias("failed"),
        F.try_divide(F.count_if(done), F.count("*")).alias("rate"), F.avg(F.when(done, F.col(milliseconds))).alias("mean_ms"),
    )


def recent(operations: DataFrame, limit: int = 100, where=None, started: str = "started_at", key: str = "operation_id") -> DataFrame:
    """The latest operations that pass the filter."""
    return (operations if where is None else operations.where(where)).orderBy(F.desc(started), key).limit(limit)


def duration_ms(started: str, completed: str):
    return F.timestamp_diff("MILLISECOND", F.col(started), F.col(completed))


def dot_lines(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """(part, line): the lines of a DOT text of a lineage of any size, its frame (parts 0 and 2) too; edges: child, parent, operation_id."""
    arrow = F.format_string('  "%s" -> "%s" [label="%s"];', "parent", "child", F.coalesce("operation_type", F.lit("")))
    lines = edges.join(kinds.select("operation_id", "operation_type"), "operation_id", "left").select(arrow.alias("line"))
    roots = roots_and_leaves(edges).where("is_root").select(F.format_string('  "%s" [color=green];', "node").alias("line"))
    frame = edges.sparkSession.createDataFrame([(0, "digraph lineage {"), (2, "}")], "part int, line string")
    return frame.union(lines.union(roots).distinct().select(F.lit(1).alias("part"), "line"))


def dot(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """``dot_lines`` of a (bounded) lineage as one text."""
    row = F.struct("part", "line")
    return dot_lines(edges, kinds).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(row)), lambda r: r["line"])).alias("dot"))
