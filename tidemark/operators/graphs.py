"""File graphs: coupling, cycles, depth, layers, dependents.

Edges are rows (repository_id, src, dst), distinct and without self-loops. The
loops below run over all repositories at once; each round is a join and an
aggregate on node keys, materialised through the shared checkpoint folder, so a
lost executor costs a re-read and not a replay. What a round changes only ever
gets better and is bounded, so every loop ends by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators.imports import resolve_imports
from tidemark.operators.keyed import salted_join, top_per_key
from tidemark.operators.rules import finding_rows
from tidemark.session import cut_lineage

# Thresholds and list limits.
HIGH_COUPLING, DEEP_CHAIN = 10, 8
MAX_DEPENDENTS, MAX_EDGES = 50, 200

NODE = ["repository_id", "node"]


def file_graph(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct resolved imports between different files."""
    resolved = resolve_imports(imports, files)
    return resolved.filter("target_path IS NOT NULL AND target_path <> file_path").select(
        "repository_id", F.col("file_path").alias("src"), F.col("target_path").alias("dst")).distinct()


def coupling(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Out-degree and in-degree of every file.

    Both degrees come from one aggregate over edge ends, which reduces
    map-side, so a file that everything imports costs one row per task.
    """
    ends = edges.select("repository_id", F.explode(F.array(
        F.struct(F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    degrees = ends.groupBy("repository_id", F.col("e.path").alias("path")).agg(
        F.sum("e.o").alias("efferent"), F.sum("e.i").alias("afferent"))
    return files.select("repository_id", "path").join(degrees, ["repository_id", "path"], "left").fillna(0, ["efferent", "afferent"])


def high_coupling(degrees: DataFrame, limit: int = HIGH_COUPLING) -> DataFrame:
    out, into = F.col("efferent"), F.col("afferent")
    hits = degrees.filter((out > limit) | (into > limit)).withColumn("file_path", F.col("path"))
    return finding_rows(
        hits, type="HIGH_MODULE_COUPLING", category="DEPENDENCY", severity="LOW", confidence=70,
        title=F.concat("path", F.lit(" has high coupling ("), out.cast("string"), F.lit(" outgoing, "), into.cast("string"), F.lit(" incoming)")),
        metadata=F.to_json(F.struct(out.alias("efferent_coupling"), into.alias("afferent_coupling"))))


# --- fixed points ---------------------------------------------------------------------

def _relax(values: DataFrame, edges: DataFrame, message: Column, better: str) -> DataFrame:
    """Values per node after messages along edges stop improving them.

    Only nodes that improved in the last round send again. `better` is min or
    max; `message` is built from the sender's `value` and the edge's columns.
    `values` should be cheap to read twice; every later round is materialised.
    Values only improve and are bounded, so the rounds end.
    """
    combine = F.min if better == "min" else F.max
    known = senders = values
    while True:
        sent = (
            senders.withColumnRenamed("node", "src").join(edges, ["repository_id", "src"])
            .select("repository_id", F.col("dst").alias("node"), message.alias("offer"))
            .groupBy(*NODE).agg(combine("offer").alias("offer")))
        merged = known.join(sent, NODE, "left")
        improves = F.col("offer") < F.col("value") if better == "min" else F.col("offer") > F.col("value")
        improves = F.coalesce(improves, F.lit(False))
        stepped = cut_lineage(merged.select(
            *NODE, F.when(improves, F.col("offer")).otherwise(F.col("value")).alias("value"), improves.alias("_moved")))
        known = stepped.drop("_moved")
        senders = stepped.filter("_moved").drop("_moved")
        if senders.isEmpty():
            return known


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select("repository_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


def _without_ends(edges: DataFrame) -> DataFrame:
    """Edges whose source has an edge into it and whose target has one out of it."""
    enters = edges.select("repository_id", F.col("dst").alias("src")).distinct()
    leaves = edges.select("repository_id", F.col("src").alias("dst")).distinct()
    return edges.join(enters, ["repository_id", "src"], "left_semi").join(leaves, ["repository_id", "dst"], "left_semi")


def _labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose two ends carry the same value, with it as `group`."""
    at_src = labels.select("repository_id", F.col("node").alias("src"), F.col("value").alias("_a"))
    at_dst = labels.select("repository_id", F.col("node").alias("dst"), F.col("value").alias("_b"))
    joined = edges.join(at_src, ["repository_id", "src"]).join(at_dst, ["repository_id", "dst"])
    return joined.filter("_a = _b").select("repository_id", "src", "dst", F.col("_a").alias("group"))


def strong_groups(edges: DataFrame) -> DataFrame:
    """(repository_id, node, group) for nodes on a cycle; group is its smallest node.

    Each pass gives every node the smallest node that reaches it. A node that
    is its own smallest starts a group: the nodes with its label that reach it
    back. Those leave the graph, and the rest goes round again. Nodes without
    an edge in or out are dropped between passes, they are on no cycle.
    """
    left = edges.select("repository_id", "src", "dst").distinct().filter("src <> dst")
    for _ in range(2):
        left = _without_ends(left)
    left = cut_lineage(left)
    found: list[DataFrame] = []
    while not left.isEmpty():
        start = _nodes(left).withColumn("value", F.col("node"))
        labels = _relax(start, left, F.col("value"), "min")
        same = cut_lineage(_labelled(left, labels))
        back = same.select("repository_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
        flags = labels.select(*NODE, F.when(F.col("node") == F.col("value"), 0).otherwise(1).alias("value"))
        reach = _relax(flags, back, F.col("value"), "min").filter("value = 0").select(*NODE)
        members = cut_lineage(labels.join(reach, NODE, "left_semi").select(*NODE, F.col("value").alias("group")))
        found.append(members)
        gone = members.select(*NODE)
        rest = left
        for end in ("src", "dst"):
            rest = rest.join(gone.withColumnRenamed("node", end), ["repository_id", end], "left_anti")
        left = cut_lineage(_without_ends(_without_ends(rest)))
    if not found:
        return _nodes(left).withColumn("group", F.col("node"))
    everyone = reduce(DataFrame.unionByName, found)
    several = everyone.groupBy("repository_id", "group").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return cut_lineage(everyone.join(several, ["repository_id", "group"], "left_semi").select(*NODE, "group"))


def cycles(edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One canonical cycle per strongly connected group.

    `chain` is a shortest cycle through the group's smallest node, the
    smallest such chain by its nodes, closed by repeating that node; `members`
    counts the group. The search keeps one path per reached node.
    """
    groups = strong_groups(edges) if groups is None else groups
    inside = cut_lineage(_labelled(
        edges.select("repository_id", "src", "dst").distinct(), groups.withColumnRenamed("group", "value")))
    key = ["repository_id", "group"]
    sizes = groups.groupBy(*key).agg(F.count("*").alias("members"))
    frontier = sizes.select(*key, F.col("group").alias("node"), F.array("group").alias("path"))
    seen = frontier.select(*key, "node")
    closed: list[DataFrame] = []
    while True:
        step = frontier.withColumnRenamed("node", "src").join(inside, [*key, "src"])
        step = cut_lineage(step.groupBy(*key, F.col("dst").alias("node")).agg(F.min("path").alias("path")))
        home = step.filter(F.col("node") == F.col("group")).select(
            *key, F.concat("path", F.array("group")).alias("chain"))
        closed.append(home)
        going = step.join(home.select(*key), key, "left_anti").join(seen, [*key, "node"], "left_anti")
        frontier = cut_lineage(going.withColumn("path", F.array_append("path", F.col("node"))))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier.select(*key, "node")))
    chains = reduce(DataFrame.unionByName, closed)
    return chains.join(sizes, key)


def file_cycles(edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """A shortest cycle through every file that is on one, each set of files once.

    Two cycles that share a file are two rows. Of the shortest cycles through a
    file the smallest by its nodes counts; `chain` starts at its smallest file
    and ends with it again, and of the chains over one set of files the
    smallest stays. A search ends once it is back at its file, so it holds the
    files nearer than that, one path each, whatever the size of the group.
    """
    groups = strong_groups(edges) if groups is None else groups
    inside = cut_lineage(_labelled(
        edges.select("repository_id", "src", "dst").distinct(), groups.withColumnRenamed("group", "value")))
    key = ["repository_id", "group", "start"]
    frontier = groups.select("repository_id", "group", F.col("node").alias("start"), "node", F.array("node").alias("path"))
    seen = frontier.select(*key, "node")
    closed: list[DataFrame] = []
    while True:
        step = frontier.withColumnRenamed("node", "src").join(inside, ["repository_id", "group", "src"])
        step = cut_lineage(step.groupBy(*key, F.col("dst").alias("node")).agg(F.min("path").alias("path")))
        home = step.filter("node = start")
        closed.append(home.select("repository_id", "group", "path"))
        going = step.join(home.select(*key), key, "left_anti").join(seen, [*key, "node"], "left_anti")
        frontier = cut_lineage(going.withColumn("path", F.array_append("path", F.col("node"))))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier.select(*key, "node")))
    first = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", first, F.size("path")), F.slice("path", F.lit(1), first - 1))
    chains = reduce(DataFrame.unionByName, closed).groupBy("repository_id", "group", F.array_sort("path").alias("_files")).agg(
        F.min(turned).alias("_open"))
    return chains.select(
        "repository_id", "group", F.size("_open").alias("length"),
        F.concat("_open", F.slice("_open", F.lit(1), F.lit(1))).alias("chain"))


def cycle_findings(found: DataFrame) -> DataFrame:
    """A finding per chain, at its first file."""
    open_chain = F.slice("chain", F.lit(1), F.size("chain") - 1)
    return finding_rows(
        found.withColumn("file_path", F.element_at("chain", 1)), type="CIRCULAR_DEPENDENCY", category="DEPENDENCY", severity="MEDIUM",
        confidence=95, title=F.concat(F.lit("Circular dependency: "), F.array_join(open_chain, " -> ")),
        metadata=F.to_json(F.struct(F.col("chain").alias("cycle"))))


def cycle_edges(found: DataFrame) -> DataFrame:
    """The edges of each chain, in order."""
    pairs = F.arrays_zip(
        F.slice("chain", F.lit(1), F.size("chain") - 1).alias("src"), F.slice("chain", F.lit(2), F.size("chain") - 1).alias("dst"))
    return found.select("repository_id", "group", F.posexplode(pairs).alias("position", "e")).select(
        "repository_id", "group", "position", "e.src", "e.dst")


def dependency_depth(edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Longest import chain from each node, in nodes; a cycle counts all its members."""
    groups = strong_groups(edges) if groups is None else groups
    nodes = _nodes(edges).join(groups, NODE, "left").select(*NODE, F.coalesce("group", "node").alias("group"))
    nodes = cut_lineage(nodes)
    sizes = nodes.groupBy("repository_id", "group").agg(F.count("*").alias("size"))
    at = {end: nodes.select("repository_id", F.col("node").alias(end), F.col("group").alias(f"_{end}")) for end in ("src", "dst")}
    between = (
        edges.join(at["src"], ["repository_id", "src"]).join(at["dst"], ["repository_id", "dst"])
        .filter("_src <> _dst").select("repository_id", F.col("_dst").alias("src"), F.col("_src").alias("dst")).distinct())
    weighted = cut_lineage(between.join(
        sizes.select("repository_id", F.col("group").alias("dst"), "size"), ["repository_id", "dst"]))
    start = sizes.select("repository_id", F.col("group").alias("node"), F.col("size").alias("value"))
    depths = _relax(start, weighted, F.col("value") + F.col("size"), "max")
    return nodes.join(depths.withColumnRenamed("node", "group"), ["repository_id", "group"]).select(
        "repository_id", F.col("node").alias("path"), F.col("value").alias("depth"))


def deep_chains(depths: DataFrame, limit: int = DEEP_CHAIN) -> DataFrame:
    """The single deepest file per repository, when it is over `limit`."""
    deepest = top_per_key(depths, ["repository_id"], [F.col("depth").desc(), F.col("path").asc()], 1)
    hits = deepest.filter(F.col("depth") > limit).withColumn("file_path", F.col("path"))
    return finding_rows(
        hits, type="DEEP_DEPENDENCY_CHAIN", category="DEPENDENCY", severity="LOW", confidence=60,
        title=F.concat(F.lit("Deep dependency chain starting at "), "path", F.lit(" ("), F.col("depth").cast("string"), F.lit(" levels)")),
        metadata=F.to_json(F.struct("depth")))


# --- layers ---------------------------------------------------------------------------

def layer_violations(edges: DataFrame) -> DataFrame:
    """Edges from a file of a lower layer to one of a higher layer."""
    ranked = edges.withColumn("_from", paths.layer_rank(F.col("src"))).withColumn("_to", paths.layer_rank(F.col("dst")))
    hits = ranked.filter("_to < _from").withColumn("file_path", F.col("src"))
    source, target = paths.layer_name(F.col("_from")), paths.layer_name(F.col("_to"))
    return finding_rows(
        hits, type="LAYER_VIOLATION", category="DEPENDENCY", severity="MEDIUM", confidence=50,
        title=F.concat("src", F.lit(" ("), source, F.lit(") depends on "), F.col("dst"), F.lit(" ("), target, F.lit(")")),
        evidence=F.concat("src", F.lit(" -> "), "dst"),
        metadata=F.to_json(F.struct(source.alias("source_layer"), target.alias("target_layer"), F.col("dst").alias("target_path"))))


# --- dependents -----------------------------------------------------------------------

def _targets(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the path of their target symbol and what their source is called."""
    places = symbols.select("repository_id", F.col("id").alias("target_symbol_id"), F.col("file_path").alias("_symbol_path"))
    sources = symbols.select(
        "repository_id", F.col("id").alias("source_symbol_id"), F.col("file_path").alias("dependent_file_path"),
        F.col("name").alias("dependent_symbol_name"))
    # Symbols outnumber edges: they are not repeated per salt, adaptive execution splits a hot target instead.
    return edges.join(places, ["repository_id", "target_symbol_id"], "left").join(sources, ["repository_id", "source_symbol_id"])


def dependents(edges: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges that point at a changed file, or at a symbol of one; one hop."""
    marks = changed.select("repository_id", F.col("path").alias("_path")).distinct().withColumn("_hit", F.lit(True))
    placed = _targets(edges, symbols)
    spread = ["source_symbol_id"]
    by_file = salted_join(placed.withColumn("_path", F.col("target_file_path")), marks, ["repository_id", "_path"], spread, "left")
    by_file = by_file.withColumnRenamed("_hit", "_file_hit").drop("_path")
    both = salted_join(by_file.withColumn("_path", F.col("_symbol_path")), marks, ["repository_id", "_path"], spread, "left")
    return both.filter("_file_hit OR _hit").select(
        "repository_id", F.coalesce("target_file_path", "_symbol_path").alias("changed_file_path"), "dependent_file_path",
        "dependent_symbol_name", "edge_type")


def pr_impact(pr_files: DataFrame, edges: DataFrame, symbols: DataFrame, k: int = MAX_DEPENDENTS) -> tuple[DataFrame, DataFrame]:
    """Per pull request (repository_id, number): totals, and its first `k` dependents.

    Dependents are counted and cut to `k` per file before pull requests join,
    so a file that everything imports and everyone changes never multiplies.
    """
    hits = _targets(edges, symbols).withColumn("changed_file_path", F.coalesce("target_file_path", "_symbol_path"))
    hits = hits.filter("changed_file_path IS NOT NULL").select(
        "repository_id", "changed_file_path", "dependent_file_path", "dependent_symbol_name", "edge_type", "source_symbol_id")
    key = ["repository_id", "changed_file_path"]
    order = [F.col(c).asc() for c in ("dependent_file_path", "dependent_symbol_name", "edge_type", "source_symbol_id")]
    counts = hits.groupBy(*key).agg(F.count("*").alias("_n"))
    heads = top_per_key(hits, key, order, k)
    touched = pr_files.filter("status <> 'removed'").select(
        "repository_id", "number", F.col("filename").alias("changed_file_path")).distinct()
    totals = touched.join(counts, key, "left").groupBy("repository_id", "number").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_dependents")).withColumn("truncated", F.col("total_dependents") > k)
    candidates = touched.join(heads, key)
    listed = top_per_key(candidates, ["repository_id", "number"], [F.col("changed_file_path").asc(), *order], k, rank="position")
    return totals, listed


def named_edges(edges: DataFrame, symbols: DataFrame, k: int = MAX_EDGES) -> DataFrame:
    """The first `k` edges per repository with names and kinds, and the total.

    Names are looked up after the cut, for `k` edges per repository.
    """
    totals = edges.groupBy("repository_id").agg(F.count("*").alias("total_edges"))
    order = [F.col(c).asc_nulls_first() for c in ("source_symbol_id", "edge_type", "target_symbol_id", "target_package_name")]
    first = top_per_key(edges, ["repository_id"], order, k, rank="position")
    sources = symbols.select("repository_id", F.col("id").alias("source_symbol_id"), F.col("name").alias("source"), F.col("kind").alias("source_kind"))
    targets = symbols.select("repository_id", F.col("id").alias("target_symbol_id"), F.col("name").alias("_target"))
    named = first.join(sources, ["repository_id", "source_symbol_id"], "left").join(
        targets, ["repository_id", "target_symbol_id"], "left").join(totals, "repository_id")
    return named.select(
        "repository_id", "position", "source", "source_kind", F.coalesce("_target", "target_package_name").alias("target"),
        "edge_type", "total_edges", (F.col("total_edges") > k).alias("truncated"))


# --- plans ----------------------------------------------------------------------------

def plan_defects(plans: DataFrame) -> DataFrame:
    """Defects of stored plans: missing dependencies, steps that can never run, no validation.

    `plans` has id and `steps`, an array of (id, type, depends_on). A plan is
    one small JSON value, so its check stays inside its row.
    """
    steps = F.col("steps")
    ids = F.transform(steps, lambda s: s["id"])
    missing = F.flatten(F.transform(steps, lambda s: F.transform(
        F.filter(s["depends_on"], lambda d: ~F.array_contains(F.col("_ids"), d)),
        lambda d: F.struct(F.lit("MISSING_DEPENDENCY").alias("defect"), s["id"].alias("step_id"), d.alias("detail")))))
    none = F.array().cast("array<string>")
    done = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), none,
        lambda ready, _: F.array_union(ready, F.transform(
            F.filter(steps, lambda s: F.forall(s["depends_on"], lambda d: F.array_contains(ready, d))), lambda s: s["id"])))
    stuck = F.transform(
        F.array_except(F.col("_ids"), F.col("_done")),
        lambda step: F.struct(F.lit("UNREACHABLE_STEP").alias("defect"), step.alias("step_id"), F.lit(None).cast("string").alias("detail")))
    unvalidated = F.when(
        ~F.exists(steps, lambda s: s["type"] == "validation"),
        F.array(F.struct(F.lit("NO_VALIDATION_STEP").alias("defect"), F.lit(None).cast("string").alias("step_id"),
                         F.lit(None).cast("string").alias("detail"))))
    empty = F.array().cast("array<struct<defect:string,step_id:string,detail:string>>")
    return (
        plans.withColumn("_ids", ids).withColumn("_done", done)
        .select("id", F.inline(F.concat(missing, stuck, F.coalesce(unvalidated, empty)))))
