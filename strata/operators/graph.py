"""Operators over import graphs: nodes (repo, rel_path), edges (repo, src, dst), a bag with self-edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.paths import top_folder
from strata.functions.rules import cycle_type, ratio
from strata.storage import discard, written

#: Repositories with more distinct edges than this are not handed to a single task.
LOCAL_EDGES = 500_000
#: Edges of a task that condenses its own part of a larger graph, about.
PART_EDGES = 200_000
COMPONENT = "repo string, component string, rel_path string"
#: Into how many places the rows of one repository are dealt where they meet its own facts.
SALTS = 64
#: Edges out, and as many in, that every node of a dense graph gives to its first components.
FEW = 2
#: So many names of nodes at most are sent to all tasks, some 40 MB; more are joined.
SENT = 1_000_000


def with_facts(rows: DataFrame, facts: DataFrame, key: str = "rel_path") -> DataFrame:
    """Rows of repositories beside their repository's facts (one row a repository), as an inner join by ``repo`` has them.

    A repository may hold all rows: its rows are dealt by ``key`` to ``SALTS`` places, and its facts have a copy in each. Where
    the facts are few, by Spark's own measure of their size, they are broadcast instead.
    """
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("__salt")
    copies = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return rows.select("*", salt).join(copies, ["repo", "__salt"]).drop("__salt")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree of every node; edges count as often as they occur, those from or to other nodes do not."""
    ends = edges.select("repo", F.col("dst").alias("rel_path"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    ends = ends.unionByName(edges.select("repo", F.col("src").alias("rel_path"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    counted = ends.groupBy("repo", "rel_path").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("repo", "rel_path").join(counted, ["repo", "rel_path"], "left").na.fill(0, ["in_degree", "out_degree"])


def max_in_degree_file(degree: DataFrame) -> DataFrame:
    """The most depended-on file of each repo; ties go to the smaller path."""
    best = F.min(F.struct((-F.col("in_degree")).alias("n"), F.col("rel_path").alias("path")))
    return degree.groupBy("repo").agg(best.alias("b")).select("repo", F.col("b.path").alias("max_in_degree_file"), (-F.col("b.n")).alias("max_in_degree"))


def core_modules(degree: DataFrame) -> DataFrame:
    """Files with a degree, by the mean of their normalised degrees (unrounded)."""
    top = degree.groupBy("repo").agg(F.greatest(F.max("in_degree"), F.lit(1)).alias("i"), F.greatest(F.max("out_degree"), F.lit(1)).alias("o"))
    active = degree.where((F.col("in_degree") > 0) | (F.col("out_degree") > 0))
    active = with_facts(active, top)
    x = active.withColumn("normalized_in", F.col("in_degree").cast("double") / F.col("i")).withColumn("normalized_out", F.col("out_degree").cast("double") / F.col("o"))
    score = ((F.col("normalized_in") + F.col("normalized_out")) / 2.0).alias("centrality_score")
    return x.select("repo", F.col("rel_path").alias("path"), "in_degree", "out_degree", "normalized_in", "normalized_out", score)


def god_modules(stats: DataFrame, degree: DataFrame, lines: int = 800) -> DataFrame:
    """Files over ``lines`` whose degree exceeds the repo's upper median."""
    x = stats.select("repo", "rel_path", "lines").join(degree, ["repo", "rel_path"], "left").na.fill(0, ["in_degree", "out_degree"])
    x = x.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    hub = with_facts(x, upper_median(x, "degree")).where((F.col("lines") > lines) & (F.col("degree") > F.col("median")))
    return hub.select("repo", F.col("rel_path").alias("path"), "lines", "in_degree", "out_degree")


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """(repo, median): the value at the middle of each repo's values from the greatest down, the first of two middle ones.

    Read from a histogram: its size, and every state, is bounded by the distinct values, not by the rows.
    """
    counts = rows.groupBy("repo", F.col(value).alias("v")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("repo").orderBy(F.desc("v"))
    total = F.sum("n").over(Window.partitionBy("repo"))
    reached = counts.select("repo", "v", F.sum("n").over(down).alias("upto"), total.alias("total")).where(2 * F.col("upto") >= F.col("total"))
    return reached.groupBy("repo").agg(F.max("v").alias("median"))


def bottlenecks(stats: DataFrame, degree: DataFrame, share: float = 0.30) -> DataFrame:
    """Files that hold at least ``share`` of both the functions and the imports of their repo."""
    x = stats.select("repo", "rel_path", "function_count").join(degree.select("repo", "rel_path", "in_degree"), ["repo", "rel_path"])
    totals = x.groupBy("repo").agg(F.sum("function_count").alias("functions"), F.sum("in_degree").alias("imports"))
    x = with_facts(x, totals.where("functions > 0 AND imports > 0"))
    x = x.withColumn("function_share", ratio(F.col("function_count"), F.col("functions"))).withColumn("import_share", ratio(F.col("in_degree"), F.col("imports")))
    return x.where((F.col("function_share") >= share) & (F.col("import_share") >= share)).select("repo", F.col("rel_path").alias("path"), "function_share", "import_share")


def folder_coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For every folder the other folders it depends on."""
    f = edges.select("repo", top_folder(F.col("src")).alias("folder"), top_folder(F.col("dst")).alias("other"))
    every = nodes.select("repo", top_folder(F.col("rel_path")).alias("folder"), F.lit(None).cast("string").alias("other"))
    met = F.collect_set(F.when(F.col("folder") != F.col("other"), F.col("other")))
    x = f.unionByName(every).distinct().groupBy("repo", "folder").agg(F.array_sort(met).alias("depends_on"))
    return x.select("repo", "folder", F.size("depends_on").alias("external_dependencies"), "depends_on")


def edge_totals(edges: DataFrame) -> DataFrame:
    """Edges, those between folders, their share, and whether imports look unresolved."""
    cross = F.count_if(top_folder(F.col("src")) != top_folder(F.col("dst")))
    x = edges.groupBy("repo").agg(F.count("*").alias("total_edges"), cross.alias("cross_edges"))
    share = ratio(F.col("cross_edges"), F.col("total_edges"))
    return x.withColumn("cross_folder_ratio", share).withColumn("possible_import_resolution_issue", (F.col("total_edges") > 0) & (F.col("cross_folder_ratio") == 0))


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Folder pairs in which a lower layer imports a higher one. layers: repo, layer_order; a repeated name has its last place."""
    place = layers.select("repo", F.posexplode("layer_order").alias("pos", "folder")).groupBy("repo", "folder").agg(F.max("pos").alias("pos"))
    pairs = edges.select("repo", top_folder(F.col("src")).alias("importer_folder"), top_folder(F.col("dst")).alias("imported_folder")).distinct()
    low = place.select("repo", F.col("folder").alias("importer_folder"), F.col("pos").alias("low"))
    high = place.select("repo", F.col("folder").alias("imported_folder"), F.col("pos").alias("high"))
    x = pairs.join(low, ["repo", "importer_folder"]).join(high, ["repo", "imported_folder"])
    return x.where("low < high").select("repo", "importer_folder", "imported_folder")


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected components of one repo's edges, with explicit stacks instead of recursion."""
    ids = {p: i for i, p in enumerate(sorted(set(pdf["src"]) | set(pdf["dst"])))}
    names, out = list(ids), [[] for _ in ids]
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        out[ids[a]].append(ids[b])
    order: list[int] = []  # by the end of a depth-first search
    seen = [False] * len(names)
    for root in range(len(names)):
        stack = [] if seen[root] else [(root, iter(out[root]))]
        seen[root] = True
        while stack:
            v, nexts = stack[-1]
            for w in nexts:
                if not seen[w]:
                    seen[w] = True
                    stack.append((w, iter(out[w])))
                    break
            else:
                order.append(v)
                stack.pop()
    back: list[list[int]] = [[] for _ in names]
    for v, ws in enumerate(out):
        for w in ws:
            back[w].append(v)
    head = [-1] * len(names)
    for root in reversed(order):  # each search against the edges stays in one component
        if head[root] >= 0:
            continue
        head[root], todo, own = root, [root], [root]
        while todo:
            for w in back[todo.pop()]:
                if head[w] < 0:
                    head[w] = root
                    todo.append(w)
                    own.append(w)
        least = min(own)
        for v in own:
            head[v] = least + len(names)  # the smallest path of the component
    repo = pdf["repo"].iloc[0]
    return pd.DataFrame({"repo": repo, "component": [names[h - len(names)] for h in head], "rel_path": names})


def permuted(x: Column, seed: int, back: bool = False) -> Column:
    """A 64-bit number's place in a random order of all of them, or ``back`` the number at a place: halves that are mixed into each other."""
    half = F.lit(0xFFFFFFFF)
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(half)
    for k in (2, 1, 0) if back else (0, 1, 2):
        mixed = lambda v, k=k: F.xxhash64(F.lit(seed), F.lit(k), v).bitwiseAND(half)
        high, low = (low.bitwiseXOR(mixed(high)), high) if back else (low, high.bitwiseXOR(mixed(low)))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct().unionByName(edges.select(F.col("dst").alias("id")).distinct()).distinct()


def _after(*old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    out = written(new, name)
    discard(*old)
    return out


def _named(label: DataFrame, found: DataFrame) -> DataFrame:
    """label (id, component) after the components that ``found`` (id, component) gives to some of its components."""
    x = label.join(found.select(F.col("id").alias("component"), F.col("component").alias("further")), "component", "left")
    return x.select("id", F.coalesce("further", "component").alias("component"))


def _own_components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, component) of the nodes that lie in cycles of a task's own edges."""
    held = [b for b in batches if len(b)]
    if held:
        found = _components(pd.concat(held, ignore_index=True).assign(repo=""))
        found = found[found.groupby("component")["rel_path"].transform("size") > 1]
        yield pd.DataFrame({"id": found["rel_path"].astype("int64"), "component": found["component"].astype("int64")})


def condensed(edges: DataFrame, n: int, part_edges: int = PART_EDGES) -> DataFrame | None:
    """(id, component) of the nodes that lie in cycles of some task's own edges, written; None where there are none. n: the edges' number.

    Edges are dealt by ranges of their source, so that folders stay together. As all edges from a node lie in one task, a node is in a cycle
    of one task at most.
    """
    dealt = edges.repartitionByRange(max(1, -(-n // part_edges)), "src")
    found = written(dealt.select("src", "dst").mapInPandas(_own_components, "id long, component long"), "scc-own")
    if found.isEmpty():
        discard(found)
        return None
    return found


def renamed(edges: DataFrame, names: DataFrame, few: bool = False) -> DataFrame:
    """Distinct edges between the components that ``names`` (id, component) gives to some of their ends; ``few`` names are sent to all tasks."""
    x = edges
    for end in ("src", "dst"):
        n = names.select(F.col("id").alias(end), "component")
        x = x.join(F.broadcast(n) if few else n, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    return x.where("src <> dst").select("src", "dst").distinct()


def least_reaching(nodes: DataFrame, edges: DataFrame, log: list[str] | None = None, both: bool = False) -> DataFrame:
    """(id, colour): the least node from which each node is reached, itself included; written. ``both``: edges go both ways.

    In a round a node takes the first colour of those before it, and its colour's own colour, which reaches it too. Where the ids are
    in random order, the colour lies anywhere on the way behind a node, so that the way it stands for grows by half in a round: the rounds
    follow the logarithm of the longest path. Where edges go both ways, a colour's nodes all take what any of them takes. ``log`` gets an
    entry for each round.
    """
    if both:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    colour = nodes.select("id", F.col("id").alias("colour"))
    held = None
    while True:
        came = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("near"))
        step = colour.join(came, "id", "left").select("id", F.least("colour", F.coalesce("near", "colour")).alias("new"), "colour")
        if both:
            step = step.join(step.groupBy("colour").agg(F.min("new").alias("near")), "colour").select("id", F.col("near").alias("new"), "colour")
        jump = colour.select(F.col("id").alias("new"), F.col("colour").alias("further"))
        step = written(step.join(jump, "new", "left").select("id", F.least("new", F.coalesce("further", "new")).alias("new"), "colour"), "scc-colour")
        if held is not None:
            discard(held)
        held = step
        colour = step.select("id", F.col("new").alias("colour"))
        if log is not None:
            log.append("round")
        if step.where("new <> colour").isEmpty():
            return colour


def _coloured(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """The edges within a colour, with it."""
    c = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour"))
    x = edges.join(c("src"), "src").join(c("dst"), "dst").where("src_colour = dst_colour")
    return x.select("src", "dst", F.col("src_colour").alias("colour"))


def _by_joins(label: DataFrame, left: DataFrame, trims: int, part_edges: int, log: list[str] | None, weak: bool = False) -> DataFrame:
    """label after the components of the edges ``left``, both written and replaced, over all tasks. Nodes get the first node that reaches
    them as a colour, where ``weak`` at first against the edges too. A component lies in one colour, so that colours small enough for a task are solved in
    one, many together. In the others, what reaches the colour's root is its component, and the rest goes on: a few rounds take off nodes
    without edges in or out.
    """
    within = lambda e, n: e.join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    against = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seed = 0
    while not left.isEmpty():
        for _ in range(trims if seed else 0):
            core = written(left.select(F.col("src").alias("id")).distinct().join(left.select(F.col("dst").alias("id")).distinct(), "id"), "scc-core")
            left = _after(left, new=within(left, core), name="scc-edges")
            discard(core)
        seed += 1
        left = _after(left, new=left.select(permuted(F.col("src"), seed).alias("src"), permuted(F.col("dst"), seed).alias("dst")), name="scc-edges")
        nodes = written(_ends(left), "scc-nodes")
        colour = least_reaching(nodes, left, log, both=weak and seed == 1)
        inner = _after(left, nodes, new=_coloured(left, colour), name="scc-inner")
        sizes = written(inner.groupBy("colour").agg(F.count("*").alias("n")), "scc-sizes")
        is_large = F.col("n") > part_edges
        large = F.broadcast(sizes.where(is_large).select("colour"))  # one for part_edges edges at most
        n = sizes.where(~is_large).agg(F.sum("n")).first()[0] or 0
        dealt = inner.join(large, "colour", "left_anti").repartition(max(1, -(-n // part_edges)), "colour")
        found = dealt.select("src", "dst").mapInPandas(_own_components, "id long, component long")
        more = inner.join(large, "colour", "left_semi").select("src", "dst")
        held = [inner, sizes, colour]
        if not (weak and seed == 1) and not sizes.where(is_large).isEmpty():
            many = written(against(more), "scc-back")
            nodes = written(_ends(many), "scc-nodes")
            back = least_reaching(nodes, many, log).withColumnRenamed("colour", "reached")
            rooted = written(colour.join(back, "id").where("reached = colour").select("id", F.col("colour").alias("component")), "scc-found")
            found = found.unionByName(rooted)  # the root is the first node of its colour
            gone = lambda end: rooted.select(F.col("id").alias(end))
            more = against(many).join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti")
            held += [many, nodes, back, rooted]
        origin = lambda x: permuted(F.col(x), seed, back=True).alias(x)
        label = _after(label, new=_named(label, found.select(origin("id"), origin("component"))), name="scc-label")
        left = _after(*held, new=more.select(origin("src"), origin("dst")), name="scc-edges")
    discard(left)
    return label


def few_edges(edges: DataFrame, k: int = FEW) -> DataFrame:
    """Of every node k edges out and k in at most, by chance."""
    kinds = []
    for one, other in (("src", "dst"), ("dst", "src")):
        least = edges.groupBy(one).agg(*(F.min(permuted(F.col(other), -1 - i)).alias(f"p{i}") for i in range(k)))
        ids = F.explode(F.array_distinct(F.array(*(permuted(F.col(f"p{i}"), -1 - i, back=True) for i in range(k)))))
        kinds.append(least.select(one, ids.alias(other)).select("src", "dst"))
    return kinds[0].unionByName(kinds[1]).distinct()


def _condensed_as_far(label: DataFrame, left: DataFrame, n: int, part_edges: int) -> tuple[DataFrame, DataFrame]:
    """label and edges after tasks have condensed the cycles of their own edges to one node each, as long as that shrinks the graph."""
    while n and (found := condensed(left, n, part_edges)) is not None:
        label = _after(label, new=_named(label, found), name="scc-label")
        left = _after(left, found, new=renamed(left, found), name="scc-edges")
        before, n = n, left.count()
        if n > 0.8 * before:
            break
    return label, left


def numbered_components(nodes: DataFrame, edges: DataFrame, local_edges: int, trims: int = 3, part_edges: int = PART_EDGES, log: list[str] | None = None) -> DataFrame:
    """(repo, component, rel_path) of all nodes of edges, written, over all tasks. nodes: repo, rel_path, id; edges: src, dst, distinct, written and replaced.

    Where edges are many for each node, the components of a few edges of every node come first: they lie within those of all edges, which
    then go on between them. Tasks condense the cycles of their own edges; repositories that are then small enough are solved in one task
    each, and the rest by joins. All edges that no component holds are looked at until the last step.

    Whether a repository is small enough is told to its edges where they lie: no join by repository alone brings them together.
    Every round is written to the shared folder and deleted when the next one is; nothing but counts is collected.
    """
    label = written(_ends(edges).select("id", F.col("id").alias("component")), "scc-label")
    m, n = label.count(), edges.where("src <> dst").count()
    left = edges.where("src <> dst")
    dense = n > 4 * FEW * m  # its ways are short, those of others may be long
    while n > 4 * FEW * m:  # else few edges are not much fewer
        label = _by_joins(label, written(few_edges(left), "scc-few"), trims, part_edges, log, weak=True)
        names = label.where("id <> component")
        if names.isEmpty():
            break
        left = _after(left, new=renamed(left, names, names.count() <= SENT), name="scc-edges")
        before, n = n, left.count()
        m = _ends(left).count()
        if n > 0.8 * before:
            break
    label, left = _condensed_as_far(label, left, n, part_edges)
    if local_edges:
        left = _after(left, new=left.join(nodes.select(F.col("id").alias("src"), "repo"), "src"), name="scc-edges")
        large = left.groupBy("repo").agg((F.count("*") > local_edges).alias("large"))
        left = _after(left, new=with_facts(left, large, "src"), name="scc-sized")
        whole = lambda pdf: next(_own_components(iter([pdf])))
        done = left.where("NOT large").select("repo", "src", "dst").groupBy("repo").applyInPandas(whole, "id long, component long")
        label = _after(label, new=_named(label, done), name="scc-label")
        left = _after(left, new=left.where("large").select("src", "dst"), name="scc-edges")
    else:
        left = _after(left, new=left, name="scc-edges")
    label = _by_joins(label, left, trims, part_edges, log, weak=dense)
    x = nodes.join(label, "id")
    least = x.groupBy("component").agg(F.min("rel_path").alias("least"))
    x = x.join(least, "component").select("repo", F.col("least").alias("component"), "rel_path")
    return _after(label, new=x, name="scc-components")


def _large_components(edges: DataFrame, local_edges: int, part_edges: int = PART_EDGES, log: list[str] | None = None) -> DataFrame:
    """:func:`numbered_components` of edges between paths. Numbers follow the paths, so that folders stay together."""
    keys = ["repo", "rel_path"]
    held = written(edges.distinct(), "scc-paths")
    ends = [held.select("repo", F.col(c).alias("rel_path")).distinct() for c in ("src", "dst")]
    nodes = written(ends[0].unionByName(ends[1]).distinct().orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("id")), "scc-paths")
    x = held
    for end in ("src", "dst"):
        x = x.withColumnRenamed(end, "rel_path").join(nodes, keys).drop("rel_path").withColumnRenamed("id", end)
    x = _after(held, new=x.select("src", "dst"), name="scc-edges")
    out = numbered_components(nodes, x, local_edges, part_edges=part_edges, log=log)
    discard(nodes)
    return out


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES, part_edges: int = PART_EDGES, log: list[str] | None = None) -> DataFrame:
    """(repo, component, rel_path) of all nodes of edges; a component is named by its smallest path.

    Where the edges of every repo are counted to fit a task, each is solved in one; else all go over all tasks, as no task must read the edges of a
    larger one.
    """
    edges = edges.select("repo", "src", "dst").distinct()
    counts = edges.groupBy("repo").agg(F.count("*").alias("n"))
    if local_edges and counts.where(F.col("n") > local_edges).isEmpty():
        return edges.groupBy("repo").applyInPandas(_components, COMPONENT)
    return _large_components(edges, local_edges, part_edges=part_edges, log=log)


def cycles(components: DataFrame) -> DataFrame:
    """Components of two nodes or more as sorted arrays; a self-edge alone is no cycle."""
    x = components.groupBy("repo", "component").agg(F.array_sort(F.collect_list("rel_path")).alias("nodes"))
    return x.where(F.size("nodes") > 1).select("repo", "nodes")


def closed(nodes):
    """A cycle with its first node repeated at its end."""
    return F.array_append(nodes, F.element_at(nodes, 1))


def cycle_analysis(cycle: DataFrame) -> DataFrame:
    n = F.size("nodes")
    folders = F.array_sort(F.array_distinct(F.transform("nodes", top_folder)))
    return cycle.select("repo", cycle_type(n).alias("type"), n.alias("length"), F.col("nodes").alias("files"), folders.alias("folders"), (2 * n).alias("risk_score"))


def tight_pairs(cycle: DataFrame) -> DataFrame:
    return cycle.where(F.size("nodes") == 2).select("repo", F.col("nodes")[0].alias("a"), F.col("nodes")[1].alias("b"))


def top_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of each repo. Spark cuts each task's rows of a repo to n before they are exchanged."""
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
