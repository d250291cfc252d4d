"""Parent-child links to full hierarchies.

Method: nodes are laid out in fragments of bounded size.  Inside a fragment every chain of parents is contracted to
its exit - the first ancestor in another fragment - or to a root, a missing parent or a local cycle.  The exits alone
form the quotient forest, which is much smaller and is solved the same way, recursively; a cycle that spans fragments
becomes a local one at some level.  Then fragments are expanded again with the solutions of their exits.

Every level writes its solution to the shared checkpoint folder, so a lost executor costs a recomputation of one level
at most.  Only counts come to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.session import cut

# End of a chain.
ROOT, MISSING, EXIT, CYCLE, BELOW = 0, 1, 2, 3, 4
SMALL = 200_000  # rows that are broadcast, at most
FAULTS = {MISSING: "detached", CYCLE: "cycle", BELOW: "below_cycle"}

_SOLVED = "id bigint, end_id bigint, steps bigint, kind int, path array<bigint>"
_EDGE = "id bigint, parent bigint, weight bigint, final int, via array<bigint>"


def contract(ids: np.ndarray, parents: np.ndarray, weights: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of one fragment by pointer doubling: ``(end_id, steps, kind)`` of each node.

    ``parents``: -1 where ``final`` gives the chain's end (ROOT or MISSING).  ``kind`` EXIT means that ``end_id`` lies
    outside the fragment.  Nodes on a local cycle are CYCLE, those above which one lies BELOW; both end at -1.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], parents)
    at = np.where(at < n, at, 0)
    inside = (parents >= 0) & (ids[order][at] == parents) if n else np.zeros(0, dtype=bool)
    up = np.where(inside, order[at], np.arange(n))  # ends point at themselves
    gone = np.where(inside, weights, 0)
    jump, steps = up.copy(), gone.copy()
    for _ in range(max(1, int(n).bit_length()) + 1):
        steps = steps + steps[jump]
        jump = jump[jump]
    stops = ~inside
    sound = stops[jump]  # chains that reach an end; the others run into a cycle
    end = jump
    kind = np.where(parents[end] >= 0, EXIT, final[end])
    end_id = np.where(parents[end] >= 0, parents[end], ids[end])
    total = steps + np.where(parents[end] >= 0, weights[end], 0)
    on_cycle = np.zeros(n, dtype=bool)
    on_cycle[jump[~sound]] = True  # after at least n steps a chain stands on its cycle
    walk = np.flatnonzero(on_cycle)
    while len(walk):
        nxt = np.unique(up[walk])
        walk = nxt[~on_cycle[nxt]]
        on_cycle[walk] = True
    kind = np.where(sound, kind, np.where(on_cycle, CYCLE, BELOW))
    return np.where(sound, end_id, -1), np.where(sound, total, 0), kind


def local_paths(ids: np.ndarray, parents: np.ndarray, via: list[np.ndarray], kind: np.ndarray) -> list[np.ndarray]:
    """For each node the ids from just below its end (or from the root itself) down to the node; none below cycles.

    ``via``: the ids between a quotient node's parent and the node, the node last.
    """
    row = {int(x): i for i, x in enumerate(ids)}
    made: list[np.ndarray | None] = [None] * len(ids)
    for i in range(len(ids)):
        if kind[i] in (CYCLE, BELOW):
            made[i] = np.empty(0, dtype=np.int64)
            continue
        chain, j = [], i
        while made[j] is None:
            chain.append(j)
            parent = row.get(int(parents[j]), -1) if parents[j] >= 0 else -1
            if parent < 0:
                break
            j = parent
        prefix = made[j] if made[j] is not None else np.empty(0, dtype=np.int64)
        for k in reversed(chain):
            prefix = np.concatenate([prefix, via[k]])
            made[k] = prefix
    return made  # type: ignore[return-value]


def _fragment(with_paths: bool):
    def solve(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].to_numpy(np.int64)
        parents = group["parent"].fillna(-1).to_numpy(np.int64)
        end, steps, kind = contract(ids, parents, group["weight"].to_numpy(np.int64), group["final"].to_numpy(np.int64))
        via = [np.asarray(v, dtype=np.int64) for v in group["via"]] if with_paths else []
        path = local_paths(ids, parents, via, kind) if with_paths else [None] * len(ids)
        return pd.DataFrame({"id": ids, "end_id": end, "steps": steps, "kind": kind.astype(np.int32), "path": path})

    return solve


def _expand(with_paths: bool):
    def expand(local: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(local):
            return pd.DataFrame({"id": [], "end_id": [], "steps": [], "kind": [], "path": []}).astype({"id": "int64", "end_id": "int64", "steps": "int64", "kind": "int32", "path": object})
        known = {int(r.id): r for r in above.itertuples(index=False)}
        ids, end = local["id"].to_numpy(np.int64), local["end_id"].to_numpy(np.int64).copy()
        steps, kind = local["steps"].to_numpy(np.int64).copy(), local["kind"].to_numpy(np.int64).copy()
        paths = list(local["path"])
        exits = np.flatnonzero(kind == EXIT)
        for i in exits:
            top = known[int(end[i])]
            if top.kind in (CYCLE, BELOW):
                end[i], steps[i], kind[i] = -1, 0, BELOW
                if with_paths:
                    paths[i] = np.empty(0, dtype=np.int64)
            else:
                steps[i] += top.steps
                end[i], kind[i] = top.end_id, top.kind
                if with_paths:
                    paths[i] = np.concatenate([np.asarray(top.path, dtype=np.int64), paths[i]])
        # Exits of other fragments that lie here and stand on a wide cycle: so do the ancestors they have in here.
        row = {int(x): i for i, x in enumerate(ids)}
        parent = local["parent"].fillna(-1).to_numpy(np.int64)
        for r in above.itertuples(index=False):
            j = row.get(int(r.id), -1)
            if r.kind == CYCLE:
                while j >= 0 and kind[j] == BELOW:
                    kind[j] = CYCLE
                    j = row.get(int(parent[j]), -1) if parent[j] >= 0 else -1
        return pd.DataFrame({"id": ids, "end_id": end, "steps": steps, "kind": kind.astype(np.int32), "path": paths})

    return expand


def solve_forest(edges: DataFrame, fragment_rows: int = 50_000, with_paths: bool = False, level: int = 0) -> DataFrame:
    """``id, end_id, steps, kind, path`` for each row of ``edges`` (``id, parent, weight, final, via, tree``).

    ``tree`` names what no parent link crosses (a site), ``near`` - at level 0 - a number under which neighbours lie
    close together; both only steer the layout.  ``fragment_rows`` bounds a fragment.
    """
    sizes = edges.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(sizes) if sizes.count() <= SMALL else sizes
    total = edges.count()
    buckets = max(1, -(-total // fragment_rows))
    # Small trees share fragments whole; larger ones are cut.
    if level == 0:
        piece = F.floor(F.coalesce(F.col("near"), F.col("id")) / max(1, fragment_rows // 2)).cast("bigint")
        placed = edges.join(sizes, "tree").withColumn("piece", piece)
        # Where neighbours' numbers repeat, more nodes than a fragment may hold fall into one piece: it is cut by hash.
        full = placed.where(F.col("n") > fragment_rows).groupBy("tree", "piece").agg(F.ceil(F.count(F.lit(1)) / fragment_rows).cast("bigint").alias("cuts")).where("cuts > 1")
        full = F.broadcast(full) if full.count() <= SMALL else full
        part = F.pmod(F.xxhash64("id"), F.coalesce("cuts", F.lit(1)))
        laid = placed.join(full, ["tree", "piece"], "left").withColumn(
            "frag", F.when(F.col("n") <= fragment_rows, F.pmod(F.xxhash64("tree"), F.lit(buckets))).otherwise(F.xxhash64("tree", "piece", part))
        )
    else:
        # Coin flips: a tail goes where its head parent is, so at least a quarter of all links are contracted,
        # however long the chains are; parents with very many children get their tails spread out.
        head = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 0
        crowded = edges.where("parent is not null").groupBy("parent").count().where(F.col("count") > fragment_rows).select("parent", F.lit(True).alias("crowded"))
        place = F.when(head(F.col("id")) | F.col("parent").isNull() | ~head(F.col("parent")) | F.col("crowded").isNotNull(), F.col("id")).otherwise(F.col("parent"))
        laid = (
            edges.join(crowded, "parent", "left")
            .join(sizes, "tree")
            .withColumn("frag", F.when(F.col("n") <= fragment_rows, F.pmod(F.xxhash64("tree"), F.lit(buckets))).otherwise(F.pmod(F.xxhash64(place), F.lit(buckets)) - F.lit(buckets)))
        )
    laid = laid.select("id", "parent", "weight", "final", "via", "tree", "frag")
    # A single tree in a single fragment solves to its ends; no exit is left then.
    schema = _SOLVED + ", parent bigint, frag bigint, tree string"
    solve = _fragment(with_paths)

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        out = solve(group)
        return out.assign(parent=group["parent"].to_numpy(), frag=group["frag"].to_numpy(), tree=group["tree"].to_numpy())

    local = cut(laid.groupBy("frag").applyInPandas(whole, schema))
    needed = local.where(F.col("kind") == EXIT).select("frag", F.col("end_id").alias("id")).distinct()
    exits = needed.select("id").distinct()
    if exits.isEmpty():
        return local.select("id", "end_id", "steps", "kind", "path")
    # The quotient forest: each exit with the contraction of its own chain as the link upwards.  Exits whose chains
    # close in their own fragment are its roots; their own ends are put in place afterwards.
    own = cut(local.join(exits, "id", "left_semi"))
    leads_on = F.col("kind") == EXIT
    quotient = own.select(
        "id",
        F.when(leads_on, F.col("end_id")).alias("parent"),
        F.when(leads_on, F.col("steps")).otherwise(F.lit(0)).cast("bigint").alias("weight"),
        F.lit(ROOT).alias("final"),
        F.col("path").alias("via"),
        "tree",
    )
    solved = solve_forest(quotient, fragment_rows, with_paths, level + 1)
    closed = own.where(~leads_on).select(F.col("id").alias("end_id"), F.col("end_id").alias("far"), F.col("steps").alias("more"), F.col("kind").alias("how"))
    broken = F.col("how").isin(CYCLE, BELOW)
    above = cut(
        solved.join(closed, "end_id", "left").select(
            "id",
            F.coalesce("far", "end_id").alias("end_id"),
            F.when(broken, F.lit(0)).otherwise(F.col("steps") + F.coalesce("more", F.lit(0))).cast("bigint").alias("steps"),
            F.when(F.col("how").isNull(), F.col("kind")).when(broken & (F.col("id") != F.col("end_id")), F.lit(BELOW)).otherwise(F.col("how")).alias("kind"),
            "path",
        )
    )
    # Solutions go to the fragments that need them, and to those that hold the exits themselves.
    homes = own.select("frag", "id")
    wanted = needed.unionByName(homes).distinct().join(above, "id").withColumnRenamed("frag", "piece")
    return cut(local.groupBy("frag").cogroup(wanted.groupBy("piece")).applyInPandas(_expand(with_paths), _SOLVED))


def resolve_hierarchy(
    rows: DataFrame, row_id: str, key: str, parent_key: str, tree: str, near: str | None = None, fragment_rows: int = 50_000, with_paths: bool = False
) -> DataFrame:
    """One row per node: ``id, tree, key, root_id, depth, fault, path, local_path``, and ``parent`` ``with_paths``.

    ``rows`` may repeat; of several rows with one ``tree`` and ``key`` the least ``row_id`` is the node.  A null or
    empty parent key makes a root.  ``fault``: ``cycle`` for a node that is its own ancestor, ``below_cycle`` for one
    that isn't but has such an ancestor, ``detached`` where the chain ends at a parent key that names no node, else
    null.  ``depth`` and ``root_id`` are null for nodes with a fault, ``path`` (ids from the root to the node, only
    ``with_paths``) is null for them too.  ``parent`` is the parent's id; ``local_path`` is the path, for detached nodes
    that from the top entry of their chain.  Rows with a null id or key are no nodes.  Empty tables give none.
    """
    near_col = F.col(near).cast("bigint") if near else F.lit(None).cast("bigint")
    named = rows.where(F.col(row_id).isNotNull() & F.col(key).isNotNull()).select(
        F.col(row_id).cast("bigint").alias("id"), F.col(key).alias("key"), F.when(F.col(parent_key) != "", F.col(parent_key)).alias("parent_key"),
        F.coalesce(F.col(tree).cast("string"), F.lit("")).alias("tree"), near_col.alias("near"),
    )
    nodes = cut(named.groupBy("tree", "key").agg(F.min(F.struct("id", "parent_key", "near")).alias("m")).select("tree", "key", "m.*"))
    edges = nodes.alias("c").join(nodes.alias("p"), (F.col("c.tree") == F.col("p.tree")) & (F.col("c.parent_key") == F.col("p.key")), "left").select(
        F.col("c.id").alias("id"), F.col("p.id").alias("parent"), F.lit(1).cast("bigint").alias("weight"),
        F.when(F.col("c.parent_key").isNull(), F.lit(ROOT)).otherwise(F.lit(MISSING)).alias("final"),
        F.array(F.col("c.id")).alias("via"), F.col("c.tree").alias("tree"), F.col("c.near").alias("near"),
    )
    edges = cut(edges)
    solved = solve_forest(edges, fragment_rows, with_paths)
    fault = F.create_map(*[F.lit(x) for pair in FAULTS.items() for x in pair])[F.col("kind")]
    sound = F.col("kind") == ROOT
    found = nodes.join(solved, "id").select(
        "id", "tree", "key", F.when(sound, F.col("end_id")).alias("root_id"), F.when(sound, F.col("steps")).alias("depth"), fault.alias("fault"),
        F.when(sound, F.col("path")).alias("path"), F.when(sound | (F.col("kind") == MISSING), F.col("path")).alias("local_path"),
    )
    return found.join(edges.select("id", "parent"), "id") if with_paths else found


def descendants(resolved: DataFrame) -> DataFrame:
    """``ancestor_id, descendant_id, distance`` for every sound node and each of its ancestors; needs the paths."""
    up = resolved.where("fault is null and depth > 0").select("id", "depth", F.posexplode("path").alias("place", "ancestor_id"))
    return up.where("place < depth").select("ancestor_id", F.col("id").alias("descendant_id"), (F.col("depth") - F.col("place")).cast("bigint").alias("distance"))


def preorder(resolved: DataFrame, order: DataFrame) -> DataFrame:
    """``id, root_id, depth, position`` of every sound node: its place in its tree, children by ``ord``; needs the paths.

    ``order``: ``id, ord``.  A node stands behind its parent and behind the whole subtrees of the siblings before it,
    so no tree is ordered in one task: sizes of subtrees are counted, summed among siblings, and added up along paths.
    """
    sound = resolved.where("fault is null").select("id", "root_id", "depth", "parent", "path")
    steps = sound.select("id", F.explode("path").alias("up"))
    sizes = steps.groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    among = Window.partitionBy("parent").orderBy("ord", "id").rowsBetween(Window.unboundedPreceding, -1)
    # Siblings share a parent; roots begin their trees.
    offset = F.when(F.col("parent").isNull(), F.lit(1)).otherwise(F.coalesce(F.sum("size").over(among), F.lit(0)) + 1).cast("bigint")
    placed = sound.join(sizes, "id").join(order, "id").select(F.col("id").alias("up"), offset.alias("offset"))
    position = steps.join(placed, "up").groupBy("id").agg(F.sum("offset").alias("position"))
    return sound.join(position, "id").select("id", "root_id", "depth", "position")


def cycle_paths(resolved: DataFrame, fragment_rows: int = 50_000) -> DataFrame:
    """``id, low, steps, path`` of the nodes on and below cycles; ``resolved`` needs the paths.

    Each cycle is cut above its least id, ``low``; ``path`` leads from there to the node in ``steps`` steps.
    """
    # The least id of each cycle by doubling: ``low`` of a window of nodes upwards, ``jump`` the node right above it.
    state = cut(resolved.where("fault = 'cycle'").select("id", F.col("parent").alias("jump"), F.col("id").alias("low")))
    growing = True
    while growing:
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("low").alias("far_low"))
        grown = cut(state.join(ahead, "jump").select("id", F.col("far").alias("jump"), F.least("low", "far_low").alias("low"), (F.col("far_low") < F.col("low")).alias("moved")))
        growing, state = not grown.where("moved").isEmpty(), grown.drop("moved")
    lows = state.where("id = low").select("id", "low")
    edges = resolved.where("fault in ('cycle', 'below_cycle')").join(lows, "id", "left").select(
        "id", F.when(F.col("low").isNull(), F.col("parent")).alias("parent"), F.lit(1).cast("bigint").alias("weight"), F.lit(ROOT).alias("final"),
        F.array("id").alias("via"), "tree", F.lit(None).cast("bigint").alias("near"),
    )
    return solve_forest(cut(edges), fragment_rows, True).select("id", F.col("end_id").alias("low"), "steps", "path")


def all_descendants(resolved: DataFrame, fragment_rows: int = 50_000) -> DataFrame:
    """``ancestor_id, descendant_id, distance, fault`` for every node and each of its ancestors; needs the paths.

    ``fault`` is the descendant's.  Nodes of a cycle are ancestors of all nodes on and below it, themselves included;
    the distance is that of the shortest way up.
    """
    looped = cut(cycle_paths(resolved, fragment_rows))
    faults = resolved.select("id", "fault")
    open_ended = resolved.where("local_path is not null").select("id", F.col("local_path").alias("path"))
    up = open_ended.unionByName(looped.select("id", "path")).select("id", (F.size("path") - 1).alias("last"), F.posexplode("path").alias("place", "ancestor_id")).where("place < last")
    pairs = up.select("ancestor_id", "id", (F.col("last") - F.col("place")).cast("bigint").alias("distance"))
    # Where a cycle was cut: its nodes that the path doesn't pass lie above its top.
    ring = cut(looped.join(resolved.where("fault = 'cycle'").select("id"), "id").select(F.col("id").alias("ancestor_id"), "low", F.col("steps").alias("rank")))
    sizes = ring.groupBy("low").agg(F.count(F.lit(1)).alias("ring"))
    passed = looped.select("id", F.explode("path").alias("ancestor_id"), "steps").where("id <> ancestor_id").join(ring, "ancestor_id").groupBy("id").agg((F.max("rank") + 1).alias("first"))
    rest = looped.select("id", "low", "steps").join(passed, "id", "left").join(ring, "low").join(sizes, "low").where(F.col("rank") >= F.coalesce("first", F.lit(0)))
    around = rest.select("ancestor_id", "id", (F.col("steps") + F.col("ring") - F.col("rank")).cast("bigint").alias("distance"))
    return pairs.unionByName(around).join(faults, "id").select("ancestor_id", F.col("id").alias("descendant_id"), "distance", "fault")
