"""Connected components by alternating large-star and small-star steps.

Edges are a DataFrame ``(u BIGINT, v BIGINT)``.  A large-star step links every
larger neighbour of a node to the smallest node of its neighbourhood, a
small-star step every smaller one; both keep the components and shrink the
graph to stars within O(log^2 n) rounds.  Each step is an aggregation (with a
map-side part, so a hub is no hot group) and a join of edges to one row per
node; hubs that hold a large share of the edges are joined by broadcast of that
bounded number of rows.  The edge table is cut in the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import HOT_ROWS, cut, join_unique


def _canonical(edges: DataFrame) -> DataFrame:
    """Edges as (larger, smaller), once each, without loops and nulls."""
    return edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Edges with the least node of their u; a graph of fewer edges than a hot key has takes a plain join."""
    right = least.select("u", "m")
    return edges.join(right, "u") if n <= HOT_ROWS // 2 else join_unique(edges, right, ["u"], counts=least)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    larger = both.where("v > u")
    return _with_least(larger, least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    linked = _with_least(edges, least, n)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node of it.

    Loops, repeated edges and null ends are ignored; no edges give an empty result.
    """
    now = cut(_canonical(edges), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        now = cut(_canonical(_small_star(cut(_canonical(_large_star(now, state[0])), "half"), state[0])), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (row[0], row[1])


def record_components(records: DataFrame, key: str, entities: list, carry: list[str] | None = None) -> DataFrame:
    """(key, carried columns, component) of records that share any entity, by star steps over record-entity edges.

    Every record is a node and so is every entity; an edge joins a record to
    each of its entities.  Entity nodes are the negative 63-bit hashes and
    record nodes the others, so a component's smallest node is an entity and
    its edges start out pointing at one.  A null entity links nothing, a record
    without any is a component of its own (its record node), and rows that
    repeat a key are one record.  Two of a billion records share a node
    with odds of one in twenty.  Unlike ``entity_components`` the graph has one edge a
    record and entity, which the star steps must carry.
    """
    low, high = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    tagged = [F.when(F.col(e).isNotNull() if isinstance(e, str) else e.isNotNull(), F.xxhash64(F.lit(i), e).bitwiseOR(low)) for i, e in enumerate(entities)]
    kept = [key, *(carry or [])]
    rows = records.select(*kept, F.xxhash64(F.lit("record"), F.col(key)).bitwiseAND(high).alias("node"), F.array_compact(F.array(*tagged)).alias("e"))
    rows = cut(rows, "records")
    found = connected_components(rows.select(F.col("node").alias("u"), F.explode("e").alias("v")))
    return rows.join(found.where("node >= 0"), "node", "left").select(*kept, F.coalesce("component", "node").alias("component"))


def entity_components(records: DataFrame, key: str, entities: list, carry: list[str] | None = None) -> DataFrame:
    """(key, carried columns, component) of records that share any entity, directly or through others.

    ``entities`` are columns (names or expressions), each one kind of entity;
    a null entity links nothing.  The graph is over entity hashes, one edge for
    each pair of entities that meet in a record (pre-aggregated), so a source
    with a third of all records adds no more edges than a small one.
    A record without any entity is a component of its own.
    """
    tagged = [F.when(F.col(e).isNotNull() if isinstance(e, str) else e.isNotNull(), F.xxhash64(F.lit(i), e)) for i, e in enumerate(entities)]
    own = F.xxhash64(F.lit("record"), F.col(key))
    kept = [key, *(carry or [])]
    rows = records.select(*kept, F.array_compact(F.array(*tagged)).alias("e")).select(*kept, F.when(F.size("e") > 0, F.col("e")).otherwise(F.array(own)).alias("e"))
    links = rows.where("size(e) > 1").select(F.col("e")[0].alias("u"), F.explode(F.slice("e", 2, len(entities))).alias("v")).distinct()
    links = cut(links, "links")
    keyed = rows.select(*kept, F.col("e")[0].alias("node"))
    if not links.limit(1).count():  # no record has two entities: each entity is a component
        return keyed.select(*kept, F.col("node").alias("component"))
    found = connected_components(links)
    return join_unique(keyed, found, ["node"], "left").select(*kept, F.coalesce("component", "node").alias("component"))
