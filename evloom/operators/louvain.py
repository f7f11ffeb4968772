"""Communities by modularity: distributed moves of single nodes, then contraction, level by level, until no move gains.

In units of (sum of degrees)² / 2, moving a node of degree k from community C to D gains
    M (w_D - w_C) - k (S_D - S_C + k)
with M the sum of degrees, w_X the weight between the node and X's other nodes, S_X the degrees of X.  Weights are whole numbers, so
this is exact.  Many nodes move in one round: what its nodes and neighbours stand to gain, or every fourth time a coin, makes each community a giver or a taker, and behind earlier movers of the same giver or taker with
degrees K a node may move only if its gain exceeds k K, which is all that those moves can take from it.  So each round gains, in the end no
community would gain by joining another, and nothing is bounded by a number of rounds.

Movers of one community are ordered by a random class of geometric size, so sums for at most 64 classes a community stand in for a window over its
nodes, and a community that all nodes want is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.operators.shared import cut, drop

#: Weights are counted in units of this.
UNIT = 1_000_000
#: A level ends early, and its communities are contracted, once a round moves less than this part of its nodes; the last level, which moves none, has no such end.
FEW = 0.1
WIDE = "decimal(38,0)"


def _coin(label: str):
    return F.xxhash64(label, "turn").bitwiseAND(F.lit(1))


def _behind(moves: DataFrame, by: str) -> DataFrame:
    """by, cls, and K: the degrees of movers in rarer classes and the own one."""
    sums = moves.groupBy(by, "cls").agg(F.sum("k").alias("K"))
    return sums.withColumn("K", F.expr(f"sum(K) over (partition by {by} order by cls desc)")).withColumnRenamed(by, f"_{by}").withColumnRenamed("cls", f"_c_{by}").withColumnRenamed("K", f"K_{by}")


def _round(ways: DataFrame, at: DataFrame, coin: bool) -> DataFrame | None:
    """One round: the nodes' new places and whether they are fresh, or None if no single move would gain. ways: a, b, w both ways; at: node, label, k, total, turn.

    Total and turn are columns, so that each round runs the same compiled code.
    """
    sums = at.groupBy("label").agg(F.sum("k").alias("s"))
    links = ways.join(at.select(F.col("node").alias("b"), F.col("label").alias("to")), "b").groupBy("a", "to").agg(F.sum("w").alias("w"))
    links = links.join(at.select(F.col("node").alias("a"), "label", "k", "total", "turn"), "a")
    inside = links.where("to = label").select("a", F.col("w").alias("inside"))
    options = links.where("to != label").join(inside, "a", "left").join(sums.select(F.col("label").alias("to"), F.col("s").alias("s_to")), "to").join(sums.withColumnRenamed("s", "s_from"), "label")
    wide = lambda c: c.cast("decimal(19,0)")
    gain = (wide(F.col("total")) * wide(F.col("w") - F.coalesce("inside", F.lit(0)))).cast(WIDE) - (wide(F.col("k")) * wide(F.col("s_to") - F.col("s_from") + F.col("k"))).cast(WIDE)
    options = options.withColumn("gain", gain.cast(WIDE)).where("gain > 0")
    if coin:
        options = options.withColumn("fits", (_coin("label") == 0) & (_coin("to") == 1))
    else:
        options = options.withColumn("fits", F.lit(True))
    best = options.groupBy("a", "label", "k", "turn").agg(F.max(F.when(F.col("fits"), F.struct("gain", (-F.col("to")).alias("to")))).alias("m"))
    best = cut(best.select("a", "label", "k", "turn", "m.gain", (-F.col("m.to")).alias("to")), "best")
    if best.isEmpty():
        drop(best)
        return None
    moves = best.where("to is not null")
    if not coin:
        # A community that stands to win more than to lose takes, another one gives; of those that break even some do the one, some the other.
        ways_in = moves.select(F.col("to").alias("c"), "turn", F.col("gain").cast("double").alias("g")).unionAll(moves.select("label", "turn", -F.col("gain").cast("double"))).groupBy("c").agg(F.sum("g").alias("g"), F.max("turn").alias("turn"))
        takes = ways_in.select("c", F.when(F.col("g") == 0, _coin("c") == 1).otherwise(F.col("g") > 0).alias("takes"))
        moves = moves.join(takes.where("takes").select(F.col("c").alias("to")), "to").join(takes.where("not takes").select(F.col("c").alias("label")), "label")
    # The class: how many zeros a random number ends with.
    cls = F.length(F.regexp_extract(F.lpad(F.bin(F.xxhash64("turn", "a")), 64, "0"), "0*$", 0))
    moves = moves.withColumn("cls", cls)
    moves = moves.join(_behind(moves, "to"), (F.col("to") == F.col("_to")) & (F.col("cls") == F.col("_c_to"))).join(_behind(moves, "label"), (F.col("label") == F.col("_label")) & (F.col("cls") == F.col("_c_label")))
    before = (wide(F.col("k")) * wide(F.col("K_to") + F.col("K_label") - 2 * F.col("k"))).cast(WIDE)
    moves = moves.where(F.col("gain") > before).select(F.col("a").alias("node"), F.col("to").alias("moved"))
    out = cut(at.join(moves, "node", "left").select("node", F.coalesce("moved", "label").alias("label"), "k", "total", (F.col("turn") + 1).alias("turn"), F.col("moved").isNotNull().alias("fresh")), "places")
    drop(best)
    return out


def louvain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: label is the least node of the community.

    nodes: one column of whole numbers; edges: a, b, sim (weight above 0; in millionths, smaller ones are left out).  Edges of the same ends add up; ends that aren't nodes
    are left out with their edges, and so are nulls.  A node without edges is a community.
    """
    ids = nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null").distinct()
    w = F.round(F.col("sim") * UNIT).cast("long")
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), w.alias("w")).where("w > 0").groupBy("a", "b").agg(F.sum("w").alias("w"))
    e = e.join(ids.select(F.col("node").alias("a")), "a", "left_semi").join(ids.select(F.col("node").alias("b")), "b", "left_semi")
    level = cut(e.select("a", "b", "w"), "level")
    member = cut(ids.select("node", F.col("node").alias("label")), "member")
    while True:
        ways = cut(level.where("a != b").unionAll(level.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "ways")
        degrees = ways.select(F.col("a").alias("node"), F.col("w").alias("k")).unionAll(level.where("a = b").select("a", 2 * F.col("w"))).groupBy("node").agg(F.sum("k").alias("k"))
        total = level.agg(2 * F.sum("w")).first()[0] or 0
        at = cut(degrees.select("node", F.col("node").alias("label"), "k", F.lit(total).cast("long").alias("total"), F.lit(0).alias("turn")), "places")
        moved, turn, before = False, 0, None
        while True:
            new = _round(ways, at, turn % 4 == 3)
            if new is None:
                break
            drop(at)
            at, turn = new.drop("fresh"), turn + 1
            n, fresh = new.agg(F.count("*"), F.count_if("fresh")).first()
            moved |= fresh > 0
            if moved and fresh < FEW * n:
                break
        drop(ways)
        if not moved:
            break
        # Labels by their least member, and the graph of communities.
        names = at.groupBy("label").agg(F.min("node").alias("name"))
        at_names = cut(at.join(names, "label").select("node", "name"), "names")
        left, right = at_names.select(F.col("node").alias("a"), F.col("name").alias("na")), at_names.select(F.col("node").alias("b"), F.col("name").alias("nb"))
        merged = level.join(left, "a").join(right, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w"))
        before, level = level, cut(merged, "level")
        drop(before)
        up = at_names.select(F.col("node").alias("label"), "name")
        before, member = member, cut(member.join(up, "label", "left").select("node", F.coalesce("name", "label").alias("label")), "member")
        drop(before)
        drop(at_names)
        drop(at)
    drop(level)
    drop(at)
    # Names come from least members level by level, so a label is its community's least node.
    return member


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of a partition (node, label), over edges a, b, sim; 0 without edges."""
    w = F.round(F.col("sim") * UNIT).cast("double")
    left, right = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    e = edges.select("a", "b", w.alias("w")).where("w > 0").join(left, "a").join(right, "b")
    ends = e.select(F.col("la").alias("label"), "w").unionAll(e.select("lb", "w")).groupBy("label").agg(F.sum("w").alias("s"))
    inside = e.where("la = lb").groupBy(F.col("la").alias("label")).agg((2 * F.sum("w")).alias("i"))
    by = ends.join(inside, "label", "left")
    r = by.agg(F.sum("s").alias("m"), F.sum(F.coalesce("i", F.lit(0.0))).alias("i"), F.sum(F.col("s") * F.col("s")).alias("q")).first()
    return r["i"] / r["m"] - r["q"] / r["m"] ** 2 if r["m"] else 0.0
