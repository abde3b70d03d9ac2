"""Sharding by balanced label propagation under quotas.

Linked rows (equal texts) are each other's neighbours. They start in shards drawn by a hash, and rounds of Spark
joins move each group towards the shard that holds most of it and has room. A shard's quota is an even share of all
rows; an overfull shard keeps its largest groups and turns others away, which then try the next one. So no group is cut
that a shard has room for, and a group larger than a shard fills whole shards and takes one more for its rest. Rows
without links, which have no neighbours to follow, then fill the shards up to one level, which makes the sizes even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import running_total, square_root_buckets
from labelloom.operators.ordering import prefix_sums
from labelloom.session import stored

Parts = dict[str, list[float]]


def sharded_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, anchor, key`` of each row; equal texts share an anchor, null counts as empty."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(text.cast("binary")).alias("anchor"),
    ).withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "anchor").cast("binary")))


def labelled_groups(rows: DataFrame, shards: int) -> DataFrame:
    """``anchor, size, prefs`` of every group of linked rows: all shards, those first that hold most of the group.

    Rows start in shards drawn by a hash; shards that hold equally much follow a hash of group and shard.
    """
    label = F.pmod(F.xxhash64("key", F.lit("first")), F.lit(shards)).cast("int").alias("label")
    held = rows.groupBy("anchor", label).agg(F.sum("size").alias("held"), F.count("*").alias("n"))
    groups = held.groupBy("anchor").agg(
        F.sum("held").alias("size"), F.sum("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("label", "held"))).alias("held"),
    )
    near = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(
            (-F.coalesce(F.element_at("held", s), F.lit(0))).alias("held"), F.xxhash64("anchor", s).alias("tie"), s.alias("shard")
        ),
    )
    return groups.where("n > 1").select("anchor", "size", F.sort_array(near)["shard"].alias("prefs"))


def units_of(groups: DataFrame, capacity: int) -> DataFrame:
    """``anchor, unit, size, prefs``: groups cut into as many whole shards as they fill, and a rest.

    At most one whole shard for each shard exists. The units of one group begin with different shards.
    """
    whole = (F.col("size") / F.lit(capacity)).cast("long")
    cut = groups.withColumn("whole", whole).withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    size = F.when(F.col("unit") < F.col("whole"), F.lit(capacity)).otherwise(F.col("size") - F.col("whole") * F.lit(capacity))
    turn = F.pmod(F.col("unit"), F.size("prefs")).cast("int")
    turned = F.concat(F.slice("prefs", turn + 1, F.size("prefs")), F.slice("prefs", F.lit(1), turn))
    return cut.select("anchor", "unit", size.cast("long").alias("size"), turned.alias("prefs")).where("size > 0")


def propagated(units: DataFrame, capacity: int, shards: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """``anchor, unit, size, shard`` of the units that find a shard, those that find none, and the room left.

    Rounds of two kinds, each a written table; only one load per shard reaches the driver. First every unit asks the shard
    that holds most of its neighbours, of those that have not refused it. An overfull shard keeps the largest
    units that fit, one after the other, and refuses, for good, all units larger than the room this leaves; so a large unit
    evicts smaller ones. When no shard is overfull, units that all have refused ask again, wherever room is left
    for them, the tightest shard first, until none fits. Less than one unit per shard remains: each is larger than every
    room, and together they fit all rooms.
    """
    held = stored(units, "shard-units")
    while True:
        asking = held.where(F.size("prefs") > 0).withColumn("shard", F.col("prefs")[0])
        loads = _loads(asking, shards)
        over = [s for s in range(shards) if loads[s] > capacity]
        if not over:
            break
        judged = stored(_by_size(asking.where(F.col("shard").isin(over))), "shard-wishes")
        room = {s: capacity for s in over}
        room |= {s: capacity - most for s, most in judged.where(F.col("upto") <= capacity).groupBy("shard").agg(F.max("upto")).collect()}
        refused = (F.col("upto") > capacity) & (F.col("size") > _number(room))
        answered = judged.withColumn("prefs", F.when(refused, F.slice("prefs", 2, shards)).otherwise(F.col("prefs")))
        rest = held.where((F.size("prefs") == 0) | ~F.col("prefs")[0].isin(over))
        held = stored(rest.unionByName(answered.select(*rest.columns)), "shard-units")
    placed = asking.select("anchor", "unit", "size", "shard")
    room = [capacity - load for load in loads]
    left = held.where(F.size("prefs") == 0).select("anchor", "unit", "size")
    while True:
        tight = sorted(range(shards), key=lambda s: (room[s], s))
        fits = F.filter(F.array(*[F.lit(s) for s in tight]), lambda s: F.element_at(F.array(*[F.lit(r) for r in room]), s + 1) >= F.col("size"))
        asking = stored(left.withColumn("shard", F.get(fits, F.lit(0))), "shard-left")
        if asking.where("shard IS NOT NULL").isEmpty():
            return placed, asking.drop("shard"), room
        judged = stored(_by_size(asking.where("shard IS NOT NULL")), "shard-wishes")
        taken = F.col("upto") <= _number(dict(enumerate(room)))
        found = judged.where(taken).select("anchor", "unit", "size", "shard")
        placed = placed.unionByName(found)
        for s, load in enumerate(_loads(found, shards)):
            room[s] -= load
        left = asking.where("shard IS NULL").drop("shard").unionByName(judged.where(~taken).select("anchor", "unit", "size"))


def _by_size(asking: DataFrame) -> DataFrame:
    """Add ``upto``: the size of all units that ask the same shard, from the largest to this one."""
    return prefix_sums(asking.withColumn("less", -F.col("size")), ["shard"], ["less", "anchor", "unit"], {"upto": "size"}).drop("less", "upto_total")


def _loads(placed: DataFrame, shards: int) -> list[int]:
    found = dict(placed.groupBy("shard").agg(F.sum("size")).collect())
    return [found.get(s, 0) for s in range(shards)]


def _number(values: dict[int, int]) -> Column:
    """The value of the row's shard."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("shard"))


def grouped(rows: DataFrame, capacity: int, shards: int) -> tuple[DataFrame, Parts]:
    """``anchor, shard`` of the groups that stay whole, and the parts of those that do not.

    Groups are split only if they fill a shard, or if no shard has room for what is left of them: less than two for
    each shard.
    """
    groups = stored(labelled_groups(rows, shards), "shard-groups")
    placed, left, room = propagated(units_of(groups, capacity), capacity, shards)
    placed = stored(placed, "shard-placed")
    parts: Parts = {}
    for unit in left.orderBy(F.desc("size"), "anchor").collect():
        taken, open_size = parts.setdefault(unit["anchor"], [0.0] * shards), unit["size"]
        while open_size > 0:
            shard = max(range(shards), key=lambda s: (room[s], -s))
            piece = min(open_size, room[shard])
            taken[shard], room[shard], open_size = taken[shard] + piece, room[shard] - piece, open_size - piece
    # Groups that fill a shard, or have a part left: their other units are looked up.
    large = groups.where(F.col("size") > capacity).select("anchor").collect()
    several = rows.sparkSession.createDataFrame([(a,) for a in {r["anchor"] for r in large} | set(parts)], "anchor string")
    for unit in placed.join(F.broadcast(several), "anchor").collect():
        taken = parts.setdefault(unit["anchor"], [0.0] * shards)
        taken[unit["shard"]] += unit["size"]
    return placed.join(F.broadcast(several), "anchor", "left_anti").select("anchor", "shard"), parts


def divided(rows: DataFrame, split: Parts) -> DataFrame:
    """``key, shard`` of the rows of groups that need several shards, in the order of their keys."""
    numbers = rows.sparkSession.createDataFrame([(a, i) for i, a in enumerate(split)], "anchor string, part int")
    nodes = rows.join(F.broadcast(numbers), "anchor").groupBy("key", "part").agg(F.sum("size").alias("size"))
    nodes = stored(nodes, "shard-split")
    found = running_total(nodes, "part", "key", {"before": "size"}, square_root_buckets(nodes.count()))
    place, shard = F.col("before") + F.col("size") / 2, F.lit(None).cast("int")
    for i, taken in enumerate(split.values()):
        shard = F.when(F.col("part") == i, by_quota(place, taken)).otherwise(shard)
    return found.select("key", shard.alias("shard"))


def level(loads: list[float], free: int) -> list[float]:
    """How much of ``free`` goes to each shard so that all reach one level; fuller ones get nothing."""
    height, ordered = 0.0, sorted(loads)
    for n in range(1, len(ordered) + 1):
        height = (sum(ordered[:n]) + free) / n
        if n == len(ordered) or height <= ordered[n]:
            break
    return [max(0.0, height - load) for load in loads]


def by_quota(place: Column, quotas: list[float]) -> Column:
    """The shard whose interval of the running total holds ``place``."""
    found, top = F.lit(len(quotas) - 1), sum(quotas)
    for shard in range(len(quotas) - 2, -1, -1):
        top -= quotas[shard + 1]
        found = F.when(place < F.lit(float(top)), F.lit(shard)).otherwise(found)
    return found


def balanced(rows: DataFrame, shards: int = 8) -> DataFrame:
    """Add ``shard`` to stored ``rows`` of ``sharded_rows``: sizes are even up to one row, groups stay together.

    A group larger than an even share is split over as many shards as it needs, its rest over further ones only where no
    shard has room for it; a smaller group is split only if no shard has room for it. Equal rows (id and
    text) are one node and stay together. Null texts are empty ones, a null doc_id is an id like any other,
    no rows give no rows.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    whole, split = grouped(rows, max(1, -(-total // shards)), shards)
    # Joined from a written table, so that Spark may split the rows of a large group.
    placed = stored(rows.join(whole, "anchor", "left"), "shard-rows")
    if split:
        found = stored(divided(rows, split).withColumnRenamed("shard", "part"), "shard-parts")
        placed = placed.join(found, "key", "left").withColumn("shard", F.coalesce("shard", "part")).drop("part")
        placed = stored(placed, "shard-rows")
    large = 2 * total / max(1, rows.count())
    for size in (F.col("size") > large, F.col("size") <= large):
        placed = stored(filled(placed, size, shards), "shard-rows")
    return placed


def filled(placed: DataFrame, chosen: Column, shards: int) -> DataFrame:
    """Give the chosen rows without a shard to the shards, in the order of their keys, up to one level."""
    loads = dict(placed.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("size")).collect())
    held = [loads.get(s) or 0 for s in range(shards)]
    open_rows = F.col("shard").isNull() & chosen
    free = placed.where(open_rows).drop("shard").withColumn("all", F.lit(0))
    count, size = free.agg(F.count("*"), F.sum("size")).first()
    quotas = level(held, size or 0)
    found = running_total(free, "all", "key", {"before": "size"}, square_root_buckets(count))
    found = found.withColumn("shard", by_quota(F.col("before") + F.col("size") / 2, quotas))
    return placed.where(~open_rows).unionByName(found.drop("all", "before"))


def numbered(placed: DataFrame) -> DataFrame:
    """Add ``slot``, gapless from 0 within each shard, in the order of the rows' keys; equal rows in any order."""
    rows = placed.withColumns({"one": F.lit(1).cast("long"), "copy": F.monotonically_increasing_id()})
    found = prefix_sums(stored(rows, "sharded"), ["shard"], ["key", "copy"], {"place": "one"})
    return found.withColumn("slot", F.col("place") - 1).drop("one", "copy", "place", "place_total")


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, under the law ``bytes``."""
    rows = stored(sharded_rows(docs), "shard-sizes")
    return numbered(balanced(rows, shards)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
