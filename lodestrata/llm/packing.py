"""Filling containers of fixed capacity: bound-certified repacking.

Items are spread over shards of bounded size. Each shard is packed by best-fit
decreasing and compared with a lower bound from dual feasible functions
(Martello and Toth's L2, Fekete and Schepers' u^(k)). Where the bin count
equals the bound the shard is certified and final. Shards with a gap keep
their full bins, give the items of the others away, exchange them among each
other and are packed again, a few rounds at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import read
from lodestrata.llm.tokens import token_counts
from lodestrata.runtime import cut_lineage, ship_package


@dataclass(frozen=True)
class PackingParams:
    """shard_items: items that one shard may hold. rounds: exchanges after the first packing."""

    shard_items: int = 20_000
    rounds: int = 3


def lower_bound(sizes: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """No packing of ``sizes`` (each 1 to ``capacity``, or that many ``times``) takes fewer containers."""
    sizes = np.asarray(sizes, np.int64)
    value, at = np.unique(sizes[sizes > 0], return_inverse=True)
    if not len(value):
        return 0
    count = np.zeros(len(value), np.int64)
    np.add.at(count, at, 1 if times is None else np.asarray(times, np.int64)[sizes > 0])
    total = int((value * count).sum())
    best = -(-total // capacity)
    # L2: for each e up to half the capacity, items above capacity - e count whole, those below e not at all
    for e in np.append(value[value <= capacity // 2], capacity // 2):
        whole = value > capacity - e
        part = (value >= e) & ~whole
        best = max(best, int(count[whole].sum()) + -(-int((value[part] * count[part]).sum()) // capacity))
    for k in range(1, 41):  # u^(k), over k * capacity to stay in whole numbers
        scaled = (k + 1) * value
        exact = scaled % capacity == 0
        image = np.where(exact, value * k, scaled // capacity * capacity)
        best = max(best, -(-int((image * count).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item and how many bins there are. Ties go in the given order.

    ``room`` has a bit for each amount of free space that some bin has, so the
    best fit is the lowest set bit from the item's size on.
    """
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    bins = np.zeros(len(sizes), np.int64)
    free: dict[int, list[int]] = {}
    room, used = 0, 0
    for i in order.tolist():
        size = int(sizes[i])
        fitting = room >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            stack = free[left]
            b = stack.pop()
            if not stack:
                room ^= 1 << left
        else:
            left, b, used = capacity, used, used + 1
        bins[i] = b
        rest = left - size
        stack = free.setdefault(rest, [])
        if not stack:
            room |= 1 << rest
        stack.append(b)
    return bins, used


PLACED = "pack_id int, capacity int, shard long, doc_id {id}, piece int, first_token long, n_tokens long, bin long, fill long, bins long, bound long"


def pack_shard(table: pa.Table) -> pa.Table:
    table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    capacity = table.column("capacity")[0].as_py()
    sizes = table.column("n_tokens").to_numpy()
    bins, used = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(bins, weights=sizes, minlength=used).astype(np.int64)
    n = len(table)
    for name, values in (("bin", bins), ("fill", fill[bins]), ("bins", np.full(n, used)), ("bound", np.full(n, lower_bound(sizes, capacity)))):
        table = table.append_column(name, pa.array(values, pa.int64()))
    return table


def pack(items: DataFrame, capacities: DataFrame, params: PackingParams | None = None) -> DataFrame:
    """(pack_id, container_id, doc_id, piece, first_token, n_tokens, fill, capacity) of every item in every capacity.

    ``items``: (doc_id, n_tokens); ``capacities``: (pack_id, capacity), few
    rows. An item larger than a capacity is split into pieces that fill a
    container each and a rest; no other item is split. Items without tokens (a
    null size counts as 0) take no room and lie in any container. Null ids and
    null or non-positive capacities take no part; an item that stands twice
    counts once, with its greatest size.
    """
    p = params or PackingParams()
    spark = items.sparkSession
    ship_package(spark)
    kind = dict(items.dtypes)["doc_id"]
    one = items.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max("n_tokens"), F.lit(0)).cast("long").alias("size"))
    sized = cut_lineage(one)
    caps = {r.pack_id: r.capacity for r in capacities.where("pack_id is not null and capacity > 0").groupBy("pack_id").agg(F.max("capacity").cast("int").alias("capacity")).collect()}
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("pack_id"), F.lit(c).cast("int").alias("capacity")) for k, c in sorted(caps.items())])) if caps else None
    if each is None:
        empty = f"pack_id int, container_id string, doc_id {kind}, piece int, first_token long, n_tokens long, fill long, capacity int"
        return spark.createDataFrame([], empty)
    wide = sized.select("doc_id", "size", each.alias("c")).select("doc_id", "size", "c.*")
    whole = F.floor(F.col("size") / F.col("capacity")).cast("int")
    over = F.col("size") > F.col("capacity")
    pieces = wide.select("pack_id", "capacity", "doc_id", "size", F.explode(F.when(over, F.sequence(F.lit(0), F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1)).otherwise(F.array(F.lit(0)))).alias("piece"), whole.alias("whole"))
    first = F.col("piece").cast("long") * F.col("capacity")
    pieces = pieces.select("pack_id", "capacity", "doc_id", "piece", first.alias("first_token"), F.least(F.col("capacity").cast("long"), F.col("size") - first).alias("n_tokens"))
    full = F.col("n_tokens") == F.col("capacity")
    total = sized.count()

    def shard(rows: int, salt: int):
        return F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), F.lit(max(1, -(-rows // p.shard_items))))

    todo = pieces.where(~full).withColumn("shard", shard(total, 0))
    done = pieces.where(full).select("pack_id", "doc_id", "piece", "first_token", "n_tokens", F.col("n_tokens").alias("fill"), "capacity", F.lit(-1).alias("round"), F.lit(0).cast("long").alias("shard"), F.concat_ws("+", F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("bin"))
    keep = ["pack_id", "doc_id", "piece", "first_token", "n_tokens", "fill", "capacity", "round", "shard", "bin"]
    columns = ["pack_id", "capacity", "shard", "doc_id", "piece", "first_token", "n_tokens"]
    for step in range(p.rounds + 1):
        placed = todo.select(*columns).groupBy("pack_id", "shard").applyInArrow(pack_shard, PLACED.format(id=kind)).withColumn("round", F.lit(step))
        placed = cut_lineage(placed)
        certified = (F.col("bins") <= F.col("bound")) | (F.col("fill") == F.col("capacity"))
        final = certified if step < p.rounds else F.lit(True)
        left = 0 if step == p.rounds else placed.where(~certified).agg(F.count("*"), F.countDistinct("pack_id", "shard")).first()
        if step < p.rounds and (left[0] == 0 or left[1] < 2 and step):
            final, left = F.lit(True), None
        done = done.unionByName(placed.where(final).withColumn("bin", F.col("bin").cast("string")).select(*keep))
        if step == p.rounds or left is None:
            break
        todo = placed.where(~certified).drop("shard").withColumn("shard", shard(left[0] // max(1, len(caps)), step + 1))
    # a name, no hash: two containers never share one
    container = F.concat_ws("/", *[F.col(x).cast("string") for x in ("round", "shard", "bin")])
    return done.select("pack_id", container.alias("container_id"), "doc_id", "piece", "first_token", "n_tokens", "fill", "capacity")


def bounds(items: DataFrame, capacities: DataFrame, packed: DataFrame) -> DataFrame:
    """(pack_id, containers, lower_bound, used_share): how near each packing is to the least possible.

    The bound is taken over a histogram of sizes, which has no more entries than the capacity.
    """
    ship_package(items.sparkSession)
    sizes = packed.where("n_tokens > 0").groupBy("pack_id", "capacity", "n_tokens").agg(F.count("*").alias("n"))

    def bound(table: pa.Table) -> pa.Table:
        cap = table.column("capacity")[0].as_py()
        return pa.table({"pack_id": pa.array([table.column("pack_id")[0].as_py()], pa.int32()), "lower_bound": pa.array([lower_bound(table.column("n_tokens").to_numpy(), cap, table.column("n").to_numpy())], pa.int64())})

    low = sizes.groupBy("pack_id").applyInArrow(bound, "pack_id int, lower_bound long")
    used = packed.groupBy("pack_id", "capacity").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.join(low, "pack_id").select("pack_id", "containers", "lower_bound", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("used_share"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = token_counts(read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
    capacities = read(spark, sf_dir, "pack_capacities").select("pack_id", F.col("capacity_tokens").alias("capacity"))
    return items, capacities


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container in each capacity."""
    return pack(*_inputs(spark, sf_dir)).select("pack_id", "container_id", "doc_id", "piece", "first_token", "n_tokens")


def p9_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and the fewest possible, for each capacity."""
    items, capacities = _inputs(spark, sf_dir)
    items = cut_lineage(items)
    return bounds(items, capacities, pack(items, capacities))


QUERIES = {"p9_packing": p9_packing, "p9_bounds": p9_bounds}
