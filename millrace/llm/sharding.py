"""Sharding by a hierarchical weighted hash tree.

Shards are leaves under racks under regions. A document descends from the root: at each level every child draws an
exponential variate from a hash of the document's key and the child's name, divided by the child's weight, and the
smallest draw wins. A node weighs what its leaves weigh. When a weight changes, only draws of the nodes
above that leaf change, so documents move into (or out of) the subtrees that hold it and stay elsewhere. New
shards join as regions of their own, so that they take documents from all others and no other shard gets any.

The shard of a row needs nothing but the row. Slots, which count a shard's rows without gaps, come from sums over 4,096 cells
of each shard, so that no shard is ever sorted whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch

CELL_DIGITS = 3
#: Cells of all shards up to this number go to every task; beyond it they are joined.
BROADCAST_CELLS = 1 << 20


@dataclass(frozen=True)
class Leaf:
    """A shard's place; its number is its position in the list of leaves."""

    region: int
    rack: int
    weight: float = 1.0


def layout(shards: int, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """Regions of `racks` racks of `per_rack` shards; those that fill no region are regions of their own."""
    full = shards // (racks * per_rack) * racks * per_rack
    leaves = [Leaf(i // (racks * per_rack), i // per_rack % racks) for i in range(full)]
    return leaves + [Leaf(full // (racks * per_rack) + i, 0) for i in range(shards - full)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, as a region of its own."""
    return [*leaves, Leaf(1 + max((leaf.region for leaf in leaves), default=-1), 0, weight)]


def document_key() -> Column:
    """What the draws depend on: the id; without one, a digest of the text; without both, nothing."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5("text")), F.lit(""))


def draw(key: str, children: Column) -> Column:
    """The child of the smallest draw; ties go to the first in the list."""

    def bid(child: Column) -> Column:
        name = F.concat_ws("/", F.col(key), child["name"])
        unit = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
        return F.struct((-F.ln(unit) / child["weight"]).alias("bid"), child["at"].alias("at"))

    return F.element_at(children, F.array_min(F.transform(children, bid))["at"])


def shard_of(key: str, leaves: list[Leaf]) -> Column:
    """The shard of a row with that key column. Leaves without weight get nothing; there must be one with some."""
    live = [(i, leaf) for i, leaf in enumerate(leaves) if leaf.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")

    def level(found: list[tuple[int, Leaf]], names: list[str], at: str) -> Column:
        """Children of a node as an array; `names` are the levels that remain."""
        groups: dict[int, list[tuple[int, Leaf]]] = {}
        for i, leaf in found:
            groups.setdefault(i if names[0] == "shard" else getattr(leaf, names[0]), []).append((i, leaf))
        nodes = []
        for turn, (number, inside) in enumerate(sorted(groups.items())):
            own = f"{at}.{number}"
            fields = [F.lit(turn + 1).alias("at"), F.lit(own).alias("name"), F.lit(float(sum(leaf.weight for _, leaf in inside))).alias("weight")]
            fields.append(F.lit(number).alias("shard") if names[0] == "shard" else level(inside, names[1:], own).alias("children"))
            nodes.append(F.struct(*fields))
        return F.array(*nodes)

    region = draw(key, level(live, ["region", "rack", "shard"], "root"))
    return draw(key, draw(key, region["children"])["children"])["shard"]


def place(docs: DataFrame, leaves: list[Leaf], name: str = "shard") -> DataFrame:
    """All columns of `docs` and the shard of each row, by doc_id alone (or text, where the id is null); no row moves.

    A column called `name` is replaced, all others stay as they are. Rows of one id share a shard, whatever their text; rows without
    id and text share one as well. An empty table stays empty.
    """
    rest = [c for c in docs.columns if c != name]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), document_key().alias("key"))
    return whole.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], shard_of("key", leaves).alias(name))


def ledger(docs: DataFrame, leaves: list[Leaf], more: list[Leaf]) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of `docs`.

    Size is the bytes of the text in UTF-8 plus 16, a null text counts as empty. grown_shard is the shard under the leaves
    `more`. Slots count from 0 in the order of cell, id, size and checksum. Equal rows are
    interchangeable: they are counted where they are read, so that many copies of one row meet as a few numbers.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), document_key().alias("key"))
    placed = rows.select("doc_id", "size", "text_crc32", F.substring(F.md5("key"), 1, CELL_DIGITS).alias("cell"), shard_of("key", leaves).alias("shard"), shard_of("key", more).alias("grown_shard"))
    names = ["shard", "cell", "doc_id", "size", "text_crc32", "grown_shard"]
    scratch = Scratch(docs.sparkSession, "shards")
    # a number of the task apart, so that no row stands for more copies than a task reads
    counted = scratch.save(placed.withColumn("task", F.spark_partition_id()).groupBy(*names, "task").agg(F.count("*").alias("n")), "rows")
    before = lambda rows_, c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counted.groupBy("shard", "cell").agg(F.sum("n").alias("n"))
    cells = cells.select("shard", "cell", before(cells, "n", ["shard"], ["cell"]).alias("base"))
    if len(leaves) * 16**CELL_DIGITS <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    first = counted.withColumn("first", before(counted, "n", ["shard", "cell"], ["doc_id", "size", "text_crc32", "task"])).join(cells, ["shard", "cell"])
    numbered = first.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    slot = F.col("base") + F.col("first") + F.col("turn")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("bigint").alias("slot"), "grown_shard")


def movement(docs: DataFrame, before: list[Leaf], after: list[Leaf]) -> DataFrame:
    """(source, target, n_rows, n_bytes) of the documents that change their shard between two trees."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    placed = docs.select(document_key().alias("key"), size).select("size", shard_of("key", before).alias("source"), shard_of("key", after).alias("target"))
    moved = placed.filter("source <> target").groupBy("source", "target")
    return moved.agg(F.count("*").alias("n_rows"), F.sum("size").cast("bigint").alias("n_bytes"))


def write(docs: DataFrame, leaves: list[Leaf], path: str, files_per_shard: int = 8) -> DataFrame:
    """Writes all columns as Parquet under `path`/shard=N and returns (shard, n_rows, n_bytes) of what was written.

    Each shard is cut into parts by a hash of its rows, so that no task holds a shard.
    """
    placed = place(docs, leaves)
    part = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(files_per_shard))
    placed.withColumn("_part", part).repartition("shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.parquet(path)
    return written.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("bigint").alias("n_bytes"))


SHARDS = 40


def op12_shard_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tree = layout(SHARDS)
    return ledger(docs, tree, grown(tree))


def _level_sql(out: str, source: str, members: str, name: str, path: str, child: str) -> str:
    """`out`: for each row of `source` (k, grew, path) the child of the smallest draw among `members`, as a column `child`."""
    draw_ = f"-ln((('0x' || substring(md5(k || '/' || {name}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) / weight"
    return f"""{out} AS (SELECT k, grew, {path}node AS {child} FROM (
  SELECT *, row_number() OVER (PARTITION BY k, grew ORDER BY {draw_}, node) AS turn FROM {source} JOIN {members}) WHERE turn = 1)"""


OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'text:' || md5(text), '') AS k, coalesce(text, '') AS text FROM documents),
crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
leaves AS (SELECT s, CASE WHEN s < 40 THEN s // 8 ELSE 5 END AS region, CASE WHEN s < 40 THEN s // 4 % 2 ELSE 0 END AS rack FROM range(41) x(s)),
regions AS (SELECT region AS node, count(*) AS weight FROM leaves GROUP BY region),
racks AS (SELECT region, rack AS node, count(*) AS weight FROM leaves GROUP BY region, rack),
shards AS (SELECT region, rack, s AS node, 1 AS weight FROM leaves),
keys AS (SELECT DISTINCT k, grew FROM d, (VALUES (false), (true)) g(grew)),
{_level_sql("in_region", "keys", "regions ON node < 5 OR grew", "'root.' || node", "", "region")},
{_level_sql("in_rack", "in_region", "racks USING (region)", "'root.' || region || '.' || node", "region, ", "rack")},
{_level_sql("in_shard", "in_rack", "shards USING (region, rack)", "'root.' || region || '.' || rack || '.' || node", "", "shard")},
p AS (SELECT d.*, (strlen(text) + 16)::BIGINT AS size, a.shard::INTEGER AS shard, b.shard::INTEGER AS grown_shard,
    xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM d CROSS JOIN crc JOIN in_shard a ON a.k = d.k AND NOT a.grew JOIN in_shard b ON b.k = d.k AND b.grew)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substring(md5(k), 1, 3), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM p
"""
