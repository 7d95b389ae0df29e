"""Operator 13: a Merkle manifest of a table, by lag and lead windows over its levels.

Each row is hashed into a leaf, once, where it is read.  Leaves get their places within their group by sorted ranges and
the groups' counts in each range, so that no task ranks a whole group.  On each level, runs of FAN places hash into
parents: lags of 1 to FAN - 1 supply the siblings to the left of a node as far as its slot in the run allows, leads those
to the right as far as the run is long, and the row of the first child hashes the parent.  Windows are cut by runs.  The
groups' roots are leaves of one more such tree, whose root is the table's.  Paths then go down: each node's siblings on
its level and above are joined to its children run by run, and rows are proved, folded and checked where they meet the
siblings of their own level.

Rows: a null column hashes as `-`.  Groups are ordered null first, then by the bytes of UTF-8; rows by id, null first;
repeated rows have equal leaves in neighbouring places and a proof each.  Columns that are not asked for do not count and do
not come back.  No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.llm.common import kept_beyond, shelf, stored, table

FAN = 16
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as it is hashed: `-` if null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """`nodes` (g, ...) with pos, the place of each within its g by `order`, and size, how many g has."""
    at = stored(nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), "ranges")
    counts = at.groupBy("range", "g").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ranges = Window.partitionBy("g").orderBy("range")
    places = counts.select("range", "g", "first", F.coalesce(F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("size"))
    return at.join(places, ["range", "g"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("at", "range", "first", "before")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """`nodes` (g, run, pos, size, node) with slot, and left and right: the joined digests of the run's other nodes."""
    run = Window.partitionBy("g", "run").orderBy("pos")
    slot, long = F.col("pos") % FAN, F.least(F.lit(FAN), F.col("size") - F.col("run") * FAN)
    left = [F.when(slot >= k, F.lag("node", k).over(run)).otherwise("") for k in range(FAN - 1, 0, -1)]
    right = [F.when(slot + k < long, F.lead("node", k).over(run)).otherwise("") for k in range(1, FAN)]
    return nodes.withColumns({"slot": slot, "left": F.concat(*left), "right": F.concat(*right)})


def climbed(leaves: DataFrame) -> list[DataFrame]:
    """The levels of each group's tree, (g, run, pos, size, node) from the leaves up; a group is on as many as it needs."""
    levels = [leaves.withColumn("run", F.floor(F.col("pos") / FAN))]
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        parents = with_siblings(levels[-1].where("size > 1").select("g", "run", "pos", "size", "node")).where("slot = 0")
        up = parents.select("g", F.col("run").alias("pos"), F.ceil(F.col("size") / FAN).alias("size"), digest(F.col("node"), F.col("right")).alias("node"))
        levels.append(stored(up.withColumn("run", F.floor(F.col("pos") / FAN)), "level"))
        most = -(-most // FAN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(g, node): the root of each group."""
    out = levels[0].where("size = 1").select("g", "node")
    for level in levels[1:]:
        out = out.union(level.where("size = 1").select("g", "node"))
    return out


def with_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with `path`, the siblings on the way up, and the further columns of `above` (g, path, ...), which has
    what goes for each group's root."""
    more = [c for c in above.columns if c not in ("g", "path")]
    known = None
    for k, level in reversed(list(enumerate(levels))):
        found = level.where("size = 1").join(above, "g")
        if known is not None:
            # the join deals rows by their run, as the windows need them
            own = with_siblings(level.where("size > 1").join(known.hint("merge"), ["g", "run"]))
            path = F.concat(F.array(F.struct("left", "right")), F.col("up")).cast(PATH)
            found = found.unionByName(own.withColumn("path", path).drop("slot", "left", "right", "up"))
        if k == 0:
            return found
        known = stored(found.select("g", F.col("pos").alias("run"), F.col("path").alias("up"), *more), "paths")
    raise ValueError("a tree has at least one level")


def manifest(docs: DataFrame, columns: list[str], *, doc_id: str = "doc_id", group: str = "source", claimed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row, stored: leaves of `columns`, a
    subtree for each `group`.  `claimed` has columns that are to be verified in place of the row's own."""
    spark = docs.sparkSession
    claimed = claimed or {}
    with shelf(spark):
        rows = docs.select(
            F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("g"),  # null before all others
            F.col(f"`{doc_id}`").alias("doc_id"),
            digest(*(field(F.col(f"`{c}`")) for c in columns)).alias("node"),
            digest(*(field(claimed.get(c, F.col(f"`{c}`"))) for c in columns)).alias("claim"),
            F.monotonically_increasing_id().alias("row"),
        )
        leaves = stored(placed(stored(rows, "leaves"), "doc_id", "node", "row").drop("row"), "placed")
        levels = climbed(leaves)
        subroots = placed(tops(levels).select(F.lit("").alias("g"), F.col("g").alias("source"), "node"), "source")
        over = climbed(stored(subroots, "subroots"))
        root = tops(over).select("g", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
        above = stored(with_paths(over, root).select(F.col("source").alias("g"), "path", F.col("node").alias("subroot"), "root"), "above")
        proved = with_paths(levels, above)
        siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
        folded = F.aggregate("path", F.col("claim"), lambda acc, x: digest(x["left"], acc, x["right"]))
        out = proved.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
        return kept_beyond(stored(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest"))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: The letters that tampering lower-cases, and what becomes of them.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), COLUMNS, claimed={"text": F.when(changed, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))})


#: crc32 bit by bit, two trees by recursion from the leaves up, then each row's way up.
ORACLE_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce('1' || source, '') AS g, text,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS f_lang,
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END AS f_source,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END AS f_id,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS f_n,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents
),
leaf AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size,
    sha256(f_id || f_source || f_lang || f_n || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS node,
    sha256(f_id || f_source || f_lang || f_n || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' ||
      CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END END) AS claim
  FROM t
),
lower_tree AS (
  SELECT 0 AS level, g, pos, size, node FROM leaf
  UNION ALL
  SELECT level + 1, g, pos // 16, (max(size) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM lower_tree WHERE size > 1 GROUP BY level, g, pos // 16
),
sub AS (SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS size, level FROM lower_tree WHERE size = 1),
upper_tree AS (
  SELECT 0 AS level, pos, size, node FROM sub
  UNION ALL
  SELECT level + 1, pos // 16, (max(size) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_tree WHERE size > 1 GROUP BY level, pos // 16
),
-- one tree: the levels of the upper one follow each group's own
nodes AS (
  SELECT 'low' AS tree, level, g, pos, size, node FROM lower_tree WHERE size > 1
  UNION ALL SELECT 'up', level, '', pos, size, node FROM upper_tree WHERE size > 1
),
runs AS (SELECT tree, level, g, pos // 16 AS run, list(node ORDER BY pos) AS kids FROM nodes GROUP BY ALL),
walk AS (
  SELECT l.doc_id, l.g, CASE WHEN s.level > 0 THEN l.pos ELSE s.pos END AS pos, l.node AS leaf, s.node AS subroot, s.pos AS sub_pos, s.level AS height, l.claim AS acc, '' AS proof,
    CASE WHEN s.level > 0 THEN 'low' ELSE 'up' END AS tree, 0 AS level, false AS done
  FROM leaf l JOIN sub s USING (g)
  UNION ALL
  SELECT w.doc_id, w.g, CASE WHEN w.tree = 'low' AND w.level + 1 = w.height THEN w.sub_pos ELSE w.pos // 16 END, w.leaf, w.subroot, w.sub_pos, w.height,
    CASE WHEN r.kids IS NULL THEN w.acc ELSE sha256(array_to_string(r.kids[1 : w.pos % 16], '') || w.acc || array_to_string(r.kids[w.pos % 16 + 2 : ], '')) END,
    CASE WHEN r.kids IS NULL THEN w.proof ELSE w.proof || array_to_string(r.kids[1 : w.pos % 16], '') || array_to_string(r.kids[w.pos % 16 + 2 : ], '') END,
    CASE WHEN w.tree = 'low' AND w.level + 1 = w.height THEN 'up' ELSE w.tree END,
    CASE WHEN w.tree = 'low' AND w.level + 1 = w.height THEN 0 ELSE w.level + 1 END, r.kids IS NULL
  FROM walk w LEFT JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.pos // 16 AND r.g = CASE WHEN w.tree = 'low' THEN w.g ELSE '' END
  WHERE NOT w.done
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM walk, (SELECT node AS root FROM upper_tree WHERE size = 1) WHERE done
"""
