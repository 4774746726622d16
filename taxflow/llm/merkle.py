"""Merkle manifest of a table: a tree for each source, a tree over their roots, and a proof for each row.

A node of the tree is the SHA-256 of its children's digests, ``FANOUT``
consecutive ones.  A level is one aggregation by parent: conditional aggregates
spread the children over ``FANOUT`` slot columns, all slots together give the
parent's digest, and all but a child's own give what its proof needs.

Digests travel as 32 bytes and are hashed as lowercase hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from taxflow.llm.scratch import Scratch, narrow_side

FANOUT = 3
#: Levels that share one exchange: a row then holds the FANOUT ** LEVELS leaves below a node, 81.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _no_path() -> Column:
    return F.array().cast("array<struct<left:binary,right:binary>>")


def digest(*raw: Column) -> Column:
    """SHA-256, as bytes, of digests taken as hex text; nulls are left out."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*[F.coalesce(r, F.lit(b"")) for r in raw]))), 256))


def hex_text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def row_digest(fields: dict[str, Column]) -> Column:
    """SHA-256, as bytes, of values written as byte count, colon and value; a null is ``-``."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (v.cast("string") for v in fields.values())]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(nodes: DataFrame, order: list[str], scratch: Scratch, label: str) -> DataFrame:
    """``nodes`` with ``pos``, the place in its group ``g`` by ``order``, and ``n``, the size of the group.

    One range exchange on (g, order) deals a large group over many tasks; the
    places follow from the counted rows of each task and group.
    """
    dealt = scratch.write(nodes.orderBy("g", *order).withColumn("at", F.monotonically_increasing_id()), label)
    dealt = dealt.withColumn("task", F.shiftright("at", 33))
    parts = dealt.groupBy("g", "task").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("rows"))
    of_group = Window.partitionBy("g")
    before = F.sum("rows").over(of_group.orderBy("task")) - F.col("rows")
    parts = parts.select("g", "task", (before - F.col("first_at")).alias("shift"), F.sum("rows").over(of_group).alias("n"))
    parts = scratch.write(parts, f"{label}-parts")
    return dealt.join(narrow_side(parts), ["g", "task"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift", "task")


def _left(n: Column, level: int) -> Column:
    """Nodes of a group of ``n`` leaves that are left after so many levels."""
    size = F.lit(FANOUT**level)
    return F.floor((n + size - 1) / size) if level else n


def grow(nodes: DataFrame, scratch: Scratch, label: str) -> tuple[DataFrame, list[DataFrame]]:
    """(roots, blocks) of ``nodes``: g, n, pos, raw (digest) and item (what the leaf is to carry).

    ``roots``: g, raw.  ``blocks``: for each LEVELS levels a table (g, pos,
    members), members being the nodes below with the proof up to this node.  A
    group with one node left is through: the node goes up unchanged.
    """
    longest = nodes.agg(F.max("n").alias("n")).first()["n"] or 0  # one number
    blocks, level = [], 0
    while not blocks or FANOUT**level < longest:
        row = nodes.select("g", "n", F.col("pos").alias("p0"), "raw", F.array(F.struct("item", _no_path().alias("path"))).alias("members"))
        for j in range(1, LEVELS + 1):
            row = row.withColumn(f"p{j}", F.floor(F.col("p0") / FANOUT**j))
        row = row.repartition("g", f"p{LEVELS}")  # serves all levels of the block
        for j in range(LEVELS):
            slots = [
                F.first(F.when(F.pmod(f"p{j}", F.lit(FANOUT)) == k, F.struct("raw", "members")), ignorenulls=True).alias(f"c{k}") for k in range(FANOUT)
            ]
            row = row.groupBy("g", "n", *[f"p{i}" for i in range(LEVELS, j, -1)]).agg(*slots)
            more = _left(F.col("n"), level + j) > 1
            own = [F.col(f"c{k}") for k in range(FANOUT)]
            row = row.select(
                "g", "n", *[f"p{i}" for i in range(LEVELS, j, -1)],
                F.when(more, digest(*[c["raw"] for c in own])).otherwise(own[0]["raw"]).alias("raw"),
                F.concat(*[_with_siblings(own, k, more) for k in range(FANOUT)]).alias("members"),
            )
        block = scratch.write(row.withColumnRenamed(f"p{LEVELS}", "pos"), f"{label}-{len(blocks)}")
        blocks.append(block.select("g", "pos", "members"))
        level += LEVELS
        nodes = block.select("g", "n", "pos", "raw", F.col("pos").alias("item"))
    return nodes.select("g", "raw"), blocks


def _with_siblings(slots: list[Column], k: int, more: Column) -> Column:
    """The members of slot ``k``, their proofs longer by the digests of the other slots."""
    none = F.lit(b"")
    side = lambda some: F.concat(none, *[F.coalesce(c["raw"], none) for c in some])
    step = F.when(more, F.array(F.struct(side(slots[:k]).alias("left"), side(slots[k + 1 :]).alias("right")))).otherwise(_no_path())
    longer = F.transform(slots[k]["members"], lambda m: F.struct(m["item"].alias("item"), F.concat(m["path"], step).alias("path")))
    return F.coalesce(longer, F.slice(slots[0]["members"], 1, 0))


def proofs(top: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """(g, item, path) of all leaves; ``top``: g and the path from the group's root on.

    Blocks are met from the root down, each joined with the nodes above it, which are 81 times fewer.
    """
    above = top.select("g", F.lit(0).cast("long").alias("pos"), F.col("path").alias("up"))
    for block in reversed(blocks):
        below = block.join(above.hint("merge"), ["g", "pos"]).select("g", "up", F.explode("members").alias("m"))
        rows = below.select("g", F.col("m.item").alias("item"), F.concat("m.path", "up").alias("path"))
        above = rows.select("g", F.col("item").alias("pos"), F.col("path").alias("up")) if block is not blocks[0] else rows
    return above


def fold(raw: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, raw, lambda acc, s: digest(s["left"], acc, s["right"]))


def tampered_text() -> Column:
    """The text without its line ends where 2 divides the CRC of the decimal doc_id."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


def merkle_manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (array of left, right), proof_sha256, folded_root, verified of each row.

    The leaves are the rows' ``FIELDS`` as given; ``changed``, the text as it
    is found when the manifest is verified, decides ``folded_root`` and
    ``verified`` and nothing else (default: unchanged).

    Leaves of a source ascend by doc_id, null first; rows with equal doc_id by
    digest; repeated rows are leaves of their own, next to each other.  A null
    source is a source and comes first.  Nulls in any column are hashed as
    ``-``, empty texts as ``0:``.  Texts of any length are read once, where
    they lie, and only digests move.  Other columns are not read, whatever
    their names.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    whole = {c: F.col(c) for c in FIELDS}
    now = row_digest(whole | {"text": F.col("text") if changed is None else changed})
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("g"), "doc_id", row_digest(whole).alias("raw"), now.alias("now"), F.monotonically_increasing_id().alias("rid")
    ).withColumn("now", F.when(F.col("now") != F.col("raw"), F.col("now")))
    leaves = numbered(scratch.write(leaves, "leaves"), ["doc_id", "raw", "rid"], scratch, "dealt")
    subroots, blocks = grow(leaves.select("g", "n", "pos", "raw", F.struct("doc_id", "raw", "now").alias("item")), scratch, "tree")
    named = scratch.write(subroots, "subroots")
    sources = numbered(named.select(F.lit("").alias("g"), F.col("g").alias("source_"), "raw"), ["source_"], scratch, "sources")
    roots, top = grow(sources.select("g", "n", "pos", "raw", F.struct("source_", "raw").alias("item")), scratch, "top")
    upper = proofs(roots.select("g", _no_path().alias("path")), top).join(roots.select("g", F.col("raw").alias("root")).hint("merge"), "g")
    upper = scratch.write(upper.select(F.col("item.source_").alias("g"), F.col("item.raw").alias("subroot"), "root", "path"), "upper")
    rows = proofs(upper, blocks).join(narrow_side(upper.drop("path")), "g")
    leaf = F.col("item.raw")
    siblings = F.aggregate("path", F.lit(b""), lambda acc, s: F.concat(acc, s["left"], s["right"]))
    return rows.select(
        F.col("item.doc_id").alias("doc_id"), hex_text(leaf).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"),
        F.col("path").alias("proof"), F.sha2(hex_text(siblings), 256).alias("proof_sha256"), fold(F.coalesce("item.now", leaf), F.col("path")).alias("folded"), F.col("root").alias("root_"),
    ).select(
        "doc_id", "leaf", "subroot", "root", "proof", "proof_sha256", hex_text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root_")).alias("verified"),
    )


#: The query's SQL: recursive levels, then the proof of each leaf and its folding.  crc32 is computed bit by bit.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed, text,
    [coalesce(strlen(v) || ':' || v, '-') for v in [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)]] AS head
  FROM (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT for c in string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc FROM documents)),
leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
  FROM (SELECT doc_id, g, sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS h, sha256(array_to_string(head, '') || coalesce(strlen(changed) || ':' || changed, '-')) AS now FROM d)),
up AS (
  SELECT g, 0 AS lvl, pos, h, n FROM leaf
  UNION ALL
  SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM up WHERE n > 1 GROUP BY g, lvl, pos // 3),
sub AS (SELECT g, lvl AS depth, h AS subroot FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, row_number() OVER (ORDER BY g) - 1 AS pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY lvl, pos // 3),
place AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS s FROM sub),
root AS (SELECT h AS root FROM top WHERE n = 1),
step AS (
  SELECT l.g, l.pos, u.lvl, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < l.pos // (3 ** u.lvl)::BIGINT), '') AS lft, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > l.pos // (3 ** u.lvl)::BIGINT), '') AS rgt
  FROM leaf l JOIN up u ON u.g = l.g AND u.n > 1 AND u.pos // 3 = l.pos // (3 ** u.lvl)::BIGINT // 3 GROUP BY l.g, l.pos, u.lvl
  UNION ALL
  SELECT l.g, l.pos, p.depth + t.lvl, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < p.s // (3 ** t.lvl)::BIGINT), ''), coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > p.s // (3 ** t.lvl)::BIGINT), '')
  FROM leaf l JOIN place p USING (g) JOIN top t ON t.n > 1 AND t.pos // 3 = p.s // (3 ** t.lvl)::BIGINT // 3 GROUP BY l.g, l.pos, p.depth, t.lvl),
proof AS (SELECT g, pos, list({'l': lft, 'r': rgt} ORDER BY lvl) AS path FROM step GROUP BY g, pos),
folded AS (
  SELECT l.doc_id, l.g, l.h, coalesce(p.path, []) AS path, l.now AS acc, 1 AS i FROM leaf l LEFT JOIN proof p ON p.g = l.g AND p.pos = l.pos
  UNION ALL
  SELECT doc_id, g, h, path, sha256(path[i].l || acc || path[i].r), i + 1 FROM folded WHERE i <= len(path))
SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string([x.l || x.r for x in path], '')) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM folded JOIN sub USING (g), root WHERE i = len(path) + 1
"""
