"""Merkle manifest of a dataset, with inclusion proofs by pointer jumping.

Every row is a leaf, the SHA-256 of its columns. Per group (language), leaves ascend by key; every
``ARITY`` successive nodes are hashed to their parent until one is left, the group's subroot. Subroots,
ordered by group, are the leaves of one more such tree, whose last node is the root.

Trees are built in blocks of ``2 ** BLOCK_LEVELS`` successive nodes, so a table of n rows takes
log n / BLOCK_LEVELS shuffles, each of a share of the rows before. Every node of a block leaves it with a
pointer to its parent and a segment, its own sibling. Proofs come from pointer jumping: a self-join of
the nodes on their pointers appends the segment of the ancestor pointed at and doubles the distance.
After r rounds only levels that are multiples of 2^r can still be pointed at, so other inner nodes are
left out and the table soon holds little but leaves. Targets are copied under a few salts, one per
``SHARED`` leaves below them, so no join key gathers a whole subtree. Rounds end when the distance reaches
the deepest tree; a leaf's segment then holds all siblings up to its subroot, and one join adds those from
the subroot to the root. Every round is written to the shared folder, and the round before it removed.

A segment is 33 bytes a level: 0 where the node is hashed alone (then 32 empty bytes), 1 with a sibling
to the left, 2 with a sibling to the right.

Defined cases: nulls in a column are hashed as ``-``; rows with a null group form a group, which comes
first; a null key sorts first; equal keys are leaves of their own, ordered by their hash, so repeated rows
are all proven; texts of any length are hashed by Spark; an empty table gives an empty result; columns
that are not named are never read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from turnloom.operators.ranges import range_positions
from turnloom.sources.sinks import discard, written

ARITY = 2
BLOCK_LEVELS = 12
SHARED = 16
MOST_SALTS = 4096
STEP = 33
ALONE, LEFT, RIGHT = b"\0" + bytes(32), b"\1", b"\2"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = StructType([
    StructField("tree", LongType()), StructField("level", LongType()), StructField("at", LongType()),
    StructField("hash", BinaryType()), StructField("segment", BinaryType()),
])


def leaf_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 in lowercase hex of ``-`` or byte count, colon and value per column."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def _parent(nodes: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def fold(leaf: bytes, segment: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for i in range(0, len(segment), STEP):
        side, sibling = segment[i:i + 1], segment[i + 1:i + STEP]
        leaf = _parent([sibling, leaf] if side == LEFT else [leaf, sibling] if side == RIGHT else [leaf])
    return leaf


def siblings(segment: bytes) -> list[bytes]:
    return [segment[i + 1:i + STEP] for i in range(0, len(segment), STEP) if segment[i]]


def _grow(level: int, first: int, nodes: list[bytes], total: int, bits: int
          ) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """All nodes of a block that begins at node ``first`` of ``level``, of ``total`` nodes there.

    The block's top, if it is not the only node of its level, leaves without a segment: its sibling lies in
    another block, and the next round knows it.
    """
    for up in range(bits + 1):
        if up == bits or total == 1:
            yield level + up, first, nodes[0], None
            return
        parents = []
        for i in range(0, len(nodes), ARITY):
            pair = nodes[i:i + ARITY]
            if len(pair) == 1:
                yield level + up, first + i, pair[0], ALONE
            else:
                yield level + up, first + i, pair[0], RIGHT + pair[1]
                yield level + up, first + i + 1, pair[1], LEFT + pair[0]
            parents.append(_parent(pair))
        nodes, first, total = parents, first // ARITY, -(-total // ARITY)


def _blocks(level: int, bits: int):
    """Rows (tree, at, hash, total at the level), sorted: one block of nodes in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, total, nodes, out = None, 0, 0, [], []
        for batch in batches:
            for tree, at, hashed, n in zip(*[c.to_pylist() for c in batch.columns]):
                if (tree, at >> bits) != key:
                    if nodes:
                        out.extend((key[0], *row) for row in _grow(level, first, nodes, total, bits))
                    key, first, total, nodes = (tree, at >> bits), at, n, []
                    if len(out) > 20_000:
                        yield _batch(out)
                        out = []
                nodes.append(hashed)
        if nodes:
            out.extend((key[0], *row) for row in _grow(level, first, nodes, total, bits))
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], NODES.names)


def grow_trees(leaves: DataFrame, bits: int = BLOCK_LEVELS) -> tuple[DataFrame, int]:
    """All nodes of the trees over (tree, at, hash, total), and the height of the highest tree.

    A subroot has no segment; every other node has its sibling.
    """
    most = leaves.agg(F.max("total")).first()[0] or 0
    height = max(most - 1, 0).bit_length()
    rows, level, parts = leaves.select("tree", "at", "hash", "total"), 0, []
    while True:
        dealt = rows.repartition("tree", F.shiftright("at", bits)).sortWithinPartitions("tree", "at")
        nodes = written(dealt.mapInArrow(_blocks(level, bits), NODES), "nodes")
        level += bits
        if level >= height:
            return _union([*parts, nodes]), height
        # Tops of blocks go on; where a tree ends below, its subroot stays.
        top = (F.col("level") == level) & F.col("segment").isNull()
        parts.append(nodes.where(~top))
        size = F.shiftright(F.col("total") - 1, level) + 1
        totals = leaves.where("at = 0").select("tree", size.alias("total"))
        rows = nodes.where(top).select("tree", "at", "hash").join(totals, "tree").select(
            "tree", "at", "hash", "total")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def segments(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, at, segment) per leaf, the siblings from the leaf to its tree's top, by pointer jumping."""
    rows = nodes.select("tree", "level", "at", F.coalesce("segment", F.lit(b"")).alias("segment"))
    distance, last = 1, None
    while distance < height:
        salts = min(max((1 << min(distance, 40)) // SHARED, 1), MOST_SALTS)
        target = rows.where(F.col("level") >= distance).select(
            F.col("tree").alias("_tree"), (F.col("level") - distance).alias("_level"), F.col("at").alias("_up"),
            F.col("segment").alias("_more"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
        here = rows.where(F.col("level") % (2 * distance) == 0)
        jumped = here.join(
            target,
            (F.col("tree") == F.col("_tree")) & (F.col("level") == F.col("_level"))
            & (F.shiftright("at", min(distance, 63)) == F.col("_up"))
            & (F.shiftright("at", SHARED.bit_length() - 1) % salts == F.col("_salt")), "left")
        rows = written(jumped.select("tree", "level", "at", F.concat(
            "segment", F.coalesce("_more", F.lit(b""))).alias("segment")), "jumps")
        if last is not None:
            discard(last)
        distance, last = 2 * distance, rows
    return rows.where("level = 0").select("tree", "at", "segment")


def manifest(
    rows: DataFrame, key: str = "doc_id", group: str = "lang", columns: Sequence[str] = COLUMNS,
    claims: Mapping[str, Column] | None = None, bits: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per row: key, group, position, leaf, segment (proof), subroot and root, in binary.

    ``claims`` replaces columns by other values; ``claim`` is then the leaf of the row so changed, which
    its proof should not verify.
    """
    claims = claims or {}
    hashed = rows.select(
        F.col(key).alias("key"), F.col(group).alias("group"),
        F.unhex(leaf_hash([F.col(c) for c in columns])).alias("leaf"),
        F.unhex(leaf_hash([claims.get(c, F.col(c)) for c in columns])).alias("claim"))
    hashed = written(hashed.withColumn("claim", F.when(F.col("claim") != F.col("leaf"), F.col("claim"))), "leaves")
    placed = range_positions(hashed, "position", [F.col("group"), F.col("key"), F.col("leaf")])
    groups = placed.groupBy("group").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("total"))
    groups = written(range_positions(groups, "tree", [F.col("group")]), "groups")
    own = placed.alias("p").join(groups.alias("g"), F.col("p.group").eqNullSafe(F.col("g.group"))).select(
        "p.key", "p.group", "p.leaf", "p.claim", "g.tree", "g.total",
        (F.col("p.position") - F.col("g.first")).alias("at"))
    own = written(own, "placed")
    nodes, height = grow_trees(own.select("tree", "at", F.col("leaf").alias("hash"), "total"), bits)
    subroots = nodes.where("segment is null").select("tree", F.col("hash").alias("subroot"))
    count = groups.count()
    tops, top_height = grow_trees(subroots.select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.col("subroot").alias("hash"),
        F.lit(count).cast("bigint").alias("total")), bits)
    root = tops.where("segment is null").select("hash").first()
    above = subroots.join(
        segments(tops, top_height).select(F.col("at").alias("tree"), F.col("segment").alias("above")), "tree")
    above = written(above.withColumn("root", F.lit(bytes(root[0]) if root else None).cast("binary")), "subroots")
    return own.join(segments(nodes, height), ["tree", "at"]).join(above, "tree").select(
        "key", "group", F.col("at").alias("position"), "leaf", "claim",
        F.concat("segment", "above").alias("segment"), "subroot", "root")


CHECKED = StructType([StructField("folded", BinaryType()), StructField("proof", BinaryType())])


@F.arrow_udf(CHECKED)
def checked(leaf: pa.Array, segment: pa.Array) -> pa.Array:
    """The root recomputed from a leaf and its segment, and the digest of the siblings."""
    folded, proof = [], []
    for a, s in zip(leaf.to_pylist(), segment.to_pylist()):
        folded.append(fold(a, s))
        proof.append(_parent(siblings(s)))
    return pa.StructArray.from_arrays(
        [pa.array(folded, pa.binary()), pa.array(proof, pa.binary())], ["folded", "proof"])


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    longer = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    rows = manifest(docs, claims={"n_chars": longer.cast("decimal(20,0)")})
    done = rows.withColumn("_c", checked(F.coalesce("claim", "leaf"), F.col("segment")))

    def text(c: str) -> Column:
        return F.lower(F.hex(F.col(c)))

    return done.select(
        F.col("key").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"),
        text("root").alias("root"), text("_c.proof").alias("proof_sha256"),
        text("_c.folded").alias("folded_root"), (F.col("_c.folded") == F.col("root")).alias("verified"))


def _hashed_sql(n_chars: str) -> str:
    def part(c: str) -> str:
        return f"coalesce(strlen(({c})::varchar) || ':' || ({c})::varchar, '-')"

    return f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit."""
    step = "lambda a, _: xor(a >> 1, 3988292384 * (a & 1))"
    return (
        f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint), "
        f"lambda c, b: xor(c >> 8, list_reduce(range(8), {step}, xor(c, b) & 255)), 4294967295::bigint), "
        "4294967295)")


ORACLE = f"""
with recursive d as (
  select *, case when {crc32_sql('doc_id::varchar')} % 7 = 0 then n_chars + 1 else n_chars end as claimed
  from documents),
leaves as (
  select doc_id, lang, {_hashed_sql('n_chars')} as leaf, {_hashed_sql('claimed')} as claim from d),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by lang) as n, dense_rank() over (order by lang nulls first) - 1 as tree
  from leaves),
nodes as (
  select tree, 0 as level, pos, leaf as hash, n from placed
  union all
  select tree, level + 1, pos // 2, sha256(string_agg(hash, '' order by pos)), (n + 1) // 2
  from nodes where n > 1 group by tree, level, pos // 2, n),
subroots as (select tree, hash, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as level, tree as pos, hash, n from subroots
  union all
  select level + 1, pos // 2, sha256(string_agg(hash, '' order by pos)), (n + 1) // 2
  from tops where n > 1 group by level, pos // 2, n),
steps as (
  select p.tree, p.pos, n.level, (p.pos >> n.level) & 1 as side, s.hash as sibling
  from placed p join nodes n on n.tree = p.tree and n.pos = p.pos >> n.level and n.n > 1
  left join nodes s on s.tree = n.tree and s.level = n.level and s.pos = xor(n.pos, 1)
  union all
  select p.tree, p.pos, 1000 + n.level, (p.tree >> n.level) & 1, s.hash
  from placed p join tops n on n.pos = p.tree >> n.level and n.n > 1
  left join tops s on s.level = n.level and s.pos = xor(n.pos, 1)),
proofs as (
  select tree, pos, sha256(coalesce(string_agg(sibling, '' order by level), '')) as proof_sha256,
    list({{'side': side, 'sibling': coalesce(sibling, '')}} order by level) as steps
  from steps group by tree, pos),
folded as (
  select p.doc_id, p.leaf, s.hash as subroot, (select hash from tops where n = 1) as root,
    coalesce(q.proof_sha256, sha256('')) as proof_sha256,
    list_reduce(coalesce(q.steps, []), lambda h, x: {{'side': 0::bigint, 'sibling':
      sha256(case when x.side = 1 then x.sibling || h.sibling else h.sibling || x.sibling end)}},
      {{'side': 0::bigint, 'sibling': p.claim}}).sibling as folded_root
  from placed p join subroots s using (tree) left join proofs q using (tree, pos))
select *, folded_root = root as verified from folded
"""
