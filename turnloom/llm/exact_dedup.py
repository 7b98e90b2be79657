"""Exact dedup by owners in compressed radix (Patricia) tries.

Rows are partitioned by length and content hash. All texts of a partition, full byte strings, are
inserted into one trie with compressed edges; the terminal node of a text holds the identifier that owns
it and the number of rows. Equal means equal bytes after lower-casing A-Z, compared along the edges; the
hash only chooses the partition, so texts of one partition share edges as far as their prefixes go.

Every input task first inserts its own rows into a trie of its own, so a text reaches the shuffle once
per flush of a task however many rows hold it, and one group of copies may be any share of the table.
A trie's budget counts its nodes as well as their labels. One that grows beyond it spills its largest
subtree to a file of the task and finishes it later on its own, so a partition may be larger than memory;
a single text must fit into it.

Defined cases: null counts as the empty text, all of which are one group; several rows with the same
identifier are rows of their own (``owners`` returns each, the group counts them all, and each row with
the owning identifier is kept there; ``keep_owners`` keeps one of them, the least as JSON); a null
identifier loses against any other; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    BinaryType, LongType, StringType, StructField, StructType,
)

from turnloom.llm.text import fresh
from turnloom.sources.sinks import written

BUDGET = 96 << 20
NODE = 360  # bytes of a node beside its label: object, its place among its parent's children, numbers
LEAF: dict = {}  # the children of every node that has none
CLASSES = StructType([
    StructField("length", LongType()), StructField("hash", LongType()),
    StructField("text", BinaryType()), StructField("owner", LongType()),
    StructField("size", LongType()),
])
GROUPS = StructType([
    StructField("sha256", StringType()), StructField("keep_id", LongType()),
    StructField("group_size", LongType()),
])


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Node:
    """An edge label, the children by their first byte, and the owner when a text ends here."""

    __slots__ = ("label", "children", "owner", "size", "held", "spilled")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = LEAF
        self.owner: int | None = None
        self.size = 0  # rows whose text ends here
        self.held = NODE + len(label)  # bytes of this subtree
        self.spilled = None  # file with the rest of texts below this node

    def add(self, child: Node) -> None:
        if self.children is LEAF:
            self.children = {}
        self.children[child.label[0]] = child


class Trie:
    """Full byte strings with their owners; bounded memory by spilling subtrees."""

    def __init__(self, pick=larger, budget: float = BUDGET):
        self.root, self.pick, self.budget, self.spills = Node(b""), pick, budget, 0

    @property
    def held(self) -> int:
        return self.root.held

    def insert(self, text: bytes, owner: int | None, size: int = 1) -> None:
        node, at, path = self.root, 0, [self.root]
        while True:
            if node.spilled is not None:
                pickle.dump((text[at:], owner, size), node.spilled)
                return
            if at == len(text):
                node.owner = self.pick(node.owner, owner) if node.size else owner
                node.size += size
                self._shrink()
                return
            child = node.children.get(text[at])
            if child is None:
                leaf = Node(text[at:])
                leaf.owner, leaf.size = owner, size
                node.add(leaf)
                for above in path:
                    above.held += leaf.held
                self._shrink()
                return
            if not text.startswith(child.label, at):
                child = self._split(node, child, text, at)
                for above in path:
                    above.held += NODE
            at += len(child.label)
            node = child
            path.append(node)

    def _split(self, parent: Node, child: Node, text: bytes, at: int) -> Node:
        """Cut an edge where the text leaves it."""
        label, lo, hi = child.label, 1, min(len(child.label), len(text) - at)
        while lo < hi:  # longest common prefix, by halves
            mid = (lo + hi + 1) // 2
            if text.startswith(label[:mid], at):
                lo = mid
            else:
                hi = mid - 1
        upper = Node(label[:lo])
        upper.held = child.held + NODE
        child.label = label[lo:]
        child.held -= lo
        upper.add(child)
        parent.children[label[0]] = upper
        return upper

    def _shrink(self) -> None:
        while self.held > self.budget and self._spill():
            pass

    def _spill(self) -> bool:
        """Write the texts below the largest child subtree of the first shared node to a file.

        One byte of its label stays, so that the node is found again."""
        path = [self.root]
        while len(path[-1].children) == 1:
            (only,) = path[-1].children.values()
            if only.spilled is not None or only.children is LEAF:
                return False
            path.append(only)
        open_ = [c for c in path[-1].children.values() if c.spilled is None]
        if not open_:
            return False
        target = max(open_, key=lambda c: c.held)
        file = tempfile.TemporaryFile()
        for text, owner, size in _terminals(target, b""):
            pickle.dump((text[1:], owner, size), file)
        freed = target.held - NODE - 1
        target.label, target.children, target.owner, target.size = target.label[:1], LEAF, None, 0
        target.spilled, target.held = file, NODE + 1
        for above in path:
            above.held -= freed
        self.spills += 1
        return True

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Every text with its owner and number of rows."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            here = before + node.label
            if node.size:
                yield here, node.owner, node.size
            if node.spilled is not None:
                rest = Trie(self.pick, self.budget)
                for row in _read(node.spilled):
                    rest.insert(*row)
                for text, owner, size in rest.items():
                    yield here + text, owner, size
            stack.extend((c, here) for c in node.children.values())


def _terminals(node: Node, before: bytes) -> Iterator[tuple[bytes, int | None, int]]:
    stack = [(node, before)]
    while stack:
        node, before = stack.pop()
        here = before + node.label
        if node.size:
            yield here, node.owner, node.size
        if node.spilled is not None:
            for rest, owner, size in _read(node.spilled):
                yield here + rest, owner, size
        stack.extend((c, here) for c in node.children.values())


def _read(file) -> Iterator[tuple[bytes, int | None, int]]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            file.close()
            return


def _content_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _normalised(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The texts of a batch in UTF-8, A-Z lower-cased (``bytes.lower`` touches no other byte)."""
    for value in batch.column(1):
        yield (value.as_py() or b"").lower()


def _local(pick, budget: int = BUDGET):
    """Insert a task's own rows; a flush gives one row per distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(pick, math.inf)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for owner, text in zip(ids, _normalised(batch)):
                trie.insert(text, owner)
                if trie.held > budget:
                    yield from _flush(trie)
                    trie = Trie(pick, math.inf)
        yield from _flush(trie)

    return run


def _flush(trie: Trie, rows: int = 512) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for text, owner, n in trie.items():
        out.append((len(text), _content_hash(text), text, owner, n))
        size += len(text)
        if len(out) >= rows or size > 4 << 20:
            yield _batch(out, CLASSES)
            out, size = [], 0
    if out:
        yield _batch(out, CLASSES)


ARROW = {LongType(): pa.int64(), StringType(): pa.string(), BinaryType(): pa.binary()}


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, ARROW[f.dataType]) for c, f in zip(columns, schema)], schema.names)


def _merge(pick, budget: int = BUDGET):
    """All texts of a partition in one trie; groups of two rows or more leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(pick, budget), []
        for batch in batches:
            _, _, text, owner, size = batch.columns
            for value, *row in zip(text, owner.to_pylist(), size.to_pylist()):
                trie.insert(value.as_py(), *row)
        for text, owner, size in trie.items():
            if size > 1:
                out.append((hashlib.sha256(text).hexdigest(), owner, size))
                if len(out) >= 4096:
                    yield _batch(out, GROUPS)
                    out = []
        if out:
            yield _batch(out, GROUPS)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = [hashlib.sha256(t).hexdigest() for t in _normalised(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(shas, pa.string())], ["doc_id", "sha256"])


DIGESTS = StructType([StructField("doc_id", LongType()), StructField("sha256", StringType())])


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest"
           ) -> DataFrame:
    """Groups of two rows or more with equal texts: sha256, keep_id, group_size."""
    pick = {"largest": larger, "smallest": smaller}[keep]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).cast("binary").alias("text"))
    return (
        rows.mapInArrow(_local(pick), CLASSES)
        .repartition("length", "hash")
        .mapInArrow(_merge(pick), GROUPS)
    )


def owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest"
           ) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256.

    The tries decide which texts are equal. A row finds its group by the SHA-256 of its text, so only
    identifiers and digests meet here; a hot group is split by the skew join.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).cast("binary").alias("text"))
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return (
        rows.mapInArrow(_digests, DIGESTS)
        .join(groups(docs, doc_id, text, keep), "sha256", "left")
        .select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"),
                F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
                F.col("sha256").alias("text_sha256"))
    )


@F.arrow_udf(StringType())
def _digest(column: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256((v.as_py() or b"").lower()).hexdigest() for v in column],
                    pa.string())


def keep_owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                keep: str = "largest") -> DataFrame:
    """One row for every different text, its owner's, with all columns.

    Of an owner's repeated rows the least as JSON stays. What a row has to know, that it goes or that it
    is repeated, is written as a narrow table first; without repeated owners no text is shuffled for them.
    """
    sha = fresh("sha256", docs.columns)
    marks = written(
        owners(docs, doc_id, text, keep).groupBy("text_sha256", "doc_id", "kept")
        .agg(F.count("*").alias("n")).where(~F.col("kept") | (F.col("n") > 1))
        .select("kept", F.col("doc_id").alias("_marked"), F.col("text_sha256").alias("_sha256")), "marks")
    keyed = docs.withColumn(sha, _digest(F.col(text).cast("binary")))
    same = ((F.col(f"k.{sha}") == F.col("m._sha256"))
            & F.col(f"k.`{doc_id}`").cast("long").eqNullSafe(F.col("m._marked")))
    rest = keyed.alias("k").join(marks.alias("m"), same, "left_anti").drop(sha)
    again = marks.where("kept")
    if again.isEmpty():
        return rest
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = (
        keyed.alias("k").join(again.alias("m"), same, "left_semi")
        .groupBy(sha, F.col(f"`{doc_id}`").cast("long"))
        .agg(F.min_by(row, F.to_json(row)).alias(sha + "_row")).select(sha + "_row.*")
    )
    return rest.unionByName(once)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return owners(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
with t as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""
