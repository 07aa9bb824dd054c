"""A Merkle manifest of the documents by supersteps over RDDs.

Every row is a leaf; the leaves of a source, by id, and then the sources' roots, by
name, are folded sixteen at a time. The leaves are sorted once, which gives each its
place; a task sends its parents one message for all their children that it holds. In a
superstep the parents that have their children hash them and message their own parents;
what a superstep made is written to the shared folder, so that a lost executor costs
that superstep's lost part only. Reverse supersteps send each node the siblings on its
way to the root, down to the parents of leaves, which fold every leaf again. No task
holds more than sixteen children and their way of a node, whatever a source's size.

Edge cases: nulls in any column are hashed as "-"; an empty text as "0:"; rows of one id
are ordered by their leaf's hash, so repeated rows are alike leaves beside each other; null
ids come first and aren't tampered with; null is a source of its own; an empty table gives
no rows; extra columns aren't read; texts of any length are hashed within Spark's
expressions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import chain, groupby
from string import ascii_lowercase, ascii_uppercase

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import cut, shared_folder

FAN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: One in so many documents, by the checksum of its id, is tampered with.
EVERY = 5

#: A node of a tree: its tree (the place of a source, or TOP for the tree of sources) and its place in its level.
Key = tuple[int, int]
TOP = -1
#: On the way from a node to the root, a level's place among siblings and their digests.
Way = tuple[tuple[int, bytes], ...]


def coded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(row: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[coded(row[f]) for f in FIELDS]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and the leaf of the tampered row where there is one."""
    row = {f: docs[f] for f in FIELDS}
    lowered = row | {"text": F.translate(row["text"], ascii_uppercase, ascii_lowercase)}
    dealt = F.crc32(row["doc_id"].cast("string").cast("binary")) % EVERY == 0
    return docs.select("doc_id", "source", leaf(row).alias("leaf"), F.when(dealt, leaf(lowered)).alias("tampered"))


def digest(children: Iterable[bytes]) -> bytes:
    return sha256("".join([c.hex() for c in children]).encode()).digest()


# ---- places ---------------------------------------------------------------------------


def _extent(k: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row for a partition of sorted leaves: its sources' ends, how many there are, and the sizes that matter."""
    first, n, size, most = None, 0, 0, 0
    for source, own in groupby(rows, lambda r: r[1]):
        size = sum(1 for _ in own)
        first, last, n, most = (source if n == 0 else first), source, n + 1, max(most, size)
    if n:
        yield k, first, last, n, size, most


def placed(extents: list[tuple]) -> tuple[dict[int, tuple[int, int, bool]], int, int]:
    """By partition the place of its first source, that of its first leaf therein, and whether its last source ends with it; how many sources there are, and the leaves of the largest."""
    out: dict[int, tuple[int, int, bool]] = {}
    rank, run, largest, before = -1, 0, 0, None
    for k, first, last, n, size, most in extents:
        goes_on = before is not None and extents[before][2] == first
        if before is not None:
            p = extents[before][0]
            out[p] = (*out[p][:2], not goes_on)
        start, at = (rank, run) if goes_on else (rank + 1, 0)
        out[k] = (start, at, True)
        rank, run = start + n - 1, size + (at if n == 1 else 0)
        largest, before = max(largest, most, run), (0 if before is None else before + 1)
    return out, rank + 1, largest


def _first_messages(places: dict[int, tuple[int, int, bool]]) -> Callable:
    """Sorted leaves -> messages to their parents, one for all children of a parent that this task holds."""

    def run(k: int, rows: Iterator[tuple]) -> Iterator[tuple[Key, tuple]]:
        if k not in places:
            return
        rank, at, ends = places[k]
        held: list[tuple] = []
        source = None
        for j, row in enumerate(rows):
            if j and row[1] != source:
                yield (rank, (at - 1) // FAN), (held, True)
                rank, at, held = rank + 1, 0, []
            elif held and at % FAN == 0:
                yield (rank, at // FAN - 1), (held, False)
                held = []
            source = row[1]
            held.append((at % FAN, bytes(row[2]), row[0], None if row[3] is None else bytes(row[3])))
            at += 1
        yield (rank, (at - 1) // FAN), (held, ends)

    return run


# ---- supersteps -----------------------------------------------------------------------


def _gathered(messages: RDD, parts: int) -> RDD:
    """Nodes that have their children: key, children by place, and whether no node of this level comes after."""

    def full(group: tuple[Key, Iterable[tuple]]) -> tuple[Key, list[tuple], bool]:
        key, parts_of = group[0], list(group[1])
        children = sorted(chain.from_iterable(c for c, _ in parts_of))
        last = any(ends for _, ends in parts_of)
        if [c[0] for c in children] != list(range(len(children))) or not (last or len(children) == FAN):
            raise ValueError(f"node {key} lacks children")
        return key, children, last

    return messages.groupByKey(parts).map(full)


def _whole(key: Key, last: bool) -> bool:
    return last and key[1] == 0


def _own_digest(children: list[tuple], key: Key, last: bool, lowest: bool) -> bytes:
    """A tree of one leaf is that leaf."""
    return children[0][1] if lowest and len(children) == 1 and _whole(key, last) else digest(c[1] for c in children)


def _up(level: int) -> Callable:
    def run(node: tuple[Key, list[tuple], bool]) -> Iterator[tuple[Key, tuple]]:
        key, children, last = node
        if not _whole(key, last):
            yield (key[0], key[1] // FAN), ([(key[1] % FAN, digest(c[1] for c in children))], last)

    return run


def _roots(level: int) -> Callable:
    """The nodes that are their trees' roots: place of the source, digest, level."""

    def run(node: tuple[Key, list[tuple], bool]) -> Iterator[tuple[int, bytes, int]]:
        key, children, last = node
        if _whole(key, last):
            yield key[0], _own_digest(children, key, last, level == 1), level

    return run


def _levels(n: int) -> int:
    """Levels above n leaves, one at least."""
    k = 1
    while n > FAN:
        n, k = -(-n // FAN), k + 1
    return k


def _ways(children: list[tuple], way: Way, alone: bool) -> Iterator[tuple[tuple, Way]]:
    for c in children:
        yield c, way if alone else ((c[0], b"".join([o[1] for o in children if o[0] != c[0]])), *way)


def _down(lowest: bool) -> Callable:
    """A node and its way to the root -> messages to its children."""

    def run(met: tuple[Key, tuple[Iterable, Iterable]]) -> Iterator[tuple[Key, tuple]]:
        key, (nodes, messages) = met
        (children, last), (subroot, way) = *nodes, *messages
        for c, own in _ways(children, way, lowest and len(children) == 1 and _whole(key, last)):
            yield (key[0], key[1] * FAN + c[0]), (subroot, own)

    return run


def folded(value: bytes, way: Way) -> bytes:
    """The root that a node and the siblings on its way give."""
    for place, others in way:
        value = digest([*[others[k : k + 32] for k in range(0, 32 * place, 32)], value, *[others[k : k + 32] for k in range(32 * place, len(others), 32)]])
    return value


def _results(root: bytes) -> Callable:
    def run(met: tuple[Key, tuple[Iterable, Iterable]]) -> Iterator[tuple]:
        key, (nodes, messages) = met
        (children, last), (subroot, way) = *nodes, *messages
        tail = "".join([others.hex() for _, others in way])
        known: dict[bytes, bytes] = {}
        for (_, own, doc_id, tampered), whole in _ways(children, way, len(children) == 1 and _whole(key, last)):
            first = whole[: len(whole) - len(way)]
            value = folded(tampered or own, first)
            if value not in known:
                known[value] = folded(value, way)
            proof = sha256(("".join([others.hex() for _, others in first]) + tail).encode()).hexdigest()
            yield doc_id, own.hex(), subroot.hex(), root.hex(), proof, known[value].hex(), known[value] == root

    return run


def op11_merkle(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}"
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def kept(rdd: RDD, name: str, level: int) -> RDD:
        """A level has a sixteenth of the nodes of the one below, and is written by as many fewer tasks."""
        rdd.coalesce(max(1, parts // FAN ** (level - 1))).saveAsPickleFile(f"{folder}/{name}")
        return context.pickleFile(f"{folder}/{name}")

    # rows that are alike in all that orders them are told apart by their number, so that no range is larger than others
    numbered = cut(leaves(docs)).withColumn("number", F.monotonically_increasing_id())
    rows = numbered.orderBy(F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), "leaf", "number").drop("number").rdd.map(tuple)
    places, sources, largest = placed(sorted(rows.mapPartitionsWithIndex(_extent).collect()))
    if not sources:
        return spark.createDataFrame([], schema)

    def grown(messages: RDD, name: str, levels: int) -> dict[int, RDD]:
        """The nodes of each level, written."""
        nodes = {}
        for k in range(1, levels + 1):
            nodes[k] = kept(_gathered(messages, max(1, parts // FAN ** (k - 1))), f"{name}-{k}", k)
            messages = nodes[k].flatMap(_up(k))
        return nodes

    lower = grown(rows.mapPartitionsWithIndex(_first_messages(places)), "node", _levels(largest))
    subroots = kept(context.union([nodes.flatMap(_roots(k)) for k, nodes in lower.items()]), "subroot", 2)
    tops = grown(subroots.map(lambda s: ((TOP, s[0] // FAN), ([(s[0] % FAN, s[1])], s[0] == sources - 1))), "top", _levels(sources))
    root = tops[max(tops)].flatMap(_roots(max(tops))).first()[1]

    def met(nodes: RDD, messages: RDD, k: int) -> RDD:
        return nodes.map(lambda n: (n[0], (n[1], n[2]))).cogroup(messages, max(1, parts // FAN ** (k - 1)))

    messages = context.parallelize([((TOP, 0), (b"", ()))], 1)
    for k in sorted(tops, reverse=True):
        messages = kept(met(tops[k], messages, k).flatMap(_down(k == 1)), f"way-top-{k}", k + 1)
    started = subroots.map(lambda s: ((TOP, s[0]), (s[1], s[2]))).join(messages, parts).map(lambda m: (m[1][0][1], ((m[0][1], 0), (m[1][0][0], m[1][1][1]))))
    started = kept(started, "started", 2)
    messages = context.parallelize([], 1)
    for k in sorted(lower, reverse=True):
        into = messages.union(started.filter(lambda m, k=k: m[0] == k).map(lambda m: m[1]))
        if k == 1:
            return spark.createDataFrame(met(lower[1], into, 1).flatMap(_results(root)), schema, verifySchema=False)
        messages = kept(met(lower[k], into, k).flatMap(_down(False)), f"way-{k}", k)
    raise AssertionError("no level")
