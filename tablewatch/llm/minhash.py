"""Near duplicates by a join on MinHash signature coordinates.

Every document is posted under each (coordinate, value) pair of its signature. Two documents whose
shingle sets have a Jaccard similarity of 0.8 agree in about 0.8 of the coordinates; a pair is retained
for confirmation when it collides in ``threshold`` of them.

*Prefix*: a pair that agrees in T of K coordinates shares one of the K - T + 1 rarest pairs of either
document, so only those are posted; a pair that a single document holds is not posted at all, yet
fills a place of the prefix, which removes most documents at once. *Skip*: the frequent pairs left out
of the postings are never merged; the collisions in them are counted in the signatures of the documents
that the short lists brought together. Retained pairs are confirmed on the full shingle sets.

Lists are gathered by leader: the document of a list whose signature is the most common in its coordinates, which is
the text that others were copied from rather than one of the copies. A document joins the group of every leader that
leads one of its lists, so two documents that share a list share a group. In a group all are compared with the leader first,
then those that the leader doesn't link with all others, by counted collisions and then by full sets;
a group gives a forest of links, never its pairs. A group that is too large for one task is dealt in blocks, each with
the leader; what is then still apart from the leader's component meets the other blocks, pair of blocks by pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .components import components
from .session import released, written

#: Probability below 1e-5 of missing a pair that lies exactly on a similarity of 0.8.
COORDINATES, THRESHOLD = 64, 36
#: What a task compares at once: so many documents, and so many shingles of them.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
_FILTER_BITS = 24

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, 256, dtype=np.uint64)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    a, b = _A[:coordinates], _B[:coordinates]
    low = np.full(coordinates, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None] * a
        part += b
        np.minimum(low, part.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _key(shingles: np.ndarray) -> bytes:
    """Tells shingle sets apart."""
    return np.array([np.sum(tx.mix(shingles)), np.sum(tx.mix(shingles ^ _A[0]))]).tobytes()


def signatures(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """(doc_id, n_shingles, key, sig, sketch): key, sig and sketch (the low byte of each coordinate) are null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column("text")):
                sets = list(tx.shingle_sets(data, offsets, width))
                keys = [_key(s) if len(s) else None for s in sets]
                sigs = [signature(s, coordinates) if len(s) else None for s in sets]
                sketches = [None if s is None else s.astype(np.uint8).tobytes() for s in sigs]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], ["doc_id", "n_shingles", "key", "sig", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(sign), "doc_id long, n_shingles long, key binary, sig array<int>, sketch binary")


def member_bits(slots: DataFrame) -> bytes:
    """A filter of fixed size (2 MB) that lets every ``slot`` below 2**24 pass, and others by chance."""
    rows = slots.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    bits = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    for row in rows:  # at most 2**24 / 32768 + 1 rows
        part = np.frombuffer(row.bits, np.uint8)
        at = (row.k - 1) * len(part)
        if row.k > 0 and at < len(bits):
            bits[at : at + len(part)] |= part
        elif row.k == 0:
            bits[0] |= 1
    return bits.tobytes()


def packed_texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, key, packed binary): compressed texts of the documents whose ids are nodes of ``wanted``, and others by chance.

    Confirmation needs full shingle sets. They are sent as the text that they come from, compressed: that is
    a third of the bytes of a set of 64-bit hashes, which don't compress.
    """
    slot = F.pmod(F.xxhash64("node"), F.lit(1 << _FILTER_BITS)).alias("slot")
    shared = docs.sparkSession.sparkContext.broadcast(member_bits(wanted.select(slot)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, press = np.frombuffer(shared.value, np.uint8), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            # bitmap_bucket_number counts from 1 for positive slots; slot 0 stands alone
            at = np.maximum(batch.column("slot").to_numpy() - 1, 0)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            chosen = batch.filter(pa.array(hit.astype(bool)))
            for a, b, data, offsets in tx.slices(chosen.column("text")):
                keys = [_key(s) if len(s) else None for s in tx.shingle_sets(data, offsets, width)]
                packed = [press.compress(data[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([chosen.column("node").slice(a, b - a), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["node", "key", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")).where("node is not null and text is not null")
    return rows.select("node", "text", slot).mapInArrow(released(make), "node long, key binary, packed binary")


# -- cells: the rows of a group (or of two blocks of one) that a task compares ------------------------

_CELL = ["leader", "i", "j"]
#: side: 0 is compared with 1, 2 with all
_ROW = [*_CELL, "head", "side", "cid", "node", "group", "key"]
_ROW_KINDS = "leader long, i int, j int, head boolean, side int, cid long, node long, group long, key binary"


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL, F.col("head").desc(), "cid")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole cells, and where each begins and the last ends; rows come in order by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        last = [batch.column(c)[-1].as_py() for c in _CELL]
        if [held[0].column(c)[0].as_py() for c in _CELL] == last:
            continue  # one cell so far
        table = pa.Table.from_batches(held)
        edge = _edges(table)
        yield table.slice(0, edge[-2]), edge[:-1]
        held = table.slice(edge[-2]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, _edges(table)


def _edges(table: pa.Table) -> list[int]:
    cells = np.stack([table.column(c).to_numpy() for c in _CELL])
    return [0, *(np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]


def colliding(sketches: np.ndarray, group: np.ndarray, side: np.ndarray, threshold: int) -> np.ndarray:
    """Which rows collide in ``threshold`` coordinates with one of another group that they are to be compared with.

    Where all are compared with all, those that the first row retains need no more counting: they are kept as they are.
    """
    n = len(sketches)
    near = ((sketches == sketches[0]).sum(axis=1) >= threshold) & (side[0] == 2)
    alive = near & (near & (group != group[0])).any()
    rest = np.flatnonzero(~near & (side != 1))
    columns = np.ascontiguousarray(sketches.T)
    step = max(1, (1 << 22) // n)
    for a in range(0, len(rest), step):
        at = rest[a : a + step]
        count = np.zeros((len(at), n), np.uint8 if sketches.shape[1] < 256 else np.uint16)
        for column in columns:
            count += column[at, None] == column
        met = (count >= threshold) & (group[at, None] != group) & ((side[at, None] == 2) | (side != 0))
        alive[at] |= met.any(axis=1)
        alive |= met.any(axis=0)
    return alive


def forest(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links and the groups that they make: links enough to join what is linked: pairs of rows with 100 * |intersection| >= ``percent`` * |union|.

    The first row is compared with all, then each row that is not joined to the largest group so far with all. Rows of
    side 0 are compared with those of side 1 only, whatever they are joined to.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    label, mark, links = group.copy(), np.zeros(len(code), np.int32), []

    def compare(x: int) -> None:
        own = code[edge[x] : edge[x + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[code], edge[:-1])
        mark[own] = 0
        hit = (100 * common >= percent * (sizes + sizes[x] - common)) & ((side[x] == 2) | (side != side[x]))
        for y in np.flatnonzero(hit).tolist():
            if label[x] != label[y]:
                links.append((x, y))
                label[label == label[y]] = label[x]

    compare(0)
    names, first, n = np.unique(label, return_index=True, return_counts=True)
    core = first[n.argmax()]
    for x in np.flatnonzero(side != 1).tolist()[1:]:
        if (side[x] == 0 or label[x] != label[core]) and (label != label[x]).any():
            compare(x)
    return links, label


def _retained(rows: DataFrame, threshold: int) -> DataFrame:
    """The rows of cells that take part in a retained pair, without their sketches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edge in _whole_cells(batches):
            group, side = (table.column(c).to_numpy() for c in ("group", "side"))
            raw = b"".join(table.column("sketch").to_pylist())
            sketches = np.frombuffer(raw, np.uint8).reshape(table.num_rows, -1)
            alive = np.zeros(table.num_rows, bool)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a > 1:
                    alive[a:b] = colliding(sketches[a:b], group[a:b], side[a:b], threshold)
            yield from table.select(_ROW).filter(pa.array(alive)).to_batches()

    return _dealt(rows.select(*_ROW, "sketch")).mapInArrow(released(count), _ROW_KINDS)


def _linked(rows: DataFrame, docs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """(a, b, leader): nodes of a forest of links for each cell of retained ``rows``; leader where the link is in the leader's group."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for table, edge in _whole_cells(batches):
            group, side, node, cid, leader = (table.column(c).to_numpy() for c in ("group", "side", "node", "cid", "leader"))
            packed, found = table.column("packed"), []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                once = np.flatnonzero(np.concatenate([[True], (cid[a + 1 : b] != cid[a : b - 1]) | (side[a + 1 : b] != side[a : b - 1])])) + a  # repeated rows of documents
                if len(once) < 2:
                    continue
                raws = [unpack(packed[i].as_py()) for i in once.tolist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in raws])])
                sets = list(tx.shingle_sets(np.frombuffer(b"".join(raws), np.uint8), offsets, width))
                links, label = forest(sets, group[once], side[once], percent)
                led = cid[a] == leader[a]  # the leader, if it is here, stands first
                found += [(node[once[x]], node[once[y]], leader[a] if led and label[x] == label[0] else None) for x, y in links]
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "leader"])

    rows = written(rows, f"retained-{name}")
    texts = packed_texts(docs, rows.select("node"), width)
    sides = rows.hint("merge").join(texts, ["node", "key"]).select(*_CELL, "head", "side", "cid", "node", "group", "packed")
    return written(_dealt(sides).mapInArrow(released(check), "a long, b long, leader long"), f"links-{name}")


def _posted(classes: DataFrame, coordinates: int, threshold: int) -> DataFrame:
    """(leader, cid): the leaders of the short lists of each class, itself among them where it leads."""
    token = F.shiftleft(F.col("j").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = classes.select("cid", F.posexplode("sig").alias("j", "v")).select("cid", token.alias("token"))
    # pairs that at least two classes hold; the rarest first. Both sides grow with the corpus, so they are merged
    shared = posted.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1")
    prefix = coordinates - threshold + 1
    own = posted.hint("merge").join(shared, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("own")).where(F.size("own") >= threshold)
    own = own.withColumn("weight", F.aggregate("own", F.lit(0).cast("long"), lambda sum_, p: sum_ + p["freq"]))
    short = own.select("cid", "weight", F.explode(F.slice("own", F.lit(1), F.greatest(F.lit(0), F.lit(prefix - coordinates) + F.size("own")))).alias("p")).select("cid", "weight", F.col("p.token").alias("token"))
    short = written(short, "short-lists")
    lead = F.max(F.struct("weight", (-F.col("cid")).alias("order"), F.col("cid").alias("leader")))
    lists = short.groupBy("token").agg(F.count("*").alias("freq"), lead.alias("lead")).where("freq > 1").select("token", "lead.leader")
    return short.hint("merge").join(lists, "token").select("leader", "cid").distinct()


def _blocks(n: str, shingles: str, block: int) -> F.Column:
    return F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Words are what stands between spaces and the controls from tab to carriage return, with A-Z lowered.
    A text's set holds its distinct ``width``-word shingles (fewer words: the whole sequence as one).
    Two documents are linked when 100 * |intersection| >= ``percent`` * |union|; component_id is the
    smallest doc_id reachable through links, kept whether that is the document itself.

    Null, empty and blank texts have an empty set and no link. Repeated texts are linked, repeated
    doc_ids count as one document (with the union of their links). A null doc_id has no
    component and is kept. Texts may be of any length. Further columns of ``docs`` are not read, so their names
    may be anything. An empty table gives no rows.
    """
    signed = written(signatures(docs, width, coordinates), "signatures")
    linked = signed.where("doc_id is not null and key is not null")
    # cid: unique where it is written, also for rows that share a doc_id
    classes = linked.groupBy("key").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n_shingles", "sig", "sketch")])
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    members = _posted(classes, coordinates, threshold).hint("merge").join(classes.drop("sig"), "cid")
    members = written(members.withColumn("head", F.col("leader") == F.col("cid")), "members")
    groups = members.groupBy("leader").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    large = written(groups.select("leader", _blocks("n", "s", block).alias("blocks")).where("blocks > 1"), "large-groups")

    # each group by itself, or in blocks with its leader in each
    cells = members.join(large, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.when(F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")))
    cells = cells.withColumn("i", F.explode(own)).withColumns({"j": F.lit(0), "side": F.lit(2), "group": F.col("node")})
    links = _linked(_retained(cells, threshold), docs, width, percent, "first")

    if not large.isEmpty():  # what isn't joined to its leader meets all blocks
        joined = links.where("leader is not null").select("leader", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("led", F.lit(True))
        lead = members.where("head").select("leader", F.col("node").alias("top"))
        some = members.join(large.select("leader"), "leader").join(lead, "leader").join(joined, ["leader", "node"], "left")
        some = some.withColumn("group", F.when(F.col("led"), F.col("top")).otherwise(F.col("node"))).withColumn("rest", F.col("group") != F.col("top"))
        some = written(some.drop("head", "led", "top"), "still-apart")
        sizes = some.groupBy("leader").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.count_if("rest").alias("rn"), F.sum(F.when(F.col("rest"), F.col("n_shingles"))).alias("rs")).where("rn > 0")
        some = some.join(sizes.select("leader", _blocks("n", "s", block).alias("all"), _blocks("rn", "rs", block).alias("few")), "leader")
        of = lambda n: F.pmod(F.xxhash64("cid", F.lit(1)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x = some.where("rest").withColumn("i", of("few")).withColumn("j", every("all")).withColumn("side", F.lit(0))
        y = some.withColumn("j", of("all")).withColumn("i", every("few")).withColumn("side", F.lit(1))
        second = x.unionByName(y).withColumn("head", F.col("side") == 0)
        links = links.union(_linked(_retained(second, threshold), docs, width, percent, "second"))

    # doc_ids that stand in several classes link them
    stands = linked.select("doc_id", "key").hint("merge").join(classes.select("key", "node"), "key").select("doc_id", "node").distinct()
    again = stands.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    same_id = stands.join(again, "doc_id").where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b"))
    found = components(links.select("a", "b").unionByName(same_id)).withColumnRenamed("component", "root")
    of = classes.select("key", "node").hint("merge").join(found, "node", "left").select("key", F.coalesce("root", "node").alias("component"))
    empty = signed.where("doc_id is null or key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = linked.hint("merge").join(of, "key").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
