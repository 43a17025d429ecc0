"""Similarity join of shingle sets over a matrix of tokens and groups.

*Groups*: similar documents are partitioned into groups. A document's rarest tokens are its prefix: any document that is similar enough shares one
of them, so those that share none with another have no link and are gone at once. Of the documents that hold a prefix token one
leads (the one whose tokens are the most common, which is the text that others were copied from); a document joins the best leader of its tokens. Large
groups are cut into blocks, each with the leader.

*Matrix*: the prefix tokens that each block's members hold. A document looks its own up there, and so finds the blocks of other
groups that may hold a link; of two groups only one asks the other.

*Bound*: a block stores the union of its members' tokens. A document that has less than the wanted share of its tokens
in that union is like none of the members, and the block stays closed to it. Where it opens, exact intersections come from a product
of 0/1 matrices for common tokens and from lists for rare ones.

A block returns a forest of links, never its pairs. Members of a group's several blocks that are not linked to the leader then
meet the other blocks; all others are linked through the leader already.

Any fixed order of all tokens makes a right prefix. This one puts a quarter of all tokens first, chosen by their hash and
ordered by how many documents hold them; so counts cover all documents, and three quarters of the tokens are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import text as tx
from .components import components
from .minhash import _dealt, _key, _whole_cells, packed_texts
from .session import written

#: One in so many tokens is counted.
COUNTED = 4
#: What a task compares at once: so many documents on a side, and so many shingles of them.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Rows of the matrix of intersections that are held at a time, tokens of a product, and pairs from lists of rare tokens.
_ROWS, _TOKENS, _PAIRS = 512, 1024, 1 << 19

_ROW = ["leader", "i", "j", "head", "side", "cid", "node", "key"]


def prefix_size(n: int, percent: int) -> int:
    """So many tokens of a set of ``n`` that any set with ``percent`` similarity shares one of them."""
    return n - (percent * n + 99) // 100 + 1


def _lists(values: list[np.ndarray]) -> pa.Array:
    edge = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)))


def token_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, key, need, counted, more): the counted tokens of each set, and as many others as its prefix needs if those are too few."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column("text")):
                sets = list(tx.shingle_sets(data, offsets, width))
                need = [prefix_size(len(s), percent) for s in sets]
                chosen = [s % np.uint64(COUNTED) == 0 for s in sets]
                counted = [s[m] for s, m in zip(sets, chosen, strict=True)]
                more = [s[~m][: max(0, n - len(c))] for s, m, n, c in zip(sets, chosen, need, counted, strict=True)]
                keys = [_key(s) if len(s) else None for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(need, pa.int32()), _lists(counted), _lists(more)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], ["doc_id", "n_shingles", "key", "need", "counted", "more"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, n_shingles long, key binary, need int, counted array<long>, more array<long>")


def _prefixes(classes: DataFrame) -> DataFrame:
    """(cid, weight, token): the prefix of each class, without tokens that are known to be its own alone."""
    posted = classes.select("cid", (F.size("counted") - F.col("need")).alias("spare"), F.explode("counted").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1")  # both sides grow with the corpus, so they are merged
    own = Window.partitionBy("cid")
    met = posted.hint("merge").join(shared, "token").withColumns({"n": F.count("*").over(own), "weight": F.sum("freq").over(own), "place": F.row_number().over(own.orderBy("freq", "token"))})
    # tokens of its own come first in the order, so they take places too
    return met.where("place <= n - spare").select("cid", "weight", "token").unionByName(classes.select("cid", F.lit(0).cast("long").alias("weight"), F.explode("more").alias("token")))


def _groups(classes: DataFrame) -> DataFrame:
    """(cid, token, leader): the prefix tokens that several classes share, and the group of each class that has one."""
    prefixes = written(_prefixes(classes), "prefixes")
    lead = F.max(F.struct("weight", (-F.col("cid")).alias("order")))
    lists = prefixes.groupBy("token").agg(F.count("*").alias("freq"), lead.alias("lead")).where("freq > 1").select("token", "lead")
    met = written(prefixes.drop("weight").hint("merge").join(lists, "token"), "met")
    home = met.groupBy("cid").agg(F.max("lead").alias("best")).select("cid", (-F.col("best.order")).alias("leader"))
    return met.drop("lead").hint("merge").join(home, "cid")


def _blocks(n: str, shingles: str, block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / block), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _dealt_by(blocks: str, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(blocks)).cast("int")


# -- in a task ----------------------------------------------------------------------------------------


class Sets:
    """Sets of codes in flat arrays."""

    def __init__(self, code: np.ndarray, size: np.ndarray):
        self.code, self.size = code, size
        self.row = np.repeat(np.arange(len(size)), size)

    def take(self, which: np.ndarray) -> Sets:
        edge = np.cumsum(self.size) - self.size
        n = self.size[which]
        at = np.repeat(edge[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Sets(self.code[at], n)


def intersections(x: Sets, y: Sets, codes: int) -> np.ndarray:
    """How many codes (below ``codes``) each set of ``x`` has in common with each of ``y``."""
    fx, fy = np.bincount(x.code, minlength=codes), np.bincount(y.code, minlength=codes)
    small = (len(x.size) + len(y.size)) * codes <= 1 << 20
    common = (fx > 0) & (fy > 0) if small else 128 * fx * fy >= len(x.size) * len(y.size) + 8 * (len(x.size) + len(y.size))
    common &= (fx > 0) & (fy > 0)
    out = np.zeros((len(x.size), len(y.size)), np.int64)
    names = np.flatnonzero(common)
    place = np.full(codes, -1)
    for a in range(0, len(names), _TOKENS):
        part = names[a : a + _TOKENS]
        place[part] = np.arange(len(part))
        sides = []
        for s in (x, y):
            at = place[s.code]
            dense = np.zeros((len(s.size), len(part)), np.float32)  # sums of ones stay exact
            dense[s.row[at >= 0], at[at >= 0]] = 1
            sides.append(dense)
        out += (sides[0] @ sides[1].T).astype(np.int64)
        place[part] = -1
    rare = ~common & (fx > 0) & (fy > 0)
    if rare.any():
        kept = rare[y.code]
        order = np.argsort(y.code[kept], kind="stable")
        rows, first = y.row[kept][order], np.cumsum(np.where(rare, fy, 0)) - np.where(rare, fy, 0)
        kept = rare[x.code]
        code, row = x.code[kept], x.row[kept]
        n = fy[code]
        total = np.cumsum(n)
        a = 0
        while a < len(code):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _PAIRS, "right")))
            m = n[a:b]
            at = np.repeat(first[code[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            out += np.bincount(np.repeat(row[a:b], m) * len(y.size) + rows[at], minlength=out.size).reshape(out.shape)
            a = b
    return out


def block_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A forest of links in a block, as pairs of rows, and the tree of each row.

    Rows of side 0 ask, those of side 1 answer, those of side 2 do both.
    """
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    rows, codes = Sets(code, size), int(code.max()) + 1
    members, asking = np.flatnonzero(side != 0), np.flatnonzero(side != 1)
    label, links = np.arange(len(sets)), []
    if not len(members) or not len(asking):
        return links, label
    answer = rows.take(members)
    union = np.zeros(codes, np.int64)
    union[answer.code] = 1
    overlap = np.add.reduceat(union[code], np.cumsum(size) - size)
    asking = asking[100 * overlap[asking] >= percent * size[asking]]
    for a in range(0, len(asking), _ROWS):
        some = asking[a : a + _ROWS]
        both = intersections(rows.take(some), answer, codes)
        linked = 100 * both >= percent * (size[some][:, None] + answer.size - both)
        for x, hit in zip(some.tolist(), linked, strict=True):
            found = members[hit]
            apart, first = np.unique(label[found], return_index=True)
            new = apart != label[x]
            if new.any():
                links += [(x, y) for y in found[first[new]].tolist()]
                label[np.isin(label, apart[new])] = label[x]
    return links, label


def _opened(rows: DataFrame, docs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """(a, b, leader): nodes of forests of links; leader where the link is in the tree of the group's leader.

    ``rows`` are documents in cells: the members of a block and those that ask them. Cells of one row are left out.
    """
    # a cell has no more rows than two blocks and a leader
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("leader", "i", "j"))).where("n > 1")
    rows = written(rows.select(*_ROW), f"cells-{name}")
    texts = packed_texts(docs, rows.select("node"), width)
    sides = rows.hint("merge").join(texts, ["node", "key"]).select(*_ROW, "packed")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for table, edge in _whole_cells(batches):
            side, node, cid, leader = (table.column(c).to_numpy() for c in ("side", "node", "cid", "leader"))
            packed, found = table.column("packed"), []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                # in order by cid and side; the head, if any, stands first and is then seen again where it is a member
                once = np.flatnonzero(np.concatenate([[True], (cid[a + 1 : b] != cid[a : b - 1]) | (side[a + 1 : b] != side[a : b - 1])])) + a
                if len(once) < 2:
                    continue
                raws = [unpack(packed[i].as_py()) for i in once.tolist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in raws])])
                sets = list(tx.shingle_sets(np.frombuffer(b"".join(raws), np.uint8), offsets, width))
                links, label = block_links(sets, side[once], percent)
                led = cid[a] == leader[a]
                found += [(node[once[x]], node[once[y]], leader[a] if led and label[x] == label[0] else None) for x, y in links]
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "leader"])

    return written(_dealt(sides).mapInArrow(search, "a long, b long, leader long"), f"links-{name}")


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, n_shingles, component_id), one row for each row of ``docs``.

    Words are what stands between spaces and the controls from tab to carriage return, with A-Z lowered.
    A text's set holds its distinct ``width``-word shingles (fewer words: the whole sequence as one). Two
    documents are linked when 100 * |intersection| >= ``percent`` * |union|; no link is missed, and component_id is the smallest
    doc_id reachable through links.

    Null, empty and blank texts have an empty set and no link. Repeated texts are linked, repeated doc_ids count as
    one document (with the union of their links). A null doc_id has no component. Texts may be of any length. Further
    columns of ``docs`` are not read, so their names may be anything. An empty table gives no rows.
    """
    sets = written(token_sets(docs, width, percent), "token-sets")
    linked = sets.where("doc_id is not null and key is not null")
    classes = linked.groupBy("key").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n_shingles", "need", "counted", "more")])
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    named = classes.select("cid", "node", "key", "n_shingles")

    tokens = written(_groups(classes), "groups")
    members = tokens.select("cid", "leader").distinct().hint("merge").join(named, "cid")
    sizes = members.groupBy("leader").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).select("leader", _blocks("n", "s", block).alias("blocks"))
    sizes = written(sizes, "group-sizes")
    members = written(members.hint("merge").join(sizes, "leader").withColumn("i", _dealt_by("blocks")), "members")
    large = sizes.where("blocks > 1")

    # the matrix, for tokens that more than one group holds; of two groups the later one asks
    several = tokens.groupBy("token").agg(F.min("leader").alias("low"), F.max("leader").alias("high")).where("low < high").select("token")
    held = written(tokens.hint("merge").join(several, "token").join(members.select("cid", "i").hint("merge"), "cid"), "matrix")
    matrix = held.select("token", "leader", "i").distinct()
    asked = held.select("token", "cid", F.col("leader").alias("home")).hint("merge").join(matrix, "token").where("leader < home").select("leader", "i", "cid").distinct()
    asked = written(asked.hint("merge").join(named, "cid"), "asked")
    turns = asked.groupBy("leader", "i").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).select("leader", "i", _blocks("n", "s", block).alias("turns"))

    asking = asked.hint("merge").join(turns, ["leader", "i"]).withColumn("j", _dealt_by("turns", 1)).withColumn("side", F.lit(0))
    answering = members.hint("merge").join(turns, ["leader", "i"], "left").withColumn("j", F.explode(F.sequence(F.lit(0), F.coalesce("turns", F.lit(1)) - 1)))
    answering = answering.withColumn("side", F.when(F.col("j") == 0, 2).otherwise(1))
    heads = large.hint("merge").join(named, F.col("leader") == F.col("cid")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    heads = heads.withColumns({"j": F.lit(0), "side": F.lit(2)})
    cells = asking.withColumn("head", F.lit(False)).select(*_ROW).union(answering.withColumn("head", F.lit(False)).select(*_ROW)).union(heads.withColumn("head", F.lit(True)).select(*_ROW))
    links = _opened(cells, docs, width, percent, "first")

    if not large.isEmpty():  # what isn't linked to its leader meets the group's other blocks
        led = links.where("leader is not null").select("leader", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("led", F.lit(True))
        some = members.where("blocks > 1").hint("merge").join(led, ["leader", "node"], "left").withColumn("rest", F.col("led").isNull() & (F.col("cid") != F.col("leader")))
        some = written(some.drop("led"), "still-apart")
        few = some.where("rest").groupBy("leader").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).select("leader", _blocks("n", "s", block).alias("few"))
        some = some.hint("merge").join(few, "leader")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asking = some.where("rest").withColumn("j", _dealt_by("few", 1)).withColumn("i", every("blocks")).withColumn("side", F.lit(0))
        answering = some.withColumn("j", every("few")).withColumn("side", F.lit(1))
        second = asking.select(*[c for c in _ROW if c != "head"]).unionByName(answering.select(*[c for c in _ROW if c != "head"])).withColumn("head", F.lit(False))
        links = links.union(_opened(second, docs, width, percent, "second"))

    # doc_ids that stand in several classes link them
    stands = linked.select("doc_id", "key").hint("merge").join(classes.select("key", "node"), "key").select("doc_id", "node").distinct()
    again = stands.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    same_id = stands.join(again, "doc_id").where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b"))
    found = components(links.select("a", "b").unionByName(same_id)).withColumnRenamed("component", "root")
    of = classes.select("key", "node").hint("merge").join(found, "node", "left").select("key", F.coalesce("root", "node").alias("component_id"))
    full = linked.select("doc_id", "n_shingles", "key").hint("merge").join(of, "key").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(sets.where("doc_id is null or key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
