"""Near-duplicate groups by circulant MinHash, banding, and exact Jaccard verification.

The first permutation orders the 64-bit shingle hashes on a ring of 2**32 places; the second is a
bijection of the ring, and signature coordinate k is the least image after a shift by k. Documents
with equal shingle sets are one class. Classes that share a band are tied to the least and the
greatest class of that band (a star, so a band of m classes makes 2m candidates, not m*m). Links are
confirmed on full sets. Where a band still holds several components, its classes are compared by
their sketches: the members of its largest component stay in their block, only the rest visit all
blocks, and a group is a block with a part of its visitors. Those that could reach the threshold with one of another component are compared on full
sets, within their blocks as well: no bucket is capped, no candidate is dropped, and only links
leave these comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.common import binary_array, few, hot_join, mix64, release, saved, shingle_rows
from lyceum.llm.components import components

#: Bands of ROWS coordinates: a pair at the threshold of 0.75 shares no band with a probability of 5e-6.
BANDS, ROWS = 32, 4
#: Least number of the 128 sketch bytes that agree; a pair at 0.75 has fewer with a probability of 5e-7.
SKETCH_AGREE = 72
#: Least similarity, in percent.
PERCENT = 75
#: Rows of one block of a bucket in the comparison of sketches.
BLOCK = 512
#: Rows of one key from which they are looked up in a broadcast table instead of being shuffled.
HOT = 512
#: Shingles that one run of a group's rows holds in the comparison of full sets.
RUN = 1_000_000

_COORDS = BANDS * ROWS
_SHIFT = np.arange(_COORDS, dtype=np.uint32)[:, None]
_BANDMIX = mix64(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BANDNO = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_CELLS = 1 << 16


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a set of 64-bit shingle hashes."""
    ring = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty(_COORDS, np.uint32)
    step = max(1, _CELLS // len(ring))
    for k in range(0, _COORDS, step):
        y = ring[None, :] - _SHIFT[k : k + step]
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x7FEB352D)
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x846CA68B)
        y.min(axis=1, out=out[k : k + step])
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return mix64((rows * _BANDMIX).sum(axis=1, dtype=np.uint64) ^ _BANDNO)


def sketch_of(sig: np.ndarray) -> bytes:
    """The low byte of each mixed coordinate."""
    y = sig ^ (sig >> np.uint32(15))
    y = y * np.uint32(0x2C1B3C6D)
    return (y >> np.uint32(24)).astype(np.uint8).tobytes()


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, h1, h2, bands, sketches = [], [], [], [], []
        for s in shingle_rows(batch.column("text")):
            n.append(len(s))
            h1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            h2.append(int(np.bitwise_xor.reduce(mix64(s + np.uint64(77))).view(np.int64)) if len(s) else 0)
            if len(s):
                sig = signature(s)
                bands.append(bands_of(sig).view(np.int64).tolist())
                sketches.append(sketch_of(sig))
            else:
                bands.append(None)
                sketches.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), binary_array(sketches)],
            ["doc_id", "mark", "n", "h1", "h2", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_rows(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), binary_array(sets)], ["node", "set"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
            u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(u) + len(v) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        u = np.frombuffer(b"".join(batch.column("left").to_pylist()), np.uint8).reshape(-1, _COORDS)
        v = np.frombuffer(b"".join(batch.column("right").to_pylist()), np.uint8).reshape(-1, _COORDS)
        keep = (u == v).sum(axis=1) >= SKETCH_AGREE
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (bkey, i, j) of sorted rows; a group that a batch cuts is finished with the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        keys = [t.column(c).to_numpy() for c in ("bkey", "i", "j")]
        other = np.flatnonzero((keys[0] != keys[0][-1]) | (keys[1] != keys[1][-1]) | (keys[2] != keys[2][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _numbered(t: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The number of each row's group, and the columns that pairs are chosen by."""
    cols = {c: t.column(c).to_numpy() for c in ("bkey", "i", "j", "side", "n", "node", "comp")}
    change = np.zeros(t.num_rows, np.int64)
    change[1:] = (np.diff(cols["bkey"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)
    return np.cumsum(change), cols


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that have, in one of their groups, a row of another component and of compatible size whose sketch agrees."""
    for t in _groups(batches):
        group, c = _numbered(t)
        sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, _COORDS)
        found, alive, d = np.zeros(len(group), bool), np.arange(len(group)), 1
        while True:
            alive = alive[alive + d < len(group)]
            ok = (group[alive] == group[alive + d]) & (100 * c["n"][alive] >= PERCENT * c["n"][alive + d])
            alive = alive[ok]
            if not len(alive):
                break
            x = alive[_foreign(c, alive, alive + d)]
            x = x[~(found[x] & found[x + d])]
            for k in range(0, len(x), 4096):
                i = x[k : k + 4096]
                hit = i[(sketches[i] == sketches[i + d]).sum(axis=1) >= SKETCH_AGREE]
                found[hit] = found[hit + d] = True
            d += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(c["node"][found]), pa.int64())], ["node"])


def _foreign(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows lie in different components and one of them is a visitor; members of a block meet each other in its first group only."""
    return (c["comp"][x] != c["comp"][y]) & ((c["side"][x] != c["side"][y]) | ((c["side"][x] == 0) & (c["j"][x] == 0)))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one group and of different components that reach the threshold on full sets.

    Shared shingles are counted through postings within runs of rows of similar size, so the work
    follows the shared shingles and only links leave the task.
    """
    for t in _groups(batches):
        group, c = _numbered(t)
        sets = t.column("set")
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1))
        for lo, hi in zip(edges, edges[1:], strict=False):
            run = np.cumsum(c["n"][lo:hi]) // RUN
            starts = [*np.flatnonzero(np.diff(run, prepend=-1)).tolist(), hi - lo]
            parts = [(lo + a, lo + b) for a, b in zip(starts, starts[1:], strict=False)]
            for p, (a0, a1) in enumerate(parts):
                for b0, b1 in parts[p:]:
                    if 100 * c["n"][a1 - 1] >= PERCENT * c["n"][b0]:
                        x, y = _links_between(sets, c, (a0, a1), (b0, b1))
                        if len(x):
                            u, v = c["node"][x], c["node"][y]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])


def _links_between(sets: pa.ChunkedArray, c: dict[str, np.ndarray], left: tuple[int, int], right: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    def flat(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets.slice(lo, hi - lo)]
        return np.concatenate(rows), np.repeat(np.arange(lo, hi), [len(r) for r in rows])

    value, owner = flat(*right)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order] - right[0]
    xs, ys = [], []
    here = np.arange(*right)
    for k in range(*left):
        own = np.frombuffer(sets[k].as_buffer(), np.uint64)
        a, b = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
        a, count = a[b > a], (b - a)[b > a]
        if not len(a):
            continue
        at = np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(here))
        hit = (100 * both >= PERCENT * (len(own) + c["n"][here] - both)) & (here > k) & _foreign(c, np.full(len(here), k), here)
        xs.append(np.full(hit.sum(), k))
        ys.append(here[hit])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (here[:0], here[:0])


class _Corpus:
    """The class table of a corpus and what the steps look up in it.

    A class is named by its least doc_id and known by a node: that id, or a hash of its set where
    rows of one id have different texts and several classes would share it.
    """

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
        self.rows = saved(self.docs.mapInArrow(_prepare, "doc_id long, mark long, n long, h1 long, h2 long, bands array<long>, sketch binary"))
        full = self.rows.where("n > 0 and doc_id is not null").groupBy("h1", "h2")
        full = full.agg(F.min(F.struct("doc_id", "mark", "n", "bands", "sketch")).alias("r"), F.count("*").alias("copies"))
        classes = saved(full.select("h1", "h2", F.col("r.doc_id").alias("name"), "r.mark", "r.n", "r.bands", "r.sketch", "copies"))
        shared, small = few(classes.groupBy("name").count().where("count > 1").select(F.col("name").alias("_name")))
        self.repeated = not shared.isEmpty()
        if self.repeated:
            shared = F.broadcast(shared) if small else shared
            both = classes.join(shared, F.col("name") == F.col("_name"), "left")
            classes = saved(both.withColumn("node", F.when(F.col("_name").isNull(), F.col("name")).otherwise(F.xxhash64("h1", "h2"))).drop("_name"))
        else:
            classes = classes.withColumn("node", F.col("name"))
        self.classes = classes
        self.sketches = classes.select("node", "sketch")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """(node, set) for the nodes in `ids`; their texts are found without a shuffle while the ids are few enough to broadcast."""
        found = ids.join(self.classes.select("node", "name", "mark"), "node") if self.repeated else ids.select("node", F.col("node").alias("name"))
        found, small = few(found.withColumnRenamed("mark", "_mark"))
        same = self.docs["doc_id"] == F.col("name")
        if self.repeated:
            same = same & (self.docs["mark"] == F.col("_mark"))
        return self.docs.join(F.broadcast(found) if small else found, same).select("node", "text").mapInArrow(_sets, "node long, set binary")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) that reach the threshold on full sets."""
        pairs = saved(pairs)
        sets = saved(self.sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("left")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("right")), "b")
        return both.select("a", "b", "left", "right").mapInArrow(_confirm, "a long, b long").distinct()

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose sketches agree enough."""
        left = pairs.join(self.sketches.select(F.col("node").alias("a"), F.col("sketch").alias("left")), "a")
        both = left.join(self.sketches.select(F.col("node").alias("b"), F.col("sketch").alias("right")), "b")
        return both.select("a", "b", "left", "right").mapInArrow(_agree, "a long, b long")

    def named(self, labels: DataFrame) -> DataFrame:
        """(h1, h2, class_id, copies): the least doc_id that each class reaches; `labels` are (node, component)."""
        both = self.classes.select("h1", "h2", "node", "name", "copies").join(labels, "node", "left")
        if not self.repeated:
            return both.select("h1", "h2", F.coalesce("component", "name").alias("class_id"), "copies")
        both = saved(both)
        least = both.where("component is not null").groupBy("component").agg(F.min("name").alias("class_id"))
        return both.join(least, "component", "left").select("h1", "h2", F.coalesce("class_id", "name").alias("class_id"), "copies")


def _stars(members: DataFrame) -> DataFrame:
    """Members of a band with its least and its greatest class."""
    ends = F.explode(F.array("lo", "hi"))
    pairs = members.select("node", "n", ends.alias("end"))
    fits = (F.least("n", "end.n") * 100 >= F.greatest("n", "end.n") * PERCENT) & (F.col("node") != F.col("end.node"))
    return pairs.where(fits).select(F.least("node", "end.node").alias("a"), F.greatest("node", "end.node").alias("b")).distinct()


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (bkey, node, n, comp) of bands that hold several components, dealt to groups (bkey, i, j).

    Two members of different components can't both be of the largest one, so only the rest of a
    band visits blocks other than its own. Group j of block i holds the block's members (side 0)
    and the part j of the visitors (side 1): about two blocks of rows, whatever the band's size.
    """
    parts = rows.groupBy("bkey", "comp").agg(F.count("*").alias("m"))
    bands = parts.groupBy("bkey").agg(F.sum("m").alias("m"), F.count("*").alias("parts"), F.max(F.struct("m", "comp")).alias("most")).where("parts > 1")
    many = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1)).cast("int")
    bands, small = few(bands.select("bkey", many(F.col("m")).alias("blocks"), many(F.col("m") - F.col("most.m")).alias("shares"), F.col("most.comp").alias("most")))
    rows = rows.join(F.broadcast(bands) if small else bands, "bkey")
    own, share = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("shares")).cast("int")
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    member = F.transform(upto(F.col("shares")), lambda j: place(F.col("own"), j, 0))
    visitor = F.transform(F.filter(upto(F.col("blocks")), lambda i: i != F.col("own")), lambda i: place(i, F.col("share"), 1))
    rows = rows.withColumn("own", own).withColumn("share", share)
    rows = rows.withColumn("at", F.explode(F.when(F.col("comp") == F.col("most"), member).otherwise(F.concat(member, visitor))))
    return rows.select("bkey", "at.i", "at.j", "at.side", "n", "node", "comp")


def _sorted(rows: DataFrame, payload: str) -> DataFrame:
    return rows.select("bkey", "i", "j", "side", "n", "node", "comp", payload).repartition("bkey", "i", "j").sortWithinPartitions("bkey", "i", "j", "n", "node")


def _rest(corpus: _Corpus, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between different components that share a band.

    Sketches first tell the few classes that could have such a link at all; only those are compared
    on full sets, inside their groups, so no table of candidate pairs is made.
    """
    rows = members.select("bkey", "node", "n").join(labels, "node", "left").select("bkey", "node", "n", F.coalesce("component", "node").alias("comp"))
    rows = saved(rows)
    suspects = saved(_sorted(_blocks(rows).join(corpus.sketches, "node"), "sketch").mapInArrow(_suspects, "node long").distinct())
    sets = corpus.sets_of(suspects)
    return _sorted(_blocks(rows.join(suspects, "node")).join(sets, "node"), "set").mapInArrow(_linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Shingles are five words, or the whole sequence where it is shorter; a null or empty text has
    none and is linked with nothing. Rows with equal sets form one class named by its smallest
    doc_id. Rows of one id with different texts are documents of their own that share a name. A row
    without doc_id takes no part in naming; it gets the component of its text's class if an
    identified row has that set, else none, and is kept. Repeated rows share one class. An empty
    table gives no rows; other columns are ignored.
    """
    return _grouped(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame) -> DataFrame:
    """near_duplicates and `mark`, a hash of the text."""
    corpus = _Corpus(docs)
    bands = corpus.classes.select("node", "n", F.explode("bands").alias("bkey"))
    shared = bands.groupBy("bkey").agg(F.count("*").alias("m"), F.min(F.struct("node", "n")).alias("lo"), F.max(F.struct("node", "n")).alias("hi")).where("m > 1")
    members = saved(hot_join(bands, saved(shared), ["bkey"], "inner", F.col("m") > HOT).drop("m"))
    del bands, shared
    release(docs.sparkSession)
    links = saved(corpus.confirmed(corpus.likely(_stars(members))))
    labels = saved(components(links))
    more = saved(_rest(corpus, members, labels))
    release(docs.sparkSession)
    labels = components(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))
    rows = corpus.rows.select("doc_id", "mark", "n", "h1", "h2")
    full = hot_join(rows.where("n > 0"), saved(corpus.named(labels)), ["h1", "h2"], "left", F.col("copies") > HOT).select("doc_id", "mark", "n", "class_id")
    none = rows.where("n = 0").select("doc_id", "mark", "n", F.col("doc_id").alias("class_id"))
    both = full.unionByName(none).withColumn("component_id", F.coalesce("class_id", "doc_id"))
    return both.select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The kept rows of `near_duplicates`, with all columns; rows of one id and text become one, the least by its columns.

    Rows are told apart by id and text. Texts are not shuffled while the ids to drop are few enough
    to broadcast. Columns of any name pass.
    """
    found = saved(_grouped(docs).where("doc_id is not null"))
    names = [f.name for f in docs.schema.fields]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("of"))

    def ids(rows: DataFrame) -> DataFrame:
        rows, small = few(rows.select("doc_id", "mark").distinct())
        return F.broadcast(rows) if small else rows

    same = (F.col("id") == F.col("doc_id")) & (F.col("of") == F.col("mark"))
    kept = packed.join(ids(found.where("not kept")), same, "left_anti")
    repeated = ids(found.where("kept").groupBy("doc_id", "mark").count().where("count > 1"))
    single = kept.join(repeated, same, "left_anti").select("row")
    least = kept.join(repeated, same, "left_semi").groupBy("id", "of").agg(F.min("row").alias("row")).select("row")
    return single.unionByName(least).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
