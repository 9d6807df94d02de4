"""Near-duplicate detection by bottom-k sketches of one hash function.

1. Each text becomes its set of five-word shingles, hashed by one function, and
   equal sets are one class. A class's SCREEN least hashes are looked up in
   inverted lists: only classes of which enough are retained by another class
   too can have a partner, and only those go on.
2. For these, longer sketches (SKETCH) go to inverted lists, rarest values
   first. A pair at the threshold shares one of each sketch's first values in
   that order, so what many documents share makes no long lists.
3. Every list names its most central class; a class belongs to the block of the
   most central one it meets, large blocks are cut. A block's task holds its
   sets: it links classes to the centre, then pairs that are still apart.
   Components follow. Lists that join several components in several blocks name
   pairs of blocks, whose tasks do the same for the classes that meet there.
   Inside a task, pairs come from prefixes of the full sets, are filtered by the
   union sketch's estimate and verified on full sets. Pairs are never rows of a
   table: only links are, so a family of copies is sent once for each pair of
   its blocks.

A pair of Jaccard similarity 0.85 is lost with a chance of at most 1.2e-9 in 1,
4.4e-9 in 2 and 4.4e-9 in the estimate of 3 (binomial tails, for sets one of
which holds the other; less for others), and 1e-11 in all at 0.9.

Defined results: words are runs without ASCII white space, A-Z lower-cased; a
text of one to four words is one shingle; without words n_shingles is 0 and the
document is its own component. Each row is judged by its own text, also where
rows share a doc_id; component_id is the least doc_id of all rows in the
component, null ids left out, and null only where all are. Extra columns are
ignored. ``one_of_each`` takes every row as a document of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.columns import as_text, hashed, mixed, slices, windows, words
from colonnade.llm.sparkio import drop_stored, stored

WORDS = 5
#: (k, shared): a pair at the threshold shares at least ``shared`` of its ``k`` least hashes
SCREEN, SKETCH = (24, 8), (128, 83)
FILTER_BITS, KEY_BITS = 1 << 28, (1 << 40) - 1
#: members and bytes of sets in a block
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: rows of one long that may be broadcast
FEW = 4_000_000
SIGN = np.uint64(1 << 63)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    codes, names, bounds = words(pc.ascii_lower(texts))
    h = hashed(names)[codes] if len(names) else np.zeros(0, np.uint64)
    wins, at = windows(h, bounds, n)
    out = []
    for k in range(len(texts)):
        a, b = at[k], at[k + 1]
        if a < b:
            out.append(np.unique(wins[a:b]))
        elif bounds[k] < bounds[k + 1]:
            x = np.array([bounds[k + 1] - bounds[k]], np.uint64)
            for y in h[bounds[k] : bounds[k + 1]]:
                x = mixed(x * np.uint64(3) + y)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def as_longs(sets: list[np.ndarray]) -> pa.Array:
    """Sets as lists of signed longs in an order of bits that keeps them sorted."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array((flat ^ SIGN).view(np.int64)))


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def class_key(fp: bytes) -> int:
    return int.from_bytes(fp[:8], "little", signed=True)


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id (of any type), n_shingles, fp (of the whole set) and class (its first bytes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            sets = shingle_sets(as_text(batch.column("text")), n)
            fp = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(map(class_key, fp), pa.int64())], ["doc_id", "n_shingles", "fp", "class"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, fp binary, class long")


def needed(size: int | np.ndarray, percent: int, shared: int) -> int | np.ndarray:
    """How many of its ``size`` retained values a class shares with a partner at the threshold."""
    return np.minimum(shared, -(-percent * size // 100))


def retained(docs: DataFrame, n: int, percent: int, k: int, shared: int) -> DataFrame:
    """value, class: the k least hashes of each class, once for each task that meets it.

    class is 40 bits of the class's key, then 8 of how many of its values it has
    to share: what is shuffled stays short. Classes that are taken for one only
    let each other pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 4 << 20):
            found = {}
            for s in shingle_sets(as_text(batch.column("text")), n):
                if len(s):
                    of = (class_key(fingerprint(s)) & KEY_BITS) << 8 | int(needed(min(k, len(s)), percent, shared))
                    if of not in seen:
                        seen.add(of)
                        found[of] = s[:k]
            if found:
                flat = (np.concatenate(list(found.values())) ^ SIGN).view(np.int64)
                of = np.repeat(np.array(list(found), np.int64), [len(s) for s in found.values()])
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(of)], ["value", "class"])

    return docs.select("text").mapInArrow(run, "value long, class long")


def screened(docs: DataFrame, n: int, percent: int, k: int, shared: int) -> DataFrame:
    """class (40 bits of its key): those that share enough of their retained values with any other class."""
    lists = retained(docs, n, percent, k, shared)
    several = lists.groupBy("value").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("value")
    # a class that several tasks met is counted once for each value
    met = lists.join(several, "value", "left_semi").groupBy("class").agg(F.count_distinct("value").alias("met"))
    return met.where("met >= (class & 255)").select(F.expr("shiftright(class, 8)").alias("class"))


def membership(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits in which each key's low bits are set: bounded, whatever the number of keys."""
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    cut = keys.select(F.expr(f"shiftright({column} & {bits - 1}L, 15)").alias("part"), at.bitwiseAND(F.lit(32767)).alias("bit"))
    got = cut.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    out = np.zeros((max(1, bits >> 15), 4096), np.uint8)
    for r in got:
        out[r["part"]] = np.frombuffer(bytes(r["map"]), np.uint8)
    return out.reshape(-1)


def class_sets(docs: DataFrame, rows: DataFrame, n: int, bits: int) -> DataFrame:
    """v (a number of its own), fp and set of each of the given rows (fp, class, least: its doc_id); some others may slip in.

    A row is known by its class and id, whose bits in a bounded map are looked up
    as the texts are read, so that no text is shuffled. Rows that share both, and
    those that slip in, are vertices of their own with equal or unneeded sets.
    """
    at = F.col("class").bitwiseXOR(F.xxhash64("least"))
    spread = docs.sparkSession.sparkContext.broadcast(membership(rows.select(at.alias("key")), "key", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held = spread.value
        for batch in slices(batches, 4 << 20):
            found = {}
            for at, s in zip(batch.column("at").to_pylist(), shingle_sets(as_text(batch.column("text")), n)):
                fp = fingerprint(s)
                key = (class_key(fp) ^ at) & (bits - 1)
                if len(s) and held[key >> 3] >> (key & 7) & 1 and fp not in seen:
                    seen.add(fp)
                    found[fp] = s
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), as_longs(list(found.values()))], ["fp", "set"])

    sets = docs.select(F.xxhash64("doc_id").alias("at"), "text").mapInArrow(run, "fp binary, set array<long>")
    return stored(sets.select(F.monotonically_increasing_id().alias("v"), "fp", "set"), "sets")


def prefixes(sets: DataFrame, percent: int, k: int, shared: int) -> DataFrame:
    """value, v, score: the values of each sketch that go to inverted lists, rarest first; those of one class alone are left out."""
    flat = sets.select("v", F.least(F.size("set"), F.lit(k)).alias("size"), F.explode(F.slice("set", 1, k)).alias("value"))
    often = flat.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    of = flat.join(often, "value").groupBy("v", "size").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("common"))
    need = F.least(F.lit(shared), F.ceil(F.col("size") * percent / 100))
    # the values that are not common come first in the order and make no lists
    use = F.size("common") - need + 1
    score = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x["often"]) / F.col("size")
    of = of.where(use > 0).select("v", F.slice("common", 1, use.cast("int")).alias("use"), score.cast("long").alias("score"))
    return of.select(F.explode("use.value").alias("value"), "v", "score")


def union_estimates(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of each union's k least values both sketches hold, and how many there are (k, or the whole union).

    Rows are sketches in ascending order, those of less than k values filled up with the greatest long.
    """
    top = np.iinfo(np.int64).max
    both = np.sort(np.concatenate([x, y], 1), 1)
    real = both < top
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    seen = np.cumsum(real & ~same, 1, dtype=np.int32)
    size = np.minimum(seen[:, -1], k)
    return np.count_nonzero(same & (seen <= size[:, None]), 1), size


class Members:
    """The sets of one task: finds the near pairs among them."""

    def __init__(self, sets: list[np.ndarray], percent: int, k: int, shared: int):
        self.percent, self.k, self.shared = percent, k, shared
        self.n = np.array([len(s) for s in sets], np.int64)
        self.sketch = np.full((len(sets), k), np.iinfo(np.int64).max)
        for r, s in enumerate(sets):
            self.sketch[r, : min(k, len(s))] = s[:k]
        flat = np.concatenate(sets)
        names, codes, often = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), self.n)
        common = often[codes] > 1
        self.row, self.code, self.often = row[common], codes[common], often[codes[common]]
        self.at = np.searchsorted(self.row, np.arange(len(sets) + 1))
        self.mark = np.zeros(len(names), bool)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (a, b) have percent * union <= 100 * intersection: by size, the union sketch's estimate, and the full sets."""
        out = np.zeros(len(a), bool)
        x, y = self.n[a], self.n[b]
        todo = np.flatnonzero(100 * np.minimum(x, y) >= self.percent * np.maximum(x, y))
        kept = []
        for cut in np.array_split(todo, max(1, -(-len(todo) // 4096))):
            same, size = union_estimates(self.sketch[a[cut]], self.sketch[b[cut]], self.k)
            kept.append(cut[same >= needed(size.astype(np.int64), self.percent, np.where(size < self.k, self.k, self.shared))])
        todo = np.concatenate(kept) if kept else todo
        todo = todo[np.argsort(a[todo], kind="stable")]
        heads = np.flatnonzero(np.diff(a[todo], prepend=-1))
        for lo, hi in zip(heads, [*heads[1:], len(todo)]):
            one = a[todo[lo]]
            mine = self.code[self.at[one] : self.at[one + 1]]
            self.mark[mine] = True
            for p in todo[lo:hi]:
                other = b[p]
                same = np.count_nonzero(self.mark[self.code[self.at[other] : self.at[other + 1]]])
                out[p] = 100 * same >= self.percent * (self.n[one] + self.n[other] - same)
            self.mark[mine] = False
        return out

    def candidates(self, apart: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different labels (and sides) that share a value of their full sets' prefixes."""
        order = np.lexsort((self.code, self.often, self.row))
        rank = np.arange(len(order)) - np.repeat(self.at[:-1], np.diff(self.at))
        need = -(-self.percent * self.n // 100)
        use = order[rank < (np.diff(self.at) - need + 1)[self.row]]
        use = use[np.argsort(self.code[use], kind="stable")]
        code, row = self.code[use], self.row[use]
        todo = np.zeros((len(self.n), len(self.n)), bool)
        heads = np.flatnonzero(np.diff(code, prepend=-1))
        for lo, hi in zip(heads, [*heads[1:], len(code)]):
            if hi - lo > 1:
                todo[np.ix_(row[lo:hi], row[lo:hi])] = True
        todo &= apart[:, None] != apart[None, :]
        if side is not None:
            todo &= side[:, None] != side[None, :]
        return np.nonzero(np.triu(todo, 1))


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each a row's number) after joining the pairs (a, b)."""
    up = labels.copy()

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return np.array([root(x) for x in range(len(up))], np.int64)


def _members(table: pa.Table, percent: int, sketch: tuple[int, int]) -> tuple[np.ndarray, Members]:
    return table["v"].to_numpy(), Members([x.values.to_numpy() for x in table["set"]], percent, *sketch)


def _links(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(np.minimum(v[a], v[b]), pa.int64()), "b": pa.array(np.maximum(v[a], v[b]), pa.int64())})


def blocks(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """v, centre, block: each class under the most central class of its lists, in blocks of bounded size."""
    best = lists.groupBy("value").agg(F.max(F.struct("score", (-F.col("v")).alias("c"))).alias("best"), F.count(F.lit(1)).alias("m")).where("m > 1")
    of = lists.join(best, "value").groupBy("v").agg((-F.max("best")["c"]).alias("centre"))
    of = stored(of.join(sets.select("v", F.size("set").alias("n")), "v"), "centres")
    cuts = of.groupBy("centre").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).alias("cuts"))
    return stored(of.join(cuts, "centre").select("v", "centre", F.xxhash64("centre", F.pmod(F.xxhash64("v"), F.col("cuts"))).alias("block")), "blocks")


def links_inside(placed: DataFrame, sets: DataFrame, percent: int, sketch: tuple[int, int]) -> DataFrame:
    """a, b: enough links inside each block, and to its centre, to join what belongs together there."""

    def run(table: pa.Table) -> pa.Table:
        v, held = _members(table, percent, sketch)
        guest = int(np.flatnonzero(table["guest"].to_numpy())[0])
        others = np.flatnonzero(v != v[guest])
        near = others[held.near(np.full(len(others), guest), others)]
        star = np.full(len(near), guest)
        labels = joined(np.unique(v, return_index=True)[1][np.unique(v, return_inverse=True)[1]], star, near)
        a, b = held.candidates(labels, None)
        more = held.near(a, b)
        return _links(v, np.concatenate([star, a[more]]), np.concatenate([near, b[more]]))

    guests = placed.select(F.col("centre").alias("v"), "block", F.lit(True).alias("guest")).distinct()
    both = placed.select("v", "block", F.lit(False).alias("guest")).union(guests).join(sets.select("v", "set"), "v")
    return both.groupBy("block").applyInArrow(run, "a long, b long")


def links_between(lists: DataFrame, placed: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, sketch: tuple[int, int]) -> DataFrame:
    """a, b: the links between blocks of classes that meet in a list and have different labels."""
    of = placed.select("v", "block").join(labels.select("v", "label"), "v", "left").select("v", "block", F.coalesce("label", "v").alias("label"))
    known = lists.select("value", "v").join(of, "v")
    several = known.groupBy("value").agg(F.min("block").alias("p"), F.max("block").alias("q"), F.min("label").alias("x"), F.max("label").alias("y")).where("p <> q AND x <> y").select("value")
    known = stored(known.join(several, "value", "left_semi"), "open-lists")
    at = known.groupBy("value", "block").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    p, q = at.select("value", F.col("block").alias("p"), F.col("x").alias("px"), F.col("y").alias("py")), at.select("value", F.col("block").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    # one row for each list and pair of its blocks, which hold up to BLOCK classes each
    pairs = p.join(q, "value").where("p < q AND NOT (px = py AND qx = qy AND px = qx)").select("value", "p", "q")
    sides = pairs.select("value", "p", "q", F.col("p").alias("block")).union(pairs.select("value", "p", "q", F.col("q").alias("block")))
    needs = stored(sides.join(known, ["value", "block"]).select("p", "q", "v", "block", "label").distinct(), "meetings")

    def run(table: pa.Table) -> pa.Table:
        v, held = _members(table, percent, sketch)
        a, b = held.candidates(table["label"].to_numpy(), table["block"].to_numpy())
        near = held.near(a, b)
        return _links(v, a[near], b[near])

    return needs.join(sets.select("v", "set"), "v").groupBy("p", "q").applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """v, label: the least vertex that each vertex of the links (a, b) reaches.

    Each round takes the least label of all neighbours, then the label of that
    label; rounds are written to the shared folder, and only the number of
    changes comes to the driver.
    """
    both = stored(links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stored(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("v").alias("mid"), F.col("label").alias("far"))
        step = stored(step.join(jump, "mid", "left").select("v", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        drop_stored(labels)
        labels = step.select("v", "label")
        if step.where("old <> label").isEmpty():
            drop_stored(both)
            return labels


def near_duplicates(docs: DataFrame, percent: int = 85, n: int = WORDS, screen: tuple[int, int] = SCREEN, sketch: tuple[int, int] = SKETCH, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    return judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent, n, screen, sketch, bits)[0]


def judged(docs: DataFrame, percent: int = 85, n: int = WORDS, screen: tuple[int, int] = SCREEN, sketch: tuple[int, int] = SKETCH, bits: int = FILTER_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """near_duplicates of docs (doc_id, of any type that has an order, and text), and the stored tables that it reads."""
    base = stored(fingerprints(docs, n), "fingerprints")
    first = base.where("n_shingles > 0").groupBy("fp", "class").agg(F.min("doc_id").alias("least"))
    among = screened(docs, n, percent, *screen).withColumnRenamed("class", "key")
    sets = class_sets(docs, first.withColumn("key", F.expr(f"class & {KEY_BITS}L")).join(among, "key", "left_semi"), n, bits)
    lists = stored(prefixes(sets, percent, *sketch), "lists")
    placed = blocks(lists, sets)
    inside = stored(links_inside(placed, sets, percent, sketch), "links")
    labels = components(inside)
    between = stored(links_between(lists, placed, labels, sets, percent, sketch), "links")
    drop_stored(labels)
    labels = components(inside.union(between))
    # a class without links is left out here, and its own component; vertices of one class are linked to each other
    label = stored(sets.select("v", "fp").join(labels, "v").groupBy("fp").agg(F.min("label").alias("label")), "classes")
    for table in (sets, lists, placed, inside, between, labels):
        drop_stored(table)
    whole = label.join(first, "fp").groupBy("label").agg(F.min("least").alias("linked"))
    of = first.join(label, "fp", "left").join(whole, "label", "left").select("fp", F.coalesce("linked", "least").alias("component_id"))
    out = base.join(of, "fp", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), [base, label]


def file_rows(docs: DataFrame) -> DataFrame | None:
    """docs with __row, each row's place in its file (a hash of the path, and the number there), where docs is a plain reading of files."""
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    if not node.nodeName().startswith(("LogicalRelation", "Relation")) or "_metadata" in docs.columns:
        return None
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.withColumn("__row", place)
    except AnalysisException:  # files of a kind whose rows have no numbers
        return None


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """One row of each component of rows, with all its columns: the least doc_id's, null after all others.

    Rows are told apart by their places in their files, so null and repeated ids
    neither lose a row nor keep a second one. Rows that come from anywhere else
    are numbered and written to the shared folder first, as a later reading might
    number them otherwise. The rows that go are broadcast if they are at most
    FEW, and joined by a shuffle beyond.
    """
    rows = file_rows(docs)
    if rows is None:
        rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    got, read = judged(rows.select(F.col("__row").alias("doc_id"), "text"), **options)
    ids = rows.select("__row", F.col("doc_id").alias("__id"))
    of = got.select(F.col("doc_id").alias("__row"), "component_id").join(ids, "__row")
    first = of.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row"))["__row"].alias("__first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    gone = stored(of.join(first, "component_id").where("__row <> __first").select("__row"), "gone")
    for table in read:
        drop_stored(table)
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    return rows.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
