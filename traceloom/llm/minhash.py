"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word shingles, bands, and exact verification.

A text is the multiset of its shingles of five words. Weights are cut into unit steps; on the steps of a shingle runs
a Poisson process, held as independent processes over the intervals [0,1), [1,2), [2,4), [4,8), ... of the weight.
A point of an interval's process stands on one of its steps, found by halving the interval with one random bit each;
it counts if the step lies below the weight. Each point falls on one signature component, and the earliest point of a
component is its value. Two texts agree in a component with probability sum(min)/sum(max) of their weights. Points are
made in order of time and only up to a horizon by which all components have one, so most shingles cost one draw.

Texts with the same multiset are one content. Contents that agree in all components of a band share a bucket. Each is
first compared with the hub of its bucket, the content that meets most others in all its buckets; copies of one text
have that text, or the least changed of them, as their hub. Contents beside a hub that are not linked to it then meet
all that stand beside it, block by block. Comparing means the exact overlap of both multisets.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import NO_ID, id_or_none, key128, whole_text, words_of
from .graph import components

SHINGLE, THRESHOLD = 5, 0.8
#: 25 bands of 5: two texts at the threshold share a bucket with probability 0.99995.
SIGNATURE, BANDS, ROWS = 128, 25, 5
#: A content that many others are compared with is handed to so many of them at a time.
FAN = 256
#: Contents of a block where a neighbourhood is searched.
BLOCK = 512
SALTS = 16
_GOLDEN, _ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x + _GOLDEN
    x ^= x >> np.uint64(30)
    x *= _ONE
    x ^= x >> np.uint64(27)
    x *= _TWO
    x ^= x >> np.uint64(31)
    return x


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending, and how often each stands in the text.

    A text of fewer words is one shingle of all of them; one without words has none.
    """
    from xxhash import xxh3_64_intdigest
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    own = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        rolled = rolled * _GOLDEN + own[i:i + n]
    return np.unique(mixed(rolled), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIGNATURE) -> np.ndarray:
    """BagMinHash signatures, one row of ``size`` values per bag; those of empty bags are zeros."""
    out = np.zeros((len(bags), size), np.uint64)
    todo = np.array([i for i, (h, _) in enumerate(bags) if len(h)], np.int64)
    slack = 4.0
    while len(todo):
        values, times = _until([bags[i] for i in todo], size, slack)
        done = np.isfinite(times).all(1)
        out[todo[done]] = values[done]
        todo, slack = todo[~done], slack + 8.0
    return out


def _until(bags, size: int, slack: float):
    """Values and times of the earliest points up to a horizon of ``log(size) + slack`` mean times."""
    n = np.array([len(h) for h, _ in bags])
    bag = np.repeat(np.arange(len(bags)), n)
    element, weight = np.concatenate([h for h, _ in bags]), np.concatenate([w for _, w in bags])
    horizon = (np.log(size) + slack) / np.add.reduceat(weight, np.r_[0, np.cumsum(n)[:-1]]).astype(float)
    # one row per element and interval of its weight: the unit, then [2**k, 2**(k+1))
    rows, low, width = [np.arange(len(element))], [np.zeros(len(element), np.int64)], [np.ones(len(element), np.int64)]
    at, step = np.flatnonzero(weight > 1), 1
    while len(at):
        rows.append(at)
        low.append(np.full(len(at), step))
        width.append(np.full(len(at), step))
        step *= 2
        at = at[weight[at] > step]
    rows, low, width = map(np.concatenate, (rows, low, width))
    seed = mixed(element[rows] ^ mixed(low.astype(np.uint64)))
    best_time, best = np.full(len(bags) * size, np.inf), np.zeros(len(bags) * size, np.uint64)
    time, made, points = np.zeros(len(rows)), 0, []
    while len(rows):
        chunk = 64 if len(rows) <= 2048 else 1                  # few rows left: more points of each at once
        number = np.arange(made, made + chunk, dtype=np.uint64)
        draw = mixed(seed[:, None] + number[None, :] * _GOLDEN)
        wait = -np.log1p(-((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / (size * width)[:, None]
        wait[:, 0] += time
        when = np.cumsum(wait, 1)
        made += chunk
        inside = when <= horizon[bag[rows]][:, None]
        r, c = np.nonzero(inside)
        value = mixed(draw[r, c] ^ _ONE)                        # bits apart from those of the time
        place = low[r] + (value >> np.uint64(40)).astype(np.int64) % width[r]
        counts = place < weight[rows[r]]
        points.append((bag[rows[r]][counts] * size + (value[counts] & np.uint64(0xFFFF)).astype(np.int64) % size,
                       when[r, c][counts], value[counts]))
        on = inside[:, -1]
        rows, low, width, seed, time = rows[on], low[on], width[on], seed[on], when[on, -1]
    for slot, when, _ in points:
        np.minimum.at(best_time, slot, when)
    for slot, when, value in points:
        won = when == best_time[slot]
        best[slot[won]] = value[won]
    return best.reshape(-1, size), best_time.reshape(-1, size)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key per band: the band's number and its components."""
    keys = np.broadcast_to(mixed(np.arange(bands, dtype=np.uint64)), (len(signature), bands)).copy()
    for i in range(rows):
        keys = mixed(keys * _GOLDEN + signature[:, i:bands * rows:rows])
    return keys.view(np.int64)


def _long_lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    first, second = key128(whole_text(text))
    return docs.select(id_or_none(doc_id).alias("d"), first.alias("t1"), second.alias("t2"), whole_text(text).alias("text"))


def sketches(docs: DataFrame, size: int = SHINGLE, signature: int = SIGNATURE, bands: int = BANDS, rows: int = ROWS,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(d, t1, t2, h1, h2, n, bands)`` of every row: id, digests of text and multiset, the multiset's size and band keys."""
    def run(batches):
        from xxhash import xxh3_128_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bags = [shingles(t, size) for t in part.column(3).to_pylist()]
                digests = np.array([divmod(xxh3_128_intdigest(h.tobytes() + w.tobytes()), 1 << 64) for h, w in bags],
                                   np.uint64).view(np.int64)
                keys = band_keys(signatures(bags, signature), bands, rows)
                full = np.array([len(h) > 0 for h, _ in bags])
                lists = _long_lists([k if f else k[:0] for k, f in zip(keys, full, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                     pa.array([int(w.sum()) for _, w in bags], pa.int64()), lists],
                    names=["d", "t1", "t2", "h1", "h2", "n", "bands"])

    return _keyed(docs, doc_id, text).mapInArrow(
        run, "d long, t1 long, t2 long, h1 long, h2 long, n long, bands array<long>")


def multisets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(d, atoms array<long>)`` of rows ``(d, text)``: the k-th copy of a shingle is an element of its own."""
    def atoms(text: str) -> np.ndarray:
        hashes, weights = shingles(text, size)
        copy = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
        return mixed(np.repeat(hashes, weights) + mixed(copy.astype(np.uint64)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _long_lists([atoms(t) for t in part.column(1).to_pylist()])], names=["d", "atoms"])

    return docs.select("d", "text").mapInArrow(run, "d long, atoms array<long>")


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs (a, b)`` whose multisets' weighted Jaccard similarity reaches the threshold.

    A content that stands in very many pairs is copied to one task per ``FAN`` of them.
    """
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("k"))
    left = (fan.join(bags, fan["a"] == bags["d"]).select("a", F.col("atoms").alias("x"),
                                                         F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s")))
    right = (pairs.join(fan, "a").withColumn("s", F.pmod(F.xxhash64("b"), F.col("k")).cast("int"))
             .join(bags.select(F.col("d").alias("b"), F.col("atoms").alias("y")), "b"))
    both = F.size(F.array_intersect("x", "y"))
    return (right.join(left, ["a", "s"])
            .select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("all"))
            .filter(F.col("both") >= F.lit(threshold) * (F.col("all") - F.col("both")) - 1e-9).select("a", "b"))


def _alike_in_size(a: str, b: str, threshold: float):
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)


def _salted(column: str, salts: int = SALTS):
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def _times(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """Each row once per salt, for the side of a join that has one row per key."""
    return df.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))


def _linked_in_block(ours: pa.Table, theirs: pa.Table, threshold: float) -> pa.Table:
    """Links ``(a, b)`` that reach the threshold between two blocks ``(rep, label, atoms)``, as far as they join groups.

    Overlaps are counted exactly, one content of ours against all of theirs; of the links found, those stay that
    connect labels which no link of the block has connected yet.
    """
    a, b = [], []
    if ours.num_rows and theirs.num_rows:
        labels = ours.column("label").to_pylist() + theirs.column("label").to_pylist()
        parent = {x: x for x in labels}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        their_ids, their_labels = theirs.column("rep").to_pylist(), theirs.column("label").to_pylist()
        cells = theirs.column("atoms").combine_chunks()
        sizes = np.diff(cells.offsets.to_numpy())
        atoms, owner = cells.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(atoms, kind="stable")
        atoms, owner = atoms[order], owner[order]
        for own, label, bag in zip(ours.column("rep").to_pylist(), ours.column("label").to_pylist(),
                                   ours.column("atoms").combine_chunks(), strict=True):
            bag = bag.values.to_numpy()
            start, end = np.searchsorted(atoms, bag, "left"), np.searchsorted(atoms, bag, "right")
            held = end - start
            at = np.repeat(start - np.cumsum(held) + held, held) + np.arange(held.sum())
            both = np.bincount(owner[at], minlength=len(sizes))
            for i in np.flatnonzero(both >= threshold * (len(bag) + sizes - both) - 1e-9).tolist():
                if root(label) != root(their_labels[i]):
                    parent[root(label)] = root(their_labels[i])
                    a.append(own)
                    b.append(their_ids[i])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def crossing_links(near: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links between contents of one neighbourhood that do not hang together yet.

    ``near (hub, rep, label)`` lists each hub's neighbourhood with the labels of its contents. Contents whose label
    is not the hub's meet the whole neighbourhood in blocks, so that a task holds two blocks and no pairs are written
    but links.
    """
    own_label = near.filter("hub = rep").select("hub", F.col("label").alias("hub_label"))
    told = (near.withColumn("salt", _salted("rep")).join(_times(own_label), ["hub", "salt"]).drop("salt")
            .withColumn("apart", F.col("label") != F.col("hub_label")))
    open_hubs = (told.groupBy("hub").agg(F.count_if("apart").alias("n_ours"), F.count(F.lit(1)).alias("n"))
                 .filter("n_ours > 0")
                 .select("hub", F.ceil(F.col("n_ours") / BLOCK).cast("int").alias("ours"),
                         F.ceil(F.col("n") / BLOCK).cast("int").alias("theirs")))
    rows = (told.withColumn("salt", _salted("rep")).join(_times(open_hubs), ["hub", "salt"]).drop("salt")
            .join(bags, F.col("rep") == F.col("d")))
    key = F.xxhash64("rep")
    left = rows.filter("apart").select(
        "hub", "rep", "label", "atoms", F.pmod(key, F.col("ours")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)).alias("j"))
    right = rows.select(
        *[F.col(c).alias(c) for c in ("hub", "rep", "label", "atoms")], F.pmod(key, F.col("theirs")).cast("int").alias("j"),
        F.explode(F.sequence(F.lit(0), F.col("ours") - 1)).alias("i"))

    def search(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        return _linked_in_block(ours, theirs, threshold)

    return left.groupBy("hub", "i", "j").cogroup(right.groupBy("hub", "i", "j")).applyInArrow(
        search, "a long, b long")


def told_id(column: str):
    """The id, or null where there is none."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def row_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, signature: int = SIGNATURE,
                bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(d, t1, t2, label, class)``, one row per row of ``docs``: id, digest of the text, number and smallest id of its class.

    Nodes are contents, numbered once their table is written; ids play no part in what is linked.
    """
    sketch = written(sketches(docs, size, signature, bands, rows, doc_id, text))
    first = F.min(F.struct("d", "t1", "t2")).alias("first")
    least_id = F.min(told_id("d")).alias("least_id")
    contents = written(sketch.groupBy("h1", "h2").agg(first, least_id, F.first("n").alias("n"),
                                                      F.first("bands").alias("bands"))
                       .withColumn("rep", F.monotonically_increasing_id()))
    banded = contents.select("rep", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    members = written(banded.withColumn("salt", _salted("rep")).join(_times(shared), ["key", "salt"]).drop("salt"))
    crowd = members.groupBy("rep").agg(F.sum("held").alias("crowd"))
    best = F.min(F.struct((-F.col("crowd")).alias("least"), "rep", "n")).alias("best")
    hubs = (members.join(crowd, "rep").groupBy("key").agg(best)
            .select("key", F.col("best.rep").alias("hub"), F.col("best.n").alias("hub_n")))
    beside = written(members.withColumn("salt", _salted("rep")).join(_times(hubs), ["key", "salt"])
                     .select("hub", "hub_n", "rep", "n").distinct())
    some = (contents.join(members.select("rep").distinct(), "rep", "left_semi")
            .select("first.d", "first.t1", "first.t2", "rep"))
    texts = _keyed(docs, doc_id, text).join(some, ["d", "t1", "t2"]).select(F.col("rep").alias("d"), "text")
    bags = written(multisets(texts, size).dropDuplicates(["d"]))
    stars = written(verified(beside.filter((F.col("rep") != F.col("hub")) & _alike_in_size("n", "hub_n", threshold))
                             .select(F.col("hub").alias("a"), F.col("rep").alias("b")), bags, threshold))
    label = components(stars)
    near = written(beside.join(label.withColumnRenamed("node", "rep"), "rep", "left")
                   .select("hub", "rep", F.coalesce("label", "rep").alias("label")))
    links = stars.union(crossing_links(near, bags, threshold))
    label = components(links)
    classes = (contents.select("h1", "h2", "rep", "least_id").join(label.withColumnRenamed("node", "rep"), "rep", "left")
               .withColumn("label", F.coalesce("label", "rep")))
    named = classes.groupBy("label").agg(F.min("least_id").alias("class"))
    classes = classes.select("h1", "h2", "label").join(named, "label")
    own = sketch.select("d", "t1", "t2", "h1", "h2", _salted("d").alias("salt"))
    return own.join(_times(classes), ["h1", "h2", "salt"]).select("d", "t1", "t2", "label", "class")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, signature: int = SIGNATURE,
                    bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, class_id)``, one row per row of ``docs``: the smallest id of its class of near-duplicates.

    Classes are the connected components of verified pairs of contents, whatever ids these have. Texts without words
    (null, empty, blank) are one class. A class without any id has a null class id; different texts of one id may
    stand in different classes that have the same class id. An empty table gives an empty result. Extra columns are
    ignored.
    """
    return (row_classes(docs, threshold, size, signature, bands, rows, doc_id, text)
            .select(told_id("d").alias("doc_id"), F.col("class").alias("class_id")))


def first_of_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` per class of near-duplicates: that of the smallest id, and of the smallest digest under it.

    A row without an id stays only where none of its class has one. Rows are told apart by id and text: different texts
    of one id each belong to their own class, and a row that repeats stands once. Names that begin with ``_nd_`` are
    reserved.
    """
    rows = row_classes(docs, doc_id=doc_id, text=text, **options)
    least = F.min(F.struct((F.col("d") == NO_ID).alias("none"), "d", "t1", "t2")).alias("x")
    first = rows.groupBy("label").agg(least).select(
        F.col("x.d").alias("_nd_d"), F.col("x.t1").alias("_nd_t1"), F.col("x.t2").alias("_nd_t2"))
    one, two = key128(whole_text(text))
    own = docs.withColumns({"_nd_id": id_or_none(doc_id), "_nd_one": one, "_nd_two": two})
    same = ((F.col("_nd_id") == F.col("_nd_d")) & (F.col("_nd_one") == F.col("_nd_t1"))
            & (F.col("_nd_two") == F.col("_nd_t2")))
    return (own.join(first, same, "left_semi").dropDuplicates(["_nd_id", "_nd_one", "_nd_two"])
            .select(*docs.columns))


def op4_near_duplicates(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
