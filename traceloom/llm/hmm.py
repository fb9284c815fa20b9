"""Language-model scores of texts: a hidden Markov model over words, trained by Baum-Welch.

Every word has emissions of its own, whatever the vocabulary's size. Training starts from a tied model, in which words
fall into hashed classes: its rounds need no exchange but one sum per class. The last round unties them. Expected counts
go up by word, once for each chunk of texts that holds the word, so that no word is a hot key; what a word adds up to
comes down again to the chunks that share it, while a word of one chunk is told again from that chunk alone. Scores are
exact: a forward recursion scaled at every token.
"""

import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .common import whole_text

#: States; hashed classes of the tied model, and its rounds of Baum-Welch before the last one.
STATES, HASHED, ROUNDS = 4, 32_768, 2
#: Occurrences that speak for the states' own shares beside those of a word.
PRIOR = 2.0
#: Fixed values of the base score: what is added to a count, and every which document is held out.
ADDED, FOLDS = 0.1, 10
#: Tokens of a chunk of texts, unless one text is longer, and how many of them a recursion lays out together.
AT_ONCE, LAID = 1_000_000, 250_000
#: A chunk's row has megabytes: row groups of few rows, looked at after each row, and one row a batch.
ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}
ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _words(text: str) -> list[bytes]:
    """Words with A-Z lowered; ``bytes.lower`` lowers nothing else."""
    return text.encode().lower().split()


def _held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


CHUNK = "chunk long, doc_ids array<long>, lengths array<int>, letters binary, ends binary, classes binary, symbols binary"


def _packed(values: bytes) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values, "zstd", asbytes=True)


def _unpacked(cell) -> pa.Buffer:
    buffer = cell.as_buffer()
    return pa.decompress(buffer[8:], int.from_bytes(buffer[:8].to_pybytes(), "little"), "zstd")


def _planes(numbers: np.ndarray) -> bytes:
    """Small numbers, packed, with their first bytes together, then their second bytes, and so on."""
    return _packed(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(planes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(planes), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _listed(letters, ends) -> pa.Array:
    """The words of a chunk, from their letters one word after another and where each ends."""
    offsets = np.r_[0, _numbers(ends)].astype("<i4")
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), _unpacked(letters))


@contextmanager
def _rows_a_batch(spark: SparkSession, rows: int):
    """Python gets so many rows at a time from what runs meanwhile."""
    before = spark.conf.get(ROWS_A_BATCH)
    spark.conf.set(ROWS_A_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_A_BATCH, before)


def _runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The places of ``texts`` in runs of about ``LAID`` tokens; texts of like length are together."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(np.cumsum(lengths[order]) // LAID)) + 1)


def chunks(docs: DataFrame, hashed: int = HASHED, at_once: int = AT_ONCE) -> DataFrame:
    """The texts of ``docs (doc_id, text)``, about ``at_once`` tokens a row.

    ``symbols`` are the texts one after another as numbers of words, each text followed by its end, the word ``""``;
    frequent words have small numbers. ``letters`` and ``ends`` list the words, ``classes`` are their classes in the tied
    model. The JVM sees these four as packed bytes only.
    """
    def row(number, ids, texts, words):
        symbols = np.concatenate(texts)
        order = np.argsort(-np.bincount(symbols), kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order))
        listed = list(words)
        listed = [listed[i] for i in order.tolist()]
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
            pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
            pa.array([_packed(b"".join(listed))], pa.binary()),
            pa.array([_planes(np.cumsum([len(w) for w in listed]))], pa.binary()),
            pa.array([_planes(np.array([zlib.crc32(w) % hashed for w in listed], "<u4"))], pa.binary()),
            pa.array([_planes(place[symbols])], pa.binary())], names=[f.split()[0] for f in CHUNK.split(", ")])

    def run(batches):
        number = TaskContext.get().partitionId() << 36
        ids, texts, words, held = [], [], Numbers(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for own, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = _words(text)
                    ids.append(own)
                    texts.append(np.fromiter(map(words.__getitem__, [*found, b""]), "<u4", len(found) + 1))
                    held += len(found) + 1
                    if held >= at_once:
                        yield row(number, ids, texts, words)
                        number, ids, texts, words, held = number + 1, [], [], Numbers(), 0
        if ids:
            yield row(number, ids, texts, words)

    return docs.mapInArrow(run, CHUNK)


class Chunk:
    """One row of :func:`chunks`, read from a batch or table."""

    def __init__(self, batch, at: int = 0):
        def cell(name):
            return batch.column(name)[at]

        self.doc_ids, lengths = cell("doc_ids").as_py(), cell("lengths").as_py()
        self.held_out = [_held_out(d) for d in self.doc_ids]
        symbols, self.classes = (_numbers(cell(c)) for c in ("symbols", "classes"))
        self.texts = np.split(symbols, np.cumsum(lengths)[:-1])

    @classmethod
    def each(cls, batches):
        for batch in batches:
            for at in range(batch.num_rows):
                yield cls(batch, at)

    @property
    def training(self) -> list[np.ndarray]:
        return [t for t, held in zip(self.texts, self.held_out, strict=True) if not held]

    def expected(self, tied: "Hmm") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Initial states, transitions, and words' occurrences and expected counts of states, of the training texts.

        A word's share in its class is the same in all states, so it does not move the expectation.
        """
        k, n, training = len(tied.initial), len(self.classes), self.training
        first, pairs, counts, emitted = np.zeros(k), np.zeros((k, k)), np.zeros(n, np.int64), np.zeros((n, k))
        own = Hmm(tied.initial, tied.moves, tied.emits[self.classes])
        for run in _runs(training) if training else ():
            texts = [training[i] for i in run]
            counts += np.bincount(np.concatenate(texts), minlength=n)
            for total, more in zip((first, pairs, emitted), own.expected(texts), strict=True):
                total += more
        return first, pairs, counts, emitted

    def log10_likelihoods(self, own: "Hmm") -> np.ndarray:
        out = np.empty(len(self.texts))
        for run in _runs(self.texts):
            out[run] = own.log10_likelihoods([self.texts[i] for i in run])
        return out


def _class_sequences(batches):
    """The training texts of each chunk as sequences of classes, a run at a time."""
    for chunk in Chunk.each(batches):
        training = chunk.training
        for run in _runs(training) if training else ():
            yield [chunk.classes[training[i]] for i in run]


def _sequences(batches):
    """Rows of one column, each the classes of a text."""
    for batch in batches:
        if batch.num_rows:
            yield [np.frombuffer(c.as_buffer(), "<u2") for c in batch.column(0)]


class Sequences:
    """Sequences of different lengths laid out by time, so that one step works on all that still go on."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        self.active = len(lengths) - np.searchsorted(ordered[::-1], np.arange(ordered[0]), side="right")
        self.start = np.r_[0, np.cumsum(self.active)]
        times = np.concatenate([np.arange(n) for n in ordered])
        place = self.start[times] + np.repeat(np.arange(len(ordered)), ordered)
        self.symbols = np.empty(len(place), np.intp)
        self.symbols[place] = np.concatenate([sequences[i] for i in self.order])

    def steps(self):
        return zip(self.start[:-1].tolist(), self.start[1:].tolist(), self.active.tolist(), strict=True)


class Hmm:
    """Initial, transition and emission probabilities; emissions are classes by states."""

    def __init__(self, initial: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.initial, self.moves, self.emits = initial, moves, emits

    @classmethod
    def started(cls, frequency: np.ndarray, states: int, seed: int = 7) -> "Hmm":
        """States that like to stay, and emit each class about as often as it occurs, with some chance."""
        emits = frequency[:, None] * np.exp(np.random.default_rng(seed).normal(size=(len(frequency), states)))
        stay = 0.9
        moves = np.full((states, states), (1 - stay) / max(1, states - 1))
        np.fill_diagonal(moves, stay if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), moves, emits / emits.sum(0))

    def log10_likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The scaled forward recursion: the logarithms of the scales add up to that of the probability."""
        laid, total = Sequences(sequences), np.zeros(len(sequences))
        alpha = None
        for a, b, n in laid.steps():
            alpha = (np.broadcast_to(self.initial, (n, len(self.initial))) if alpha is None
                     else alpha[:n] @ self.moves) * self.emits[laid.symbols[a:b]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
        out = np.empty(len(sequences))
        out[laid.order] = total
        return out

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts (initial, transitions, emissions) over the sequences: the expectation step."""
        laid = Sequences(sequences)
        k, n_all, steps = len(self.initial), len(laid.symbols), list(laid.steps())
        seen, alpha = self.emits[laid.symbols], np.empty((n_all, k))
        scale = np.empty(n_all)
        for t, (a, b, n) in enumerate(steps):
            now = (self.initial if t == 0 else alpha[steps[t - 1][0]:steps[t - 1][0] + n] @ self.moves) * seen[a:b]
            scale[a:b] = total = now.sum(1)
            np.divide(now, total[:, None], out=alpha[a:b])
        seen /= scale[:, None]                               # emissions over scales, as the backward step needs them
        pairs, back = np.zeros((k, k)), None
        for t in range(len(steps) - 1, -1, -1):
            a, b, n = steps[t]
            beta = np.ones((n, k))
            if back is not None:
                beta[:len(back)] = back @ self.moves.T
                pairs += alpha[a:a + len(back)].T @ back
            back = beta * seen[a:b]
            alpha[a:b] *= beta                               # now the probability of each state
        emitted = np.stack([np.bincount(laid.symbols, alpha[:, s], len(self.emits)) for s in range(k)], 1)
        return alpha[:steps[0][1]].sum(0), pairs * self.moves, emitted

    def trained(self, sequences: DataFrame, read=_sequences) -> "Hmm":
        """One round of Baum-Welch over the lists of sequences that ``read`` makes of the batches of ``sequences``.

        Counts are added up inside each task, then across tasks; one row per class, state or total reaches the
        driver. Classes and moves that were not seen keep a small share.
        """
        k, n_classes = len(self.initial), len(self.emits)
        shared = sequences.sparkSession.sparkContext.broadcast(self)
        columns = [f"s{i}" for i in range(k)]

        def run(batches):
            model = shared.value
            total = np.zeros((n_classes + k + 1, k))
            for group in read(batches):
                first, pairs, emitted = model.expected(group)
                total[:n_classes] += emitted
                total[n_classes:-1] += pairs
                total[-1] += first
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[at, i]) for i in range(k)]],
                                             names=["at", *columns])

        parts = sequences.mapInArrow(run, "at long, " + ", ".join(f"{c} double" for c in columns))
        rows = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        total = np.zeros((n_classes + k + 1, k))
        total[rows["at"].to_numpy(int)] = rows[columns].to_numpy(float)
        total[:n_classes] += ADDED
        total[n_classes:] += 1.0
        moves = total[n_classes:-1]
        return Hmm(total[-1] / total[-1].sum(), moves / moves.sum(1, keepdims=True),
                   total[:n_classes] / total[:n_classes].sum(0))


def expected_by_word(texts: DataFrame, model: Hmm) -> DataFrame:
    """``(word, edge, chunk, at, c, s0, s1, ...)``: what each word of each chunk is expected to count.

    ``c`` are its occurrences in training texts, and the columns after it those in each state but the last. Rows with an
    ``edge`` have no word: transitions from that state, and after the last state the initial ones.
    """
    k = len(model.initial)
    shared = texts.sparkSession.sparkContext.broadcast(model)
    columns = [f"s{i}" for i in range(k)]
    schema = "word string, edge int, chunk long, at int, c long, " + ", ".join(f"{c} double" for c in columns)

    def run(batches):
        edges = np.zeros((k + 1, k))
        for batch in batches:
            for at in range(batch.num_rows):
                first, pairs, counts, emitted = Chunk(batch, at).expected(shared.value)
                edges[:k] += pairs
                edges[k] += first
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [_listed(batch.column("letters")[at], batch.column("ends")[at]), pa.nulls(n, pa.int32()),
                     pa.array(np.full(n, batch.column("chunk")[at].as_py())), pa.array(np.arange(n, dtype=np.int32)),
                     pa.array(counts), *[pa.array(emitted[:, i]) for i in range(k - 1)], pa.nulls(n, pa.float64())],
                    names=["word", "edge", "chunk", "at", "c", *columns])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k + 1, pa.string()), pa.array(np.arange(k + 1, dtype=np.int32)), pa.nulls(k + 1, pa.int64()),
             pa.nulls(k + 1, pa.int32()), pa.array(np.zeros(k + 1, np.int64)), *[pa.array(edges[:, i]) for i in range(k)]],
            names=["word", "edge", "chunk", "at", "c", *columns])

    return texts.mapInArrow(run, schema)


def _weight(c):
    return (c + ADDED) / (c + PRIOR)


class Untied:
    """The model with a word's own emissions: of the word's smoothed count, each state takes its share.

    A share counts the word's expected occurrences in a state and ``PRIOR`` occurrences dealt as all words are; a word
    that training never saw is dealt by these alone. Shares times counts, over a state's sum of them, are the emissions.
    """

    def __init__(self, initial: np.ndarray, moves: np.ndarray, dealt: np.ndarray, sums: np.ndarray):
        self.initial, self.moves, self.dealt, self.sums = initial, moves, dealt, sums

    @classmethod
    def of(cls, edges: np.ndarray, counted: np.ndarray, weighed: np.ndarray, weights: float) -> "Untied":
        """From transitions with initial states below, and sums over all words: of the states' counts, of these times
        the word's weight, and of the weights."""
        edges, k = edges + 1.0, edges.shape[1]
        dealt = counted / counted.sum() if counted.sum() > 0 else np.full(k, 1 / k)
        return cls(edges[k] / edges[k].sum(), edges[:k] / edges[:k].sum(1, keepdims=True), dealt,
                   weighed + dealt * (PRIOR * weights + ADDED))

    def emits(self, counts: np.ndarray, expected: np.ndarray) -> np.ndarray:
        """Emissions of words by their occurrences and the expected counts of their states (words by states)."""
        return (expected + PRIOR * self.dealt) * _weight(counts)[:, None] / self.sums


def added_up(parts: DataFrame, k: int) -> tuple[DataFrame, Untied, int, int]:
    """What words that several chunks share add up to, the untied model, and how many tokens and words it has seen.

    The rows of a word, one for each chunk that holds it, meet once. All sums over words are taken on that pass, and
    only rows of shared words and of edges are written.
    """
    columns = [f"s{i}" for i in range(k)]
    met, word = Window.partitionBy("word", "edge"), F.col("word").isNotNull()
    rows = parts.select("word", "edge", "chunk", "at", "c", F.count(F.lit(1)).over(met).alias("n"),
                        F.sum("c").over(met).alias("total"), *[F.sum(x).over(met).alias(x) for x in columns])
    seen = F.when(word & (F.col("total") > 0), 1 / F.col("n")).otherwise(0.0)             # a word counts once
    weight = seen * _weight(F.col("total"))
    sums = Observation()
    rows = rows.observe(
        sums, F.sum("c").alias("tokens"), F.sum(seen).alias("words"), F.sum(weight).alias("weights"),
        F.sum(weight * F.col("total")).alias("weighed"),
        *[F.sum(F.when(word, seen * F.col(x))).alias(f"counted_{x}") for x in columns[:-1]],
        *[F.sum(F.when(word, weight * F.col(x))).alias(f"weighed_{x}") for x in columns[:-1]])
    table = written(rows.filter((F.col("n") > 1) | ~word).select("edge", "chunk", "at", "total", *columns))
    got = {name: value or 0 for name, value in sums.get.items()}
    edges = np.zeros((k + 1, k))
    for r in table.filter("edge IS NOT NULL").groupBy("edge").agg(*[F.first(x).alias(x) for x in columns]).collect():
        edges[r["edge"]] = [r[x] for x in columns]
    counted, weighed = ([got[f"{name}_{x}"] for x in columns[:-1]] for name in ("counted", "weighed"))
    model = Untied.of(edges, np.array([*counted, got["tokens"] - sum(counted)]),
                      np.array([*weighed, got["weighed"] - sum(weighed)]), got["weights"])
    return (table.filter("edge IS NULL").select(F.col("chunk").alias("of"), "at", "total", *columns[:-1]), model,
            int(got["tokens"]), round(got["words"]))


def score_texts(docs: DataFrame, states: int = STATES, hashed: int = HASHED, rounds: int = ROUNDS,
                doc_id: str = "doc_id", text: str = "text", at_once: int = AT_ONCE) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    ``base_score`` is the smoothed unigram score and ``score`` the model's, both log10. A null text is empty: its end
    alone. Rows without an id are held out; rows that repeat an id are scored, and trained on, each time. Without
    training texts every word is unknown. An empty table gives an empty result. Extra columns are ignored.
    ``hashed`` bounds the tied model of the first ``rounds``; the last round gives every word emissions of its own.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    with _rows_a_batch(docs.sparkSession, 256):
        texts = written(chunks(docs, hashed, at_once), **ROW_GROUPS)
    tied = Hmm.started(np.full(hashed, 1 / hashed), states)
    with _rows_a_batch(docs.sparkSession, 1):
        for _ in range(rounds):
            tied = tied.trained(texts.select("doc_ids", "lengths", "classes", "symbols"), _class_sequences)
        common, untied, total, distinct = added_up(expected_by_word(texts, tied), states)
    scale = float(total + ADDED * (distinct + 1))
    shared = docs.sparkSession.sparkContext.broadcast((tied, untied))

    def score(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        chunk, (tied, untied) = Chunk(ours), shared.value
        _, _, counts, expected = chunk.expected(tied)             # right for words of this chunk alone
        if theirs.num_rows:
            at = theirs.column("at").to_numpy()
            counts[at] = theirs.column("total").to_numpy()
            for i in range(states - 1):
                expected[at, i] = theirs.column(f"s{i}").to_numpy()
        expected[:, -1] = counts - expected[:, :-1].sum(1)
        own = Hmm(untied.initial, untied.moves, untied.emits(counts, expected))
        logs = np.log10((counts + ADDED) / scale)
        return pa.table({
            "doc_id": pa.array(chunk.doc_ids, pa.int64()), "held_out": pa.array(chunk.held_out, pa.bool_()),
            "n_tokens": pa.array([len(t) for t in chunk.texts], pa.int64()),
            "n_known": pa.array([int((counts[t] > 0).sum()) for t in chunk.texts], pa.int64()),
            "base_score": pa.array([float(logs[t].sum()) for t in chunk.texts], pa.float64()),
            "score": pa.array(chunk.log10_likelihoods(own), pa.float64())})

    scored = texts.drop("letters", "ends").groupBy("chunk").cogroup(common.groupBy("of")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known",
                         F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_scores(spark, sf_dir):
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
