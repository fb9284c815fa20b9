"""Document quality by hierarchical empirical Bayes: what a text shows, and what its site has shown so far.

A logistic model of a few measures of the text gives each document's evidence. Its probabilities are summed up by
path and by host. A host's rate is shrunk towards the global rate and a path's towards its host's, the more the
fewer documents it has; how much follows from how far rates differ between sites beyond what chance explains. The
posterior of a document replaces the global prior in its evidence by its path's rate.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import SPACES, UPPER, whole_text, words_of

#: Labelled rows that the text model is fitted on at most: those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
#: Ridge penalty and Newton rounds of the fit, and the posterior from which a document is kept.
PENALTY, NEWTON, KEEP_FROM = 1.0, 25, 0.5
SALTS = 16
#: Characters whose share of a text is measured.
SYMBOLS, MARKS, DIGITS, BRACKETS = "#*$%&|<>", "!?", "0123456789", "()[]{}=;_/\\"
MEASURES = ("log_words", "word_length", "distinct", "repeated_lines", "short_lines", "upper", "symbols", "marks",
            "digits", "brackets", "longest_word")


def text_measures(text: str) -> tuple[float, ...]:
    words = words_of(text)
    n, chars = len(words), max(1, len(text) - sum(map(text.count, SPACES)))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]

    def share(symbols):
        return sum(map(text.count, symbols)) / chars

    return (np.log1p(n), chars / max(1, n), len(set(words)) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)),
            sum(len(x) < 20 for x in lines) / max(1, len(lines)), share(UPPER), share(SYMBOLS), share(MARKS),
            share(DIGITS), share(BRACKETS), np.log1p(max(map(len, words), default=0)))


class TextModel:
    """Logistic regression on standardised measures, fitted by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        d = len(MEASURES)
        self.mean = x.mean(0) if len(x) else np.zeros(d)
        self.scale = np.where(x.std(0) > 1e-9, x.std(0), 1.0) if len(x) else np.ones(d)
        self.weights, self.rate = np.zeros(d + 1), (y.sum() + 1) / (len(y) + 2)
        z = self._design(x)
        ridge = np.diag([0.0, *[PENALTY] * d])
        self.weights[0] = np.log(self.rate / (1 - self.rate))
        if len(np.unique(y)) < 2:
            return                                           # one class only: its rate is all there is to know
        for _ in range(NEWTON):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            slope = z.T @ (p - y) + ridge @ self.weights
            bend = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge
            self.weights -= np.linalg.solve(bend, slope)

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[np.ones(len(z)), z]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.weights, -30, 30)


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs (…, text)`` with the text replaced by its measures."""
    kept = docs.select(*columns, "text")
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "text"]
                       + ["x array<double>"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = [text_measures(t) for t in part.column(len(columns)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(x, pa.list_(pa.float64()))],
                                                 names=[*columns, "x"])

    return kept.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, label: str = "quality") -> TextModel:
    """The text model of at most ``most`` labelled documents; ``docs`` has ``doc_id, text``. Null labels say nothing."""
    sample = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
              .filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")      # at most ``most`` rows
    rows = _measured(labelled, ["doc_id", "y"]).groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    found = rows.orderBy("doc_id").collect()
    return TextModel(np.array([r["x"] for r in found], float).reshape(-1, len(MEASURES)),
                     np.array([r["y"] for r in found], float))


def evidence(docs: DataFrame, model: TextModel) -> DataFrame:
    """``(doc_id, host, path, evidence)``: the model's log-odds for ``docs (doc_id, host, path, text)``."""
    columns = ["doc_id", "host", "path"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([text_measures(t) for t in part.column(3).to_pylist()], float)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(shared.value.logits(x))],
                                                 names=[*columns, "evidence"])

    return docs.select(*columns, "text").mapInArrow(run, "doc_id long, host string, path string, evidence double")


def _strength(groups: DataFrame, over: str) -> float:
    """How many documents a parent's rate weighs: method of moments over groups ``(n, s, <over>)``.

    Between groups, rates differ by chance (about r(1-r)/n) and beyond; the less beyond, the stronger the parent.
    """
    rate, up = F.col("s") / F.col("n"), F.col(over)
    row = groups.agg(F.sum(F.col("n") * (rate - up) ** 2).alias("spread"), F.sum("n").alias("n"),
                     F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") * up * (1 - up)).alias("chance")).first()
    if not row["n"] or not row["chance"]:
        return 1.0
    chance = row["chance"] / row["n"]                                      # r(1-r), weighted
    beyond = max((row["spread"] - row["groups"] * chance) / row["n"], 1e-4 * chance)
    return max(chance / beyond - 1, 1.0)


def _log_odds(p):
    return F.log(p / (1 - p))


def site_posteriors(scored: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """``(doc_id, evidence, host_rate, path_rate, posterior, kept)`` of rows of :func:`evidence`.

    Rates by path and host are grouped sums, so a host with a third of all rows is summed up in parts. Null hosts and
    null paths are a site each. An empty table gives an empty result.
    """
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = paths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
    overall = F.lit((s + 0.5) / (n + 1.0))
    hosts = hosts.withColumn("up", overall)
    k_host = _strength(hosts, "up")
    rated = hosts.select(F.col("host").alias("h"), ((F.col("s") + k_host * overall) / (F.col("n") + k_host)).alias("host_rate"))
    under = written(paths.join(rated, F.col("host").eqNullSafe(F.col("h"))).select(
        "host", "path", "n", "s", "host_rate"))
    k_path = _strength(under, "host_rate")
    path_rate = (F.col("s") + k_path * F.col("host_rate")) / (F.col("n") + k_path)
    sites = under.select(F.col("host").alias("h"), F.col("path").alias("p"), "host_rate",
                         path_rate.alias("path_rate"),
                         F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("site_salt"))
    own = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "evidence"), F.lit(SALTS)).cast("int"))
    joined = own.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
                      & (F.col("salt") == F.col("site_salt")))
    odds = F.col("evidence") + _log_odds(F.col("path_rate")) - _log_odds(overall)
    posterior = 1 / (1 + F.exp(-odds))
    return joined.select("doc_id", "evidence", "host_rate", "path_rate", posterior.alias("posterior"),
                         (posterior >= keep_from).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, doc_id: str = "doc_id",
             text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """Quality of every row of ``docs``, from labels ``(doc_id, quality 0/1)`` of some of them.

    A null text is measured as empty. Rows that repeat an id are judged by their own text; labels that repeat one
    count once. Without labels all evidence is even and everything is kept. Extra columns are ignored.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                      F.col(path).cast("string").alias("path"), whole_text(text).alias("text"))
    return site_posteriors(written(evidence(own, fit(own, labels, most))))


def op5_quality(spark, sf_dir):
    """Hosts are sources; a source's texts in one language are its path."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
