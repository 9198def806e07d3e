"""Quality classifier: a document's own evidence on top of shrunk host and path rates (hierarchical empirical Bayes)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import prepare, row_key, settle, without_rows

#: At most so many labelled documents are used to fit the text classifier, those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: At most so many words of each target are features, those that tell most between its classes in the sample: the number that loses least
#: on a fold of the sample.
WORDS_PER_TARGET = (400, 1500)
FOLDS, HELD_OUT_FOLD = 5, 0
#: A document stays below these probabilities. Toxic ones are rare and their words telling, so less is enough there.
MOST_BAD, MOST_TOXIC = 0.5, 0.2
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 4
_CLASS[128:] = 4


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from fitting, to measure accuracy on."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT_FOLD


def shape(text: bytes, words: list[bytes]) -> list[float]:
    """What the text looks like, whatever its words mean: 14 numbers, roughly between 0 and 3."""
    if not words:
        return [0.0] * 13 + [1.0]
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=5) / len(text)
    counts = Counter(words)
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    top = counts.most_common(3)
    lengths = len(b"".join(words)) / n
    runs = sum(map(bytes.__eq__, words[1:], words))
    return [
        kinds[1] * 10, kinds[2] * 3, kinds[3] * 5, kinds[0] * 3, len(counts) / n, len(counts) / n**0.7, top[0][1] / n, sum(c for _, c in top) / n,
        np.log1p(n) / 4, lengths / 5, runs / n, 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)) / 50, 0.0,
    ]


def _folded(text: bytes) -> tuple[list[bytes], set[bytes]]:
    """Words as they stand; and the distinct ones in lower case without marks around them, with their beginnings of four and five bytes."""
    words = text.split()
    own = {w.strip(b".,;:!?()\"'|*#$%&") for w in set(text.lower().split())} - {b""}
    long = [w for w in own if len(w) > 5]
    return words, own.union([w[:5] + b"-" for w in long], [w[:4] + b"-" for w in long])


def labelled_rows(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """``docs`` with a 0/1 label for each target, null where an id has none; of repeated labels of an id, the largest. Rows without any are left out."""
    marks = labels.groupBy("doc_id").agg(*[F.max(t).alias(t) for t in targets])
    return docs.join(marks.dropna("all", subset=list(targets)), "doc_id")


class TextModel:
    """Logistic regression over shape numbers, their squares and the presence of chosen words; one weight row per target."""

    def __init__(self, words: list[bytes], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.words, self.mean, self.scale, self.weights = {w: k for k, w in enumerate(words)}, mean, scale, weights

    def logits(self, texts_: list[bytes]) -> np.ndarray:
        n_shape = 2 * len(self.mean) + 1
        out = np.empty((len(texts_), len(self.weights)))
        for k, text in enumerate(texts_):
            words, distinct = _folded(text)
            x = np.clip((np.array(shape(text, words)) - self.mean) / self.scale, -5, 5)
            hits = [self.words[w] for w in distinct if w in self.words]
            out[k] = self.weights[:, :n_shape] @ np.concatenate([[1.0], x, x * x - 1]) + self.weights[:, n_shape:][:, hits].sum(axis=1)
        return out


def _fit(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, n_words: int, y: np.ndarray, steps: int = 300, decay: float = 5e-5) -> np.ndarray:
    """Weights that minimise the log loss, by Adam on all rows at once. ``rows`` and ``cols``: which row has which word."""
    n, d = x.shape
    w, first, second = np.zeros(d + n_words), np.zeros(d + n_words), np.zeros(d + n_words)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w[0] = np.log(base / (1 - base))
    for step in range(1, steps + 1):
        z = x @ w[:d] + np.bincount(rows, w[d + cols], n)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.concatenate([x.T @ error, np.bincount(cols, error[rows], n_words)]) / n + decay * np.concatenate([[0], w[1:]])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w -= 0.1 * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def _choose(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, sets: list[np.ndarray], y: np.ndarray, fold: np.ndarray, most: float) -> int:
    """Which set of words loses least on the fold when fitted on the other rows: share of hits missed and of others rejected at ``most``;
    of equals, the first."""
    if not (0 < y[fold].sum() < fold.sum() < len(y)):
        return 0
    d, place, lost = x.shape[1], np.cumsum(~fold) - 1, []
    for own in sets:
        at = own[cols]
        r, c = rows[at], cols[at]
        fit = ~fold[r]
        w = _fit(x[~fold], place[r[fit]], c[fit], len(own), y[~fold])
        z = x @ w[:d] + np.bincount(r, w[d + c], len(y))
        gone = z[fold] >= np.log(most / (1 - most))
        hit = y[fold] > 0
        lost.append((~gone[hit]).mean() + gone[~hit].mean())
    return int(np.argmin(lost))


def fit_text_model(rows: DataFrame, targets: tuple[str, ...], mosts: tuple[float, ...]) -> TextModel:
    """Fit on ``doc_id, text`` and one 0/1 column per target, a bounded sample; a target is fitted on the rows that have it. The driver sees
    shape numbers and the positions of chosen words, never a text."""
    sample = settle(rows.select("doc_id", F.encode("text", "utf-8").alias("text"), *targets))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = [batch.column(t).to_pylist() for t in targets]
            marks = [[1] * batch.num_rows, *labels, *([mark is not None for mark in own] for own in labels)]
            counts: list[Counter] = [Counter() for _ in marks]
            for k, text in enumerate(batch.column("text")):
                distinct = _folded(text.as_buffer().to_pybytes())[1]
                for count, mark in zip(counts, marks):
                    if mark[k]:
                        count.update(distinct)
            columns = [pa.array([count[word] for word in counts[0]], pa.int64()) for count in counts]
            yield pa.RecordBatch.from_arrays([pa.array(list(counts[0]), pa.binary()), *columns], ["word", *counted])

    counted = ["n", *targets, *(f"has_{t}" for t in targets)]
    sums = sample.mapInArrow(words_of, "word binary, " + ", ".join(f"{c} long" for c in counted)).groupBy("word").agg(*[F.sum(c).alias(c) for c in counted])
    common = settle(sums.where("n >= 5"))
    whole = sample.agg(*[call(t).alias(f"{name}_{t}") for t in targets for name, call in (("n", F.count), ("hits", F.sum))]).first()
    ranked: list[list[bytes]] = []
    for target in targets:
        n, hits = max(1, whole[f"n_{target}"]), whole[f"hits_{target}"] or 0
        inside, outside = F.col(target) / max(1, hits), (F.col(f"has_{target}") - F.col(target)) / max(1, n - hits)
        share = F.col(f"has_{target}") / n
        strength = F.abs(inside - outside) / F.sqrt(share * (1 - share) * (1 / max(1, hits) + 1 / max(1, n - hits)) + 1e-12)
        best = common.select("word", strength.alias("s")).orderBy(F.desc("s"), "word").limit(max(WORDS_PER_TARGET)).collect()
        ranked.append([bytes(row["word"]) for row in best])
    words = sorted(set().union(*ranked))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(words)}
        for batch in batches:
            shapes, hits = [], []
            for text in batch.column("text"):
                raw = text.as_buffer().to_pybytes()
                own, distinct = _folded(raw)
                shapes.append(shape(raw, own))
                hits.append(sorted(place[w] for w in distinct if w in place))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *targets)), pa.array(shapes, pa.list_(pa.float64())), pa.array(hits, pa.list_(pa.int32()))], ["doc_id", *targets, "shape", "hits"])

    table = sample.mapInArrow(features, "doc_id long, " + ", ".join(f"{t} int" for t in targets) + ", shape array<double>, hits array<int>").toArrow()
    n = table.num_rows
    shapes = np.array(table.column("shape").to_pylist(), float).reshape(n, -1) if n else np.zeros((0, 14))
    mean = shapes.mean(axis=0) if n else np.zeros(shapes.shape[1])
    scale = np.maximum(shapes.std(axis=0), 1e-3) if n else np.ones(shapes.shape[1])
    x = np.clip((shapes - mean) / scale, -5, 5)
    x = np.concatenate([np.ones((n, 1)), x, x * x - 1], axis=1)
    hits = table.column("hits").combine_chunks()
    cols = hits.flatten().to_numpy()
    rows_ = np.repeat(np.arange(n), hits.value_lengths().to_numpy()) if n else np.zeros(0, np.int64)
    fold = pc.fill_null(table.column("doc_id"), 0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    own = [np.isin(words, sorted(set().union(*(r[:size] for r in ranked)))) if words else np.zeros(0, bool) for size in WORDS_PER_TARGET]
    weights = []
    for target, most in zip(targets, mosts):
        y = table.column(target).to_numpy().astype(float)
        has = ~np.isnan(y)
        place, word = (np.cumsum(has) - 1)[rows_[has[rows_]]], cols[has[rows_]]
        best = _choose(x[has], place, word, own, y[has], (fold % np.uint64(FOLDS) == 0)[has], most)
        at = own[best][word]
        weights.append(_fit(x[has], place[at], word[at], len(words), y[has]) if has.any() else np.zeros(x.shape[1] + len(words)))
    return TextModel(words, mean, scale, np.array(weights))


def shrunk_rates(marked: DataFrame, target: str) -> DataFrame:
    """``host, path, host_rate, path_rate, global_rate``: rates of the target by site, each shrunk toward the level above.

    A host with ``n`` labelled documents, ``x`` of them hits, has the rate ``(x + k * global) / (n + k)``; a path of it the same with the host's
    rate in place of the global one. The weight ``k`` of a level is estimated from the spread of its groups (method of moments): where
    groups differ no more than chance makes them, it is large and they all keep the rate above. Everything comes from grouped sums.
    """
    paths = marked.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("x"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("x").alias("hx"))
    moments = "sum(n) n, sum(x) x, sum(x * x / n) q, sum(double(n) * n) nn, count(*) g"
    h = hosts.select(F.col("hn").alias("n"), F.col("hx").alias("x")).selectExpr(*moments.split(", ")).first()
    p = paths.selectExpr(*moments.split(", ")).first()
    total = h["n"] or 0
    rate = ((h["x"] or 0) + 1) / (total + 2)
    noise = rate * (1 - rate)

    def weight(between: float, groups: int, size: float) -> float:
        spread = max((between - groups * noise) / size, 1e-6) if size > 0 else 1e-6
        return min(max(noise / spread - 1, 1.0), 1e6)

    k_host = weight((h["q"] or 0) - total * rate * rate, max(0, (h["g"] or 0) - 1), total - (h["nn"] or 0) / max(1, total))
    k_path = weight((p["q"] or 0) - (h["q"] or 0), max(0, (p["g"] or 0) - (h["g"] or 0)), total - (p["nn"] or 0) / max(1, total))
    host_rate = (F.col("hx") + k_host * rate) / (F.col("hn") + k_host)
    joined = paths.join(hosts.withColumn("host_rate", host_rate), "host")
    path_rate = (F.col("x") + k_path * F.col("host_rate")) / (F.col("n") + k_path)
    return joined.select("host", "path", "host_rate", path_rate.alias("path_rate"), F.lit(rate).alias("global_rate"))


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    quality_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, text_bad, text_toxic, host_rate, path_rate, bad, toxic, kept``.

    ``labels`` gives some ids a quality (1 good, 0 bad) and a toxicity (1 or 0). A logistic model over shape numbers and telling words, fitted on
    a bounded sample of labelled rows outside the held-out fold, gives each text its own probability to be bad (``text_bad``) and toxic
    (``text_toxic``). Host and path rates of bad and of toxic documents come from all labelled rows outside that fold, by grouped sums, each
    shrunk toward the level above (``shrunk_rates``); the rates of a site without labels are its host's or the global ones. The
    posterior odds of ``bad`` and of ``toxic`` are the path's rate as prior odds times the text's own odds over the global odds.
    ``host_rate`` and ``path_rate`` are those of bad documents. ``kept`` is true where ``bad`` is below 0.5 and ``toxic`` below 0.2.

    Null and empty texts have no words and are judged by that. Null hosts and paths are empty ones, sites like others. Repeated rows are
    judged each alike; null ids have no label but are judged. Each target takes the rows that have its label, whether or not they have the
    other's. Without any label of a target its rates are one half, its text says nothing, and nothing is rejected for it. An empty table
    gives no rows. Extra columns are not read.
    """
    return _judged(docs, labels, id_col, text_col, host_col, path_col, quality_col, toxic_col).drop("row_key")


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, quality_col: str, toxic_col: str) -> DataFrame:
    """``classify_quality`` with the ``row_key`` of each row."""
    spark = docs.sparkSession
    prepare(spark)
    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((host_col, "host"), (path_col, "path"))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *site, row_key(id_col, text_col).alias("row_key"))
    bad = labels.select(F.col(id_col).cast("long").alias("doc_id"), (1 - F.col(quality_col).cast("int")).alias("bad"), F.col(toxic_col).cast("int").alias("toxic"))
    marked = settle(labelled_rows(rows.select("doc_id", "host", "path"), bad, ("bad", "toxic")).where(~held_out(F.col("doc_id"))))
    sample = marked.select("doc_id", "bad", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # At most SAMPLE_ROWS rows of three numbers.
    model = spark.sparkContext.broadcast(fit_text_model(rows.join(F.broadcast(sample), "doc_id"), ("bad", "toxic"), (MOST_BAD, MOST_TOXIC)))
    rates = {t: settle(shrunk_rates(marked.select("host", "path", t).where(F.col(t).isNotNull()), t)) for t in ("bad", "toxic")}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.clip(model.value.logits([t.as_buffer().to_pybytes() for t in batch.column("text")]), -30, 30)
            p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p[:, 0]), pa.array(p[:, 1])], [*kept, "text_bad", "text_toxic"])

    kept = ["doc_id", "row_key", "host", "path"]
    judged = rows.select(*kept, F.encode("text", "utf-8").alias("text")).mapInArrow(judge, "doc_id long, row_key long, host string, path string, text_bad double, text_toxic double")
    odds = lambda p: p / (1 - p)
    placed, rate, posterior, fine = judged, {}, {}, F.lit(True)
    for (t, found), most in zip(rates.items(), (MOST_BAD, MOST_TOXIC)):
        first = found.select("global_rate").first()
        overall = first[0] if first else 0.5
        by_path = found.select("host", "path", F.col("path_rate").alias(f"{t}_path"))
        by_host = found.groupBy("host").agg(F.min("host_rate").alias(f"{t}_host"))
        placed = placed.join(by_path, ["host", "path"], "left").join(by_host, "host", "left")
        rate[t] = F.coalesce(f"{t}_host", F.lit(overall)), F.coalesce(f"{t}_path", f"{t}_host", F.lit(overall))
        raised = odds(rate[t][1]) * odds(F.col(f"text_{t}")) / (overall / (1 - overall))
        posterior[t] = (raised / (1 + raised)).alias(t)
        if first:
            fine = fine & (F.col(t) < most)
    scored = placed.select(
        "doc_id", "row_key", held_out(F.col("doc_id")).alias("held_out"), "text_bad", "text_toxic", rate["bad"][0].alias("host_rate"), rate["bad"][1].alias("path_rate"), posterior["bad"], posterior["toxic"]
    )
    return scored.withColumn("kept", fine)


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    quality_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """The input rows that the classifier keeps, with all their columns.

    Rows are judged by id and text: a good text stays where its id repeats with a bad one, and rows with a null id are judged like others.
    Rows that agree in both but not in host or path go together if any of them is rejected.
    """
    gone = _judged(docs, labels, id_col, text_col, host_col, path_col, quality_col, toxic_col).where("not kept").select("row_key")
    return without_rows(docs, gone, id_col, text_col)
