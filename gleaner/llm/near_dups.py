"""Near duplicates by an LSH forest: sorted orders of MinHash values, regions of adaptive depth, exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import prepare, runs_by_key, settle, texts
from gleaner.llm.components import connected_components
from gleaner.llm.wordhash import Words, mix, text_runs, windows
from gleaner.operators.ranking import global_position

TREES, LEVELS, FIRST_LEVEL = 16, 6, 3
REGION_ROWS, REGION_SHINGLES = 2048, 4_000_000
_STEPS = mix(np.arange(1, 2 * TREES * LEVELS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: from, to, the distinct shingles of all its texts (sorted inside each), and where each text's begin.

    Texts are ASCII-lowered. A text with fewer than ``size`` words has its whole word sequence as its one shingle; one without words has none.
    """
    for low, high, data, offsets in text_runs(column):
        words = Words(data, offsets, lower=True)
        numbers = words.numbers()
        at, value = windows(numbers, words.first, size)
        owner = np.searchsorted(words.first, at, side="right") - 1
        counts = np.diff(words.first)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            whole = [windows(numbers[words.first[k] : words.first[k + 1]], np.array([0, counts[k]]), int(counts[k]))[1][0] for k in short]
            owner, value = np.concatenate([owner, short]), np.concatenate([value, np.array(whole, np.uint64)])
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        yield low, high, value[new], np.searchsorted(owner[new], np.arange(high - low + 1))


def _set_keys(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that depend on the set alone."""
    keys = []
    for salt in (0x1234567, 0x89ABCDEF):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(salt)))]).astype(np.uint64)
        keys.append(mix(sums[begin[1:]] - sums[begin[:-1]] + np.diff(begin).astype(np.uint64)))
    return keys[0], keys[1]


def _signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over each set, as rows of unsigned 32-bit numbers; sets must not be empty."""
    out = np.empty((len(begin) - 1, TREES * LEVELS), np.uint32)
    for k in range(TREES * LEVELS):
        hashed = ((values ^ _STEPS[-1 - k]) * _STEPS[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(hashed, begin[:-1])
    return out


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, k1, k2, sig`` for each row: the size of its set, its 128-bit key and its signature (null for no words)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, values, begin in shingle_sets(batch.column("text"), size):
                counts = np.diff(begin)
                full = np.flatnonzero(counts)
                sigs: list = [None] * (high - low)
                if len(full):
                    for k, row in zip(full, _signatures(values, np.append(begin[full], begin[-1]))):
                        sigs[k] = row.tobytes()
                keys = _set_keys(values, begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(counts), *(pa.array(k.view(np.int64)) for k in keys), pa.array(sigs, pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "sig"],
                )

    rows = docs.select("doc_id", F.encode("text", "utf-8").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def _nodes(rows: DataFrame, level: int, trees: bool) -> DataFrame:
    """Tree nodes at a level: one row for each tree, or, below a node, one for each row with its ``tree``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, TREES, LEVELS)
            n = len(sigs)
            rep, size = (np.asarray(batch.column(c)) for c in ("rep", "n_shingles"))
            if trees:
                tree, at = np.tile(np.arange(TREES), n), np.repeat(np.arange(n), TREES)
            else:
                tree, at = np.asarray(batch.column("tree")), np.arange(n)
            key = tree.astype(np.uint64) + np.uint64(1)
            for d in range(level):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sigs[at, tree, d])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[at]), pa.array(size[at]), pa.array(tree.astype(np.int32)), pa.array(key.view(np.int64))], ["rep", "n_shingles", "tree", "node"]
            )

    return rows.mapInArrow(work, "rep long, n_shingles long, tree int, node long")


def regions(reps: DataFrame) -> DataFrame:
    """``region, rep``: documents with a common beginning in one of the sorted orders, as deep as the region is dense.

    Order ``t`` sorts documents by the ``t``-th run of MinHash values; neighbours by longest common prefix share a node of its prefix tree. All
    nodes start at level 3. A node of one document ends there; one of up to 2,048 documents (and 4 million shingles) is a region;
    a larger one is cut by the next value, in this order only, and so on. What is still larger at the last level is cut into
    parts, and each pair of parts is a region: no document is left out, and none meets more than is needed.
    """
    out, rows = None, _nodes(reps, FIRST_LEVEL, True)
    for level in range(FIRST_LEVEL, LEVELS + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s")).where("n > 1")
        members = settle(rows.join(sizes, "node"))
        large = (F.col("n") > REGION_ROWS) | (F.col("s") > REGION_SHINGLES)
        found = members.where(~large).select(F.col("node").alias("region"), "rep")
        out = found if out is None else out.unionByName(found)
        deep = members.where(large)
        if deep.isEmpty():
            return out
        if level < LEVELS:
            rows = _nodes(deep.select("rep", "tree").join(reps, "rep"), level + 1, False)
    parts = F.greatest(F.ceil(F.col("n") * 2 / REGION_ROWS), F.ceil(F.col("s") * 2 / REGION_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("rep", "node"), F.col("parts")).cast("int")
    pairs = deep.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    cut = pairs.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "rep")
    return out.unionByName(cut)


def _merge(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member that each of ``n`` members is linked with, over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            return root


def _job_name(ids: np.ndarray) -> int:
    return int(mix(np.array([mix(ids.view(np.uint64)).sum() + np.uint64(len(ids))], np.uint64)).view(np.int64)[0])


def _jobs(members: DataFrame, percent: int) -> DataFrame:
    """``job, rep``: inside each region, the documents that promising pairs connect. Equal jobs of several regions have one name.

    A pair is promising if its signatures agree in a share that is at most five standard deviations below the threshold.
    """
    s = percent / 100
    least = (s - 5 * math.sqrt(s * (1 - s) / (TREES * LEVELS))) * TREES * LEVELS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jobs, reps = [], []
        for table in runs_by_key(batches, "region"):
            ids = table.column("rep").to_numpy()
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
            left, right = [], []
            for k in range(len(ids) - 1):
                hits = k + 1 + np.flatnonzero((sigs[k + 1 :] == sigs[k]).sum(axis=1) >= least)
                left.append(np.full(len(hits), k))
                right.append(hits)
            root = _merge(len(ids), np.concatenate(left), np.concatenate(right))
            order = np.argsort(root, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
                if len(group) > 1:
                    jobs += [_job_name(ids[group])] * len(group)
                    reps += ids[group].tolist()
            if len(jobs) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(jobs, pa.int64()), pa.array(reps, pa.int64())], ["job", "rep"])
                jobs, reps = [], []
        yield pa.RecordBatch.from_arrays([pa.array(jobs, pa.int64()), pa.array(reps, pa.int64())], ["job", "rep"])

    return members.repartition("region").sortWithinPartitions("region").mapInArrow(work, "job long, rep long").distinct()


def _links_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the sets whose intersection is at least ``percent`` of their union, by products of their incidence matrix."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, index = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.flatnonzero(np.bincount(index) > 1)
    place = np.full(index.max() + 1 if len(index) else 0, -1)
    place[shared] = np.arange(len(shared))
    place = place[index]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for at in range(0, len(shared), 4096):
        low, high = np.searchsorted(place, (at, at + 4096))
        part = np.zeros((len(sets), min(4096, len(shared) - at)), np.float32)
        part[owner[low:high], place[low:high] - at] = 1
        common += part @ part.T
    both = common.astype(np.int64)
    hit = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    return np.nonzero(np.triu(hit, 1))


def _confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """``rep, root``: for each document of a job that true links connect with others, the smallest of those."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_by_key(batches, "job"):
            ids = table.column("rep").to_numpy()
            order = np.argsort(ids)
            blobs = table.column("shingles").to_pylist()
            root = _merge(len(ids), *_links_of([np.frombuffer(blobs[k], np.uint64) for k in order], percent))
            away = np.flatnonzero(root != np.arange(len(ids)))
            if len(away):
                yield pa.RecordBatch.from_arrays([pa.array(ids[order][away]), pa.array(ids[order][root[away]])], ["rep", "root"])

    return rows.repartition("job").sortWithinPartitions("job").mapInArrow(work, "rep long, root long")


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``rep, shingles`` of the wanted representatives, read from their texts once more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, values, begin in shingle_sets(batch.column("text"), size):
                blobs = [values[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]
                keys = _set_keys(values, begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").slice(low, high - low), *(pa.array(k.view(np.int64)) for k in keys), pa.array(blobs, pa.binary())], ["rep", "k1", "k2", "shingles"]
                )

    rows = docs.join(wanted, docs["doc_id"] == wanted["rep"]).select("rep", F.encode("text", "utf-8").alias("text"))
    sets = rows.mapInArrow(work, "rep long, k1 long, k2 long, shingles binary")
    # A repeated id may bring other texts; the key tells which is meant.
    return sets.join(wanted, ["rep", "k1", "k2"], "left_semi").dropDuplicates(["rep"]).select("rep", "shingles")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Texts are ASCII-lowered and cut to words at ASCII white space; a text's set is its distinct runs of ``shingle`` words. Two documents are
    linked where their sets' intersection is at least ``percent`` percent of the union. ``component_id`` is the smallest id reachable
    over links, ``kept`` is true on that document.

    Documents with equal sets are one class, found by a 128-bit key of the set, and only its smallest id goes on, so thousands of copies
    are one row. Candidates come from an LSH forest of 16 orders of 6 MinHash values (``regions``). Two documents at the threshold share a
    region with a probability of 1 - 1e-6 for 85 percent and 1 - 1e-5 for 80 where regions stay at level 3, more above the threshold.
    Inside a region promising pairs are compared by signature, and the documents they connect are confirmed together on their full
    sets: all pairs of a job are decided inside one task by matrix products, and only each document's smallest linked partner leaves it. No
    pair table is ever written.

    Null and empty texts and texts without words have an empty set and are linked with nothing. Repeated rows are one class with the same
    id; all of them are ``kept`` if their id is the component's. Rows with a null id get no component and are not kept. An id that
    repeats with several texts stands for one of them where links are confirmed; ``keep_one_of_each`` numbers such rows first. An empty
    table gives no rows. Extra columns are not read.
    """
    prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    sketched = settle(sketch(rows, shingle))
    known = sketched.where("n_shingles > 0 and doc_id is not null")
    smallest = known.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("r"))
    reps = settle(smallest.select(F.col("r.doc_id").alias("rep"), "k1", "k2", F.col("r.n_shingles").alias("n_shingles"), F.col("r.sig").alias("sig")))
    jobs = settle(_jobs(regions(reps.select("rep", "n_shingles", "sig")).join(reps.select("rep", "sig"), "rep"), percent))
    wanted = reps.select("rep", "k1", "k2").join(jobs.select("rep").distinct(), "rep")
    sets = _sets_of(rows, wanted, shingle)
    components = connected_components(_confirmed(jobs.join(sets, "rep"), percent))
    named = reps.select("rep", "k1", "k2").join(components.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("class"))
    linked = sketched.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("class", "doc_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return linked.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that no smaller id is reachable from, with all their columns.

    Where ids are null or repeat with several texts, rows are numbered by id and digest of the text first, null ids last, and take part by these
    numbers: each text is judged by itself. Else the ids serve, which saves that pass.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    by_id = rows.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    if by_id.where("id IS NULL OR low <> high").isEmpty():
        away = near_duplicates(docs, shingle, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_away"))
        return docs.join(away.distinct(), F.col(id_col).cast("long") == F.col("_away"), "left_anti")
    numbers = settle(global_position(rows.select("id", "digest").distinct(), [F.col("id").asc_nulls_last(), "digest"], "number"))
    known = numbers.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "number")
    numbered = rows.join(known, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select("number", "text")
    away = near_duplicates(numbered, shingle, percent, "number", "text").where("not kept").select("doc_id").distinct()
    gone = numbers.join(away, F.col("number") == F.col("doc_id"), "left_semi").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    marked = docs.withColumn("_text_digest", F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_digest") == F.col("_digest"))
    return marked.join(gone, same, "left_anti").drop("_text_digest")
