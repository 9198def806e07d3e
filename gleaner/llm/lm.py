"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, over corpus-wide word counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import part_of, prepare, settle, texts, width
from gleaner.llm.wordhash import Words, text_runs

#: Outputs of the network: the end, the most frequent words, and groups of all other words.
FREQUENT, GROUPS = 960, 64
OUTPUTS = FREQUENT + GROUPS
VECTOR, NOISE, BATCH, RATE, ROUNDS = 32, 128, 512, 0.1, 2
#: Sum of squared slopes that a parameter starts with: its first steps are small, whatever the first slope.
START = 1e-6
END = np.uint64(0x5851F42D4C957F2D)
BLOCK_BYTES, MOST_BLOCK_BYTES = 4 << 20, 64 << 20
SCORED_TOKENS = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Documents the model does not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass
class Corpus:
    """What the model knows of the counts: sizes, the frequent words, and each group's share."""

    tokens: int
    distinct: int
    frequent: np.ndarray  # sorted hashes of the frequent words; the end is output 0
    output: np.ndarray  # their outputs
    group_sum: np.ndarray  # sum of count + 1 over the other words of each group, and one for unseen words
    noise: np.ndarray  # unigram distribution over the outputs


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and groups of all tokens of a run of texts, each text followed by its end; and where each text begins."""
    words = Words(data, offsets, lower=True)
    n = len(offsets) - 1
    at = np.arange(len(words.start)) + np.repeat(np.arange(n), np.diff(words.first))
    values = np.full(len(words.start) + n, END, np.uint64)
    values[at] = words.numbers()
    groups = np.zeros(len(values), np.uint8)
    last = words.data[words.end - 1].astype(np.uint32)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.uint32)
    groups[at] = ((last * 256 + before) * np.uint32(2654435761) >> np.uint32(26)).astype(np.uint8)
    return values, groups, words.first + np.arange(n + 1)


_SENT = "bucket int, block int, words binary, counts binary, groups binary"
_COUNTED = "kind int, block int, words binary, counts binary, groups binary, n long, v long, sums array<double>"


def _send(buckets: int):
    def send(table: pa.Table) -> pa.Table:
        """A block's distinct words by hash bucket, with their number among its training tokens and their group."""
        train = ~np.asarray(table.column("held_out").combine_chunks())
        values, weights, groups = [], [], []
        for low, high, data, offsets in text_runs(table.column("text")):
            value, group, begin = _tokens(data, offsets)
            values.append(value)
            groups.append(group)
            weights.append(np.repeat(train[low:high], np.diff(begin)))
        distinct, first, inverse = np.unique(np.concatenate(values), return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(weights), len(distinct)).astype("<u4")
        group = np.concatenate(groups)[first]
        bucket = (distinct % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [order[cuts[b] : cuts[b + 1]] for b in range(buckets)]
        full = [b for b in range(buckets) if len(rows[b])]
        blobs = [[column[rows[b]].tobytes() for b in full] for column in (distinct, counts, group)]
        block = table.column("block")[0].as_py()
        return pa.table([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], names=["bucket", "block", "words", "counts", "groups"])

    return send


def _count(table: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's words: answers to its blocks (kind 0), its most frequent words (1) and its sums (2)."""
    sent = [np.frombuffer(x, "<u8") for x in table.column("words").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
    groups = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("groups").to_pylist()])
    distinct, first, inverse = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
    total = np.bincount(inverse, counts, len(distinct)).astype("<i8")
    group = groups[first]
    word = distinct != END
    top = np.lexsort((distinct, -total))
    top = top[word[top] & (total[top] > 0)][: FREQUENT - 1]
    sums = np.bincount(group[word], (total + (total > 0))[word], GROUPS)
    answers = np.split(total[inverse].astype("<i8"), np.cumsum([len(s) for s in sent])[:-1])
    rows = [(0, b, w.tobytes(), c.tobytes(), None, None, None, None) for b, w, c in zip(table.column("block").to_pylist(), sent, answers)]
    rows.append((1, None, distinct[top].tobytes(), total[top].tobytes(), group[top].tobytes(), None, None, None))
    rows.append((2, None, None, None, None, int(total.sum()), int((total > 0).sum()), sums.tolist()))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["kind", "block", "words", "counts", "groups", "n", "v", "sums"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, counts, groups in zip(*(batch.column(c).to_pylist() for c in ("words", "counts", "groups"))):
            arrays = np.frombuffer(words, "<i8"), np.frombuffer(counts, "<i8"), np.frombuffer(groups, np.uint8).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["word", "count", "group"])


def _summary(counted: DataFrame) -> Corpus:
    """The driver's part: two totals, one sum per group, and the ``FREQUENT`` largest of the buckets' candidates."""
    sums = counted.where("kind = 2")
    n, v = sums.agg(F.sum("n"), F.sum("v")).first()
    per_group = {r["pos"]: r["s"] for r in sums.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}
    candidates = counted.where("kind = 1").select("words", "counts", "groups").mapInArrow(_frequent, "word long, count long, `group` int")
    top = candidates.orderBy(F.desc("count"), "word").limit(FREQUENT - 1).collect()
    group_sum = np.array([per_group.get(g, 0.0) for g in range(GROUPS)]) + 1.0
    noise = np.full(OUTPUTS, 1e-9)
    for k, row in enumerate(top):
        group_sum[row["group"]] -= row["count"] + 1
        noise[k + 1] = row["count"] + 1
    noise[FREQUENT:] = group_sum
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    noise[0] = max(1, (n or 0) / 500)
    return Corpus(n or 0, v or 0, words[order], order + 1, group_sum, noise / noise.sum())


def _code(corpus: Corpus):
    def code(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Texts as outputs of the network (two bytes a token), with what counts alone say about them."""
        known = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, "<u8") for x in answers.column("words").to_pylist())])
        count = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, "<i8") for x in answers.column("counts").to_pylist())])
        order = np.argsort(known)
        known, count = known[order], count[order]
        n_tokens, n_known, logs, rest, ids = [], [], [], [], []
        for _, _, data, offsets in text_runs(table.column("text")):
            values, groups, begin = _tokens(data, offsets)
            c = count[np.searchsorted(known, values)]
            out = (FREQUENT + groups.astype(np.int64)).astype("<u2")
            out[values == END] = 0
            if len(corpus.frequent):
                spot = np.minimum(np.searchsorted(corpus.frequent, values), len(corpus.frequent) - 1)
                hit = corpus.frequent[spot] == values
                out[hit] = corpus.output[spot[hit]]
            other = out >= FREQUENT
            share = np.where(other, np.log10((c + 1.0) / corpus.group_sum[groups]), 0.0)
            n_tokens += np.diff(begin).tolist()
            for target, column in ((n_known, c > 0), (logs, np.log10(c + 1.0)), (rest, share)):
                target += np.add.reduceat(column.astype(np.float64), begin[:-1]).tolist()
            ids += [out[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]
        size = math.log10(corpus.tokens + corpus.distinct + 1)
        base = np.array(logs) - size * np.array(n_tokens)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(np.array(n_known, np.int64)), "base_score": pa.array(base), "rest": pa.array(rest, pa.float64()), "ids": pa.array(ids, pa.binary()),
        })

    return code


_CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rest double, ids binary"


def _sums(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs that occur, and the rows of values added up for each."""
    order = np.argsort(index)
    begin = np.flatnonzero(np.diff(index[order], prepend=-1))
    return index[order[begin]], np.add.reduceat(values[order], begin, axis=0)


def _chance(score: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.negative(score, out=score)
    np.exp(score, out=score)
    score += 1
    return np.reciprocal(score, out=score)


class LogBilinear:
    """Predicts a token's vector as a sum of the two previous tokens' vectors, each weighted element by element; an output's score is
    its product with the prediction, plus a bias."""

    def __init__(self, noise: np.ndarray):
        draw = np.random.default_rng(7)
        self.noise = noise
        self.rows = draw.normal(0, 0.3, (OUTPUTS, VECTOR)).astype(np.float32)
        self.out = draw.normal(0, 0.05, (OUTPUTS, VECTOR)).astype(np.float32)
        self.bias = np.log(noise).astype(np.float32)
        self.mix = np.stack([np.full(VECTOR, 1.0), np.full(VECTOR, 0.5)]).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.rows, np.concatenate([self.out, self.bias[:, None]], axis=1), self.mix]

    def load(self, parts: list[np.ndarray]) -> None:
        self.rows, self.mix = parts[0].astype(np.float32), parts[2].astype(np.float32)
        self.out, self.bias = parts[1][:, :-1].astype(np.float32), parts[1][:, -1].astype(np.float32)

    def predict(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.rows[one] * self.mix[0] + self.rows[two] * self.mix[1]

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> int:
        """Noise-contrastive estimation with AdaGrad: tell each true token from noise tokens that its batch shares. Returns tokens seen."""
        draw = np.random.default_rng(seed)
        level = (np.log(self.noise) + math.log(NOISE)).astype(np.float32)
        cdf = np.cumsum(self.noise)
        past = [np.full(p.shape, START, np.float32) for p in (self.rows, self.out, self.bias, self.mix)]
        seen = 0
        for one, two, true in batches:
            n = len(true)
            seen += n
            fake = np.minimum(np.searchsorted(cdf, draw.random(NOISE)), OUTPUTS - 1)
            a, b = self.rows[one], self.rows[two]
            h = a * self.mix[0] + b * self.mix[1]
            right, wrong, shift = self.out[true], self.out[fake], self.bias - level
            with np.errstate(over="ignore"):
                up = _chance(-(np.einsum("ij,ij->i", h, right) + shift[true]))
                noise = h @ wrong.T
                noise += shift[fake]
                down = _chance(noise)
            dh = up[:, None] * right - down @ wrong
            at_rows, d_rows = _sums(np.concatenate([one, two]), np.concatenate([dh * self.mix[0], dh * self.mix[1]]))
            pull = np.concatenate([np.concatenate([up[:, None] * h, up[:, None]], axis=1), -np.concatenate([down.T @ h, down.sum(axis=0)[:, None]], axis=1)])
            at_out, d_out = _sums(np.concatenate([true, fake]), pull)
            d_mix = np.stack([(dh * a).sum(axis=0), (dh * b).sum(axis=0)])
            # Outputs that the batch does not touch keep their values.
            steps = ((self.rows, at_rows, d_rows, past[0]), (self.out, at_out, d_out[:, :-1], past[1]), (self.bias, at_out, d_out[:, -1], past[2]), (self.mix, [0, 1], d_mix, past[3]))
            for value, at, slope, total in steps:
                slope = slope / n
                squares = total[at] + slope * slope
                total[at] = squares
                value[at] += RATE * slope / np.sqrt(squares)
        return seen

    def log10(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of every token. Equal contexts are normalised once; a block of them is one matrix product."""
        one, two = contexts(ids, begin)
        pair, inverse = np.unique(one.astype(np.int64) * OUTPUTS + two, return_inverse=True)
        h = self.predict(pair // OUTPUTS, pair % OUTPUTS)
        norm = np.empty(len(pair), np.float32)
        for at in range(0, len(pair), 4096):
            scores = h[at : at + 4096] @ self.out.T + self.bias
            top = scores.max(axis=1)
            norm[at : at + 4096] = np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top
        found = np.empty(len(ids))
        for at in range(0, len(ids), 65_536):
            part = slice(at, at + 65_536)
            found[part] = np.einsum("ij,ij->i", h[inverse[part]], self.out[ids[part]]) + self.bias[ids[part]] - norm[inverse[part]]
        return found / math.log(10)


def contexts(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each; before a text stands the end."""
    out = []
    for back in (1, 2):
        before = np.zeros(len(ids), ids.dtype)
        before[back:] = ids[:-back]
        for k in range(back):
            at = begin[:-1] + k
            before[at[at < begin[1:]]] = 0
        out.append(before)
    return out[0], out[1]


def _train_round(coded: DataFrame, model: LogBilinear, number: int) -> None:
    """One round: every task trains a copy of the model on its documents of the round; the copies' mean, weighted by tokens, is the new model.

    The mean is a grouped sum over parameters, so the tasks' copies, whose number grows with the corpus, never meet in one place.
    """
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LogBilinear(shared.value.noise)
        own.load(shared.value.parts())
        draw = np.random.default_rng(number)

        def steps() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                blobs = batch.column("ids").to_pylist()
                begin = np.concatenate([[0], np.cumsum([len(x) // 2 for x in blobs])]).astype(np.int64)
                ids = np.frombuffer(b"".join(blobs), "<u2").astype(np.int64)
                one, two = contexts(ids, begin)
                order = draw.permutation(len(ids))
                for at in range(0, len(ids), BATCH):
                    pick = order[at : at + BATCH]
                    yield one[pick], two[pick], ids[pick]

        seen = own.train(steps(), number)
        if seen:
            for name, part in enumerate(own.parts()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(part), pa.int32()), pa.array(range(len(part)), pa.int32()), pa.array(part.astype(float).tolist(), pa.list_(pa.float64())), pa.array([seen] * len(part), pa.int64())],
                    ["name", "row", "vector", "seen"],
                )

    mine = coded.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(ROUNDS)) == number)).select("ids")
    copies = mine.mapInArrow(work, "name int, row int, vector array<double>, seen long").select("name", "row", "seen", F.posexplode("vector"))
    means = copies.groupBy("name", "row", "pos").agg((F.sum(F.col("col") * F.col("seen")) / F.sum("seen")).alias("value")).toArrow()
    if means.num_rows:
        parts = [p.copy() for p in model.parts()]
        name, row, pos, value = (means.column(c).to_numpy() for c in ("name", "row", "pos", "value"))
        for k, part in enumerate(parts):
            at = name == k
            part[row[at], pos[at]] = value[at]
        model.load(parts)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are ASCII-lowered words (between ASCII white space), then one end. The counts of all words over all training documents (those that
    are not ``held_out``) give ``base_score``, the add-one unigram log10 probability of the text, and ``n_known``, its tokens with a count.
    ``score`` is the log10 probability under a log-bilinear model with two words of context. Its outputs are the end, the 959 most
    frequent words and 64 groups of all other words (by their last two bytes); its probabilities over them are normalised exactly.
    Inside a group a word has its add-one share of the group's count; to have never been seen in training is one more event of count one
    in each group, as it is one in the base.

    Texts are dealt to blocks of 4 to 64 MB. A block sends each of its distinct words once, by hash bucket; a bucket adds up the counts and
    answers every block, so a word in every text costs one entry per block. Words are told apart by 64-bit hashes. Blocks are then coded
    to two bytes a token, in the shared folder; training and scoring read only that. Training passes over all training documents once, in two rounds of
    parallel training with averaged parameters. The driver holds the model (about 66,000 numbers), the frequent words and one sum per group.

    Null and empty texts are one end token. Rows with a null id are learned from and scored. Repeated rows count each. Without training
    documents all words are unseen. An empty table gives no rows. Extra columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = width(spark)
    blocks = max(1, math.ceil(total / MOST_BLOCK_BYTES), min(math.ceil(total / BLOCK_BYTES), 16 * buckets))
    dealt = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.encode("text", "utf-8").alias("text"), part_of("doc_id", "text", parts=blocks).alias("block")).groupBy("block")
    counted = settle(dealt.applyInArrow(_send(buckets), _SENT).groupBy("bucket").applyInArrow(_count, _COUNTED))
    corpus = _summary(counted)
    answers = counted.where("kind = 0").select("block", "words", "counts").groupBy("block")
    coded = settle(dealt.cogroup(answers).applyInArrow(_code(corpus), _CODED))
    model = LogBilinear(corpus.noise)
    for number in range(ROUNDS):
        _train_round(coded, model, number)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows and int(b.column("n_tokens").to_numpy().sum()) for b in held) >= SCORED_TOKENS:
                yield scored(held)
                held = []
        if held:
            yield scored(held)

    def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        begin = np.concatenate([[0], np.cumsum(table.column("n_tokens").to_numpy())]).astype(np.int64)
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<u2").astype(np.int64)
        found = np.add.reduceat(shared.value.log10(ids, begin), begin[:-1]) if len(ids) else np.zeros(0)
        columns = [table.column(c).combine_chunks() for c in names[:5]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(found + table.column("rest").to_numpy())], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    result = coded.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score")
