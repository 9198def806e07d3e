"""The trie of all prefixes of conversations, by ROLLUP over columns that hold one turn each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import SPACES, prepare, settle
from gleaner.operators.running import running_before

#: Turns that a row holds as columns.
BLOCK = 4
#: Conversation ids that share all but these bits travel to the digest of a node as one row.
CHUNK_BITS = 10
_TRIM = "^" + SPACES + "|" + SPACES + "$"


def _count_words(text: Column) -> Column:
    trimmed = F.regexp_replace(text, _TRIM, "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def _marks(place: Column, turn: Column) -> tuple[Column, Column]:
    """128 bits of a turn at a place; their XOR over a prefix is the prefix's key."""
    return F.xxhash64(F.lit(1), place.cast("long"), turn), F.xxhash64(F.lit(2), place.cast("long"), turn)


def number_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, turn, words``: each turn's place from 0, a 128-bit digest of its role and text, and the words of the text.

    Turns are ordered by number, null first, ties by role and digest. Texts are read once and not shuffled.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in (role_col, text_col))
    # The length of the role keeps the border between role and text.
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where(F.col(conv_col).cast("long").isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("number"), role.alias("role"), digest.alias("turn"), _count_words(text).alias("words")
    )
    order = [F.col("number").asc_nulls_first(), F.col("role"), F.col("turn")]
    return running_before(turns, "conv_id", order, {"place": ("count", "turn", 0)}).select("conv_id", "place", "turn", "words")


def rebuild(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: ``(conv_id, place, turn, words)`` and ``(conv_id, length)``.

    Conversation c takes the first h turns of conversation c - c % ``family`` (all if it has fewer, none if there is no such), then its own
    without its first h; h is the unsigned CRC-32 of its decimal id, modulo ``heads``. At most ``heads`` - 1 turns of a family's first one are read.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select(
        "conv_id", "own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    )
    sizes = convs.where("conv_id = base").select(F.col("base").alias("_base"), F.col("own").alias("_size"))
    convs = settle(
        convs.join(sizes, F.col("base") == F.col("_base"), "left")
        .withColumn("taken", F.least("h", F.coalesce("_size", F.lit(0).cast("long"))))
        .select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("length"))
    )
    first = turns.where(F.col("place") < heads - 1).select(F.col("conv_id").alias("_base"), F.col("place"), "turn", "words")
    begin = convs.join(first, (F.col("base") == F.col("_base")) & (F.col("place") < F.col("h"))).select("conv_id", "place", "turn", "words")
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn", "words")
    return begin.unionByName(rest), convs.select("conv_id", "length")


def _blocks(turns: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """A row for each ``block`` turns of a conversation: ``t1, t2, ...``, the key of the prefix before them and its words.

    A conversation without turns has a first block without any.
    """
    empty = lengths.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(None).cast("struct<place:long,turn:binary,words:long>").alias("held"))
    rows = turns.select("conv_id", F.floor(F.col("place") / block).alias("block"), F.struct("place", "turn", "words").alias("held")).unionByName(empty)
    marks = [F.when(F.col("held").isNotNull(), mark).otherwise(F.lit(0).cast("long")) for mark in _marks(F.col("held.place"), F.col("held.turn"))]
    held = rows.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list("held")).alias("held"), *[F.bit_xor(mark).alias(f"own{i + 1}") for i, mark in enumerate(marks)],
        F.sum(F.coalesce("held.words", F.lit(0).cast("long"))).alias("own_words"),
    )
    before = {"key1": ("bit_xor", "own1", 0), "key2": ("bit_xor", "own2", 0), "before": ("sum", "own_words", 0)}
    run = running_before(held, "conv_id", [F.col("block")], before).join(lengths, "conv_id")
    return run.select(
        "conv_id", "block", "key1", "key2", "before", "length",
        F.col("key1").bitwiseXOR(F.col("own1")).alias("end1"), F.col("key2").bitwiseXOR(F.col("own2")).alias("end2"), (F.col("before") + F.col("own_words")).alias("words"),
        *[F.struct(F.get("held", F.lit(i))["turn"].alias("turn"), F.get("held", F.lit(i))["words"].alias("words")).alias(f"t{i + 1}") for i in range(block)],
    )


def _prefixes(blocks: DataFrame, block: int, sums: str) -> DataFrame:
    """All prefixes of all blocks at once, with ``sums`` over the conversations that begin with them.

    One ROLLUP over the turns of a block, within the key of what stands before it; ``grouping_id`` tells how many turns a group keeps. A
    block's own beginning is the end of the block before, so it counts for the first block only. Sets in which the last kept column holds
    no turn are conversations that ended earlier, and go.
    """
    turns = [f"t{i}" for i in range(1, block + 1)]
    found = blocks.sparkSession.sql(
        f"""SELECT block, key1, key2, before, {", ".join(turns)}, {block} - bit_count(grouping_id()) AS kept, {sums}
            FROM {{blocks}} GROUP BY block, key1, key2, before, ROLLUP({", ".join(turns)})""",
        blocks=blocks,
    )
    last = F.element_at(F.array(*turns), F.greatest(F.col("kept"), F.lit(1)).cast("int"))
    real = F.when(F.col("kept") == 0, F.col("block") == 0).otherwise(last["turn"].isNotNull())
    place = lambda i: F.col("block") * block + i
    keys = {}
    for n, name in enumerate(("key1", "key2")):
        for end, back in (("node", 0), ("parent", 1)):
            key = F.col(name)
            for i, turn in enumerate(turns):
                key = key.bitwiseXOR(F.when(F.col("kept") - back > i, _marks(place(i), F.col(turn)["turn"])[n]).otherwise(F.lit(0).cast("long")))
            keys[f"{end}{n + 1}"] = key
    so_far = F.col("before")
    for i, turn in enumerate(turns):
        so_far = so_far + F.when(F.col("kept") - 1 > i, F.col(turn)["words"]).otherwise(0)
    root = F.col("kept") == 0
    # The marks of columns that a set does not keep are never read, so the sums keep their own names.
    return found.where(real).select(
        "*", (place(0) + F.col("kept")).cast("long").alias("depth"), F.when(root, 0).otherwise(last["words"]).cast("long").alias("words"),
        so_far.alias("words_above"), *[key.alias(name) for name, key in keys.items()],
    ).drop(*turns, "block", "key1", "key2", "before", "kept")


def digest_ids(rows: DataFrame) -> DataFrame:
    """``node1, node2, ends_sha256``: SHA-256 of each node's decimal ids, ascending and joined by commas; ``rows``: ``node1, node2, conv_id``.

    SHA-256 reads its input in order, so the ids of a node end in one task, but as a stream: ids that share all but ten bits come as one text,
    sorted by Spark (which spills), and no more than a batch is in memory. A hot node costs that task one pass over its text.
    """
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    chunks = rows.groupBy("node1", "node2", chunk.alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for one, two, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (one, two) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (one, two), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _found(done)
        if node:
            yield _found([(*node, state.hexdigest())])

    def _found(done: list[tuple]) -> pa.RecordBatch:
        one, two, ends = zip(*done) if done else ((), (), ())
        return pa.record_batch([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(ends, pa.string())], names=["node1", "node2", "ends_sha256"])

    ordered = chunks.repartition("node1", "node2").sortWithinPartitions("node1", "node2", "chunk").select("node1", "node2", "ids")
    return ordered.mapInArrow(digest, "node1 long, node2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns``: ``conv_id, place, turn, words``, as ``number_turns`` gives them; ``lengths``: ``conv_id, length`` of all conversations, those without turns,
    too. A node is a distinct sequence of turns, named by depth and its smallest member.

    Conversations are cut into rows of ``block`` columns with a turn each, keyed by the prefix before them, so one ROLLUP sums all prefixes of
    all lengths together; copies meet map-side, and the root is a row per task. Sums over subtrees need no walk: each node belongs to its
    smallest member, and the nodes of a member are the last part of its path. So what a subtree holds is the sum over its members of
    what is theirs, less the part of the node's own smallest member above the node, and a second ROLLUP takes these sums.

    Prefixes are known by 128 bits of their turns and places. Ids are distinct in ``lengths``. Tables without conversations have no
    nodes, not even a root.
    """
    spark = turns.sparkSession
    prepare(spark)
    blocks = settle(_blocks(turns, lengths, block))
    at_end = blocks.where(F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / block) == F.col("block"))
    totals = at_end.select("conv_id", F.col("words").alias("total"), F.col("end1").alias("node1"), F.col("end2").alias("node2"))
    nodes = settle(_prefixes(blocks, block, "min(conv_id) AS conv_id, count(*) AS n_convs"))
    above = nodes.where("depth > 0").groupBy(F.col("parent1").alias("node1"), F.col("parent2").alias("node2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(above, ["node1", "node2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    owned = nodes.groupBy("conv_id").agg(F.sum("words").alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaf"))
    shares = settle(
        totals.join(owned, "conv_id", "left").select("conv_id", "total", "node1", "node2", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("owned", "leaf")])
    )
    weighed = blocks.drop("words").join(shares.select("conv_id", "total", "owned", "leaf"), "conv_id")
    sums = _prefixes(weighed, block, "sum(total) AS all_words, sum(owned) AS all_owned, sum(leaf) AS n_leaves").select("node1", "node2", "all_words", "all_owned", "n_leaves")
    parents = nodes.select(F.col("node1").alias("parent1"), F.col("node2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"))
    first = shares.select("conv_id", "total", "owned")
    ends = digest_ids(shares.select("node1", "node2", "conv_id"))
    found = nodes.join(sums, ["node1", "node2"]).join(ends, ["node1", "node2"], "left").join(first, "conv_id").join(parents, ["parent1", "parent2"], "left")
    # Words of all members from the node's turn on, less those of the distinct nodes.
    members = F.col("all_words") - F.col("n_convs") * F.col("words_above")
    distinct = F.col("all_owned") - F.col("words_above") + F.col("total") - F.col("owned")
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (members - distinct).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(
    conversations: DataFrame, block: int = BLOCK, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """The trie of the rebuilt conversations, see ``rebuild`` and ``prefix_trie``.

    Null roles and texts are empty; words are runs without ASCII white space. Turns with one number are ordered by role and digest of the
    text; repeated rows are turns of their own; turns without a number come first. Rows without a conversation id belong to none
    and are left out. A conversation whose own turns all go and whose family has no first one stays as a member of the root. An empty
    table gives no rows; other columns are not read.
    """
    turns = number_turns(conversations, conv_col, turn_col, role_col, text_col)
    return prefix_trie(*rebuild(settle(turns)), block)
