"""Which names a text mentions, by an index from each name's rarest gram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.staging import settled
from gleaner.session import write_table

#: Letters of a gram at least; a shorter name is one gram.
GRAM = 5
#: Letters of an index that Spark may send to all tasks. It measures the file, which repeated letters make a small part of what the driver
#: would hold; a longer index is joined by shuffles. Names that Spark takes for more bytes than these are first looked up in the texts' marks.
SENT_LETTERS = 1_000_000
#: Bits of a table of marks, 64 to a word: one megabyte, whatever is marked. A power of two.
MARKS = 1 << 23
#: Places of a text that are cut out together, as finding a letter takes a walk from the first one.
STRETCH = 64


def _windows(text: Column, wide: int = GRAM) -> Column:
    """The letters from each place on, ``wide`` at most, each run once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{wide}}}))"), F.lit(1)))


def _places(texts: DataFrame, least: int, most: int) -> DataFrame:
    """A row for each place of each text that ``least`` letters or more start at, ``window`` for the place takes ``most`` at most. Other columns stay."""
    kept = [name for name in texts.columns if name != "text"]
    long_enough = texts.filter(F.length("text") >= least).withColumn("_places", F.length("text") - (least - 1))
    starts = long_enough.select(*kept, "text", "_places", F.explode(F.expr(f"sequence(0, _places - 1, {STRETCH})")).alias("_start"))
    cut = starts.select(*kept, F.expr(f"substring(text, _start + 1, {STRETCH + most - 1})").alias("_cut"), F.expr(f"least(_places - _start, {STRETCH})").alias("_size"))
    return cut.select(*kept, "_cut", F.explode(F.expr("sequence(1, _size)")).alias("_at"))


def _window(letters: int) -> Column:
    """The letters from a row's place on."""
    return F.substring(F.col("_cut"), F.col("_at"), F.lit(letters))


def _marks(gram: Column) -> list[Column]:
    """Two bits from one hash."""
    return [F.xxhash64(gram).bitwiseAND(MARKS - 1), F.shiftright(F.xxhash64(gram), 32).bitwiseAND(MARKS - 1)]


def mark_table(grams: DataFrame) -> DataFrame:
    """One row ``words`` with two bits set for each gram. Its size is fixed; the more grams, the more others have both bits set by chance."""
    marks = grams.select(F.explode(F.array(*_marks(F.col(grams.columns[0])))).alias("mark"))
    bits = marks.select(F.expr("shiftright(mark, 6)").alias("word"), F.expr("shiftleft(1L, cast(mark & 63 as int))").alias("bits"))
    empty = grams.sparkSession.range(MARKS // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return write_table(words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w.bits).alias("words")))


def is_marked(gram: Column, marks: DataFrame) -> Column:
    """True for every gram in the table, and for few others while it is not full."""
    one, two = (F.getbit(F.get(marks.scalar(), F.shiftright(m, 6).cast("int")), m.bitwiseAND(63).cast("int")) == 1 for m in _marks(gram))
    return one & two


def mention_index(names: DataFrame, name: str = "lname", place: str = "place") -> DataFrame:
    """``gram, lname, place``: each distinct name once, with its smallest place, under the gram of it that the fewest names have.

    A name has all its grams of ``GRAM`` letters, or itself if it is shorter; of equally rare grams the first in order counts. From 10,000
    names on, grams have one letter more than their number has digits, so that a gram stays with few names. Empty names are left out.
    """
    distinct = write_table(names.filter(F.col(name) != "").groupBy(F.col(name).alias("lname")).agg(F.min(place).alias("place")))
    letters = max(GRAM, len(str(distinct.count())) + 1)
    wide = F.least(F.length("lname"), F.lit(letters))
    grams = distinct.select("lname", F.explode(F.filter(_windows(F.col("lname"), letters), lambda g: F.length(g) == wide)).alias("gram"))
    sizes = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    # Merge joins, as derived letters are many times the size of the file that Spark takes them for.
    rarest = grams.join(sizes.hint("merge"), "gram").groupBy("lname").agg(F.min(F.struct("names", "gram")).alias("rarest"))
    return distinct.join(rarest.hint("merge"), "lname").select(F.col("rarest.gram").alias("gram"), "lname", "place")


def _met(names: DataFrame, name: str, texts: DataFrame) -> DataFrame:
    """The names of which up to five grams of ``GRAM`` letters, first, last and between, are marked as some text's, and those shorter than a gram."""
    marks = mark_table(_places(texts.select("text"), GRAM, GRAM).select(_window(GRAM)))
    # The last one first: most names that no text holds go there. Each is settled apart, as one condition of all would be too long to compile.
    for part in (4, 0, 2, 1, 3):
        gram = F.expr(f"substring({name}, 1 + cast((length({name}) - {GRAM}) * {part} / 4 as int), {GRAM})")
        names = settled(names, {name: F.col(name)}).filter((F.length(name) < GRAM) | is_marked(gram, marks))
    return names


def first_mention(texts: DataFrame, names: DataFrame, name: str = "lname", place: str = "place") -> DataFrame:
    """``key, place``: the smallest place of a name that the text of the key contains; keys whose text names nothing are left out.

    ``texts`` holds ``key`` and ``text``; rows of a key have the same text. A text that contains a name contains the name's rarest gram, so
    joining the grams of a text with the index misses nothing and finds little else; what it finds is verified in the text. Many names,
    by Spark's estimate, are cut to those of which some grams are in texts before they are indexed, and the grams of a text to those that the index
    has before they are joined: both by a table of marks of a fixed size, which lets some others pass and misses none. The index is a table
    with a row per name, sent to all tasks while it is small by Spark's measure and holds at most ``SENT_LETTERS``, and joined by gram, with
    frequent grams split, when it is not or names are many. Only the lengths of its grams and its letters, a few numbers, and the marks go
    to the driver.
    """
    many = names._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SENT_LETTERS
    index = write_table(mention_index(_met(names, name, texts) if many else names, name, place))
    lengths, letters = index.agg(F.sort_array(F.collect_set(F.length("gram"))), F.sum(F.length("lname") + F.length("gram"))).first()
    if not lengths:
        return texts.select("key", F.lit(None).cast(names.schema[place].dataType).alias("place")).limit(0)
    # The beginnings of grams have marks of their own, so that one look-up ends most places.
    shortest, wide = lengths[0], lengths[-1]
    begun, marks = mark_table(index.select(F.left("gram", F.lit(shortest)))), mark_table(index.select("gram"))
    texts = texts.dropDuplicates(["key"])
    starts = _places(texts, shortest, wide).filter(is_marked(_window(shortest), begun))
    cut = [F.when((F.length("window") >= n) & is_marked(F.substring("window", 1, n), marks), F.substring("window", 1, n)) for n in lengths]
    grams = settled(starts, {"window": _window(wide)}).select("key", F.explode(F.array(*cut)).alias("gram")).filter("gram IS NOT NULL").distinct()
    likely = grams.join(index.hint("merge") if many or letters > SENT_LETTERS else index, "gram").select("key", "lname", "place")
    return likely.join(texts.hint("merge"), "key").filter(F.contains("text", F.col("lname"))).groupBy("key").agg(F.min("place").alias("place"))
