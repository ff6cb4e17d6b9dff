"""Line dedup by an exact set-similarity join on the lines' words.

Equal lines are one from the start. The words of a line are ordered by rarity: by their
count on a logarithmic scale, then by hash. Any order that is the same for all lines
gives the same result; this one keeps common words out of the prefixes. Two lines with
Jaccard similarity of SIMILARITY or more share at least SHARED words among their
prefixes, so lines are joined on prefix words only, filtered by length, by the words'
positions and by a parity bit for each of 64 classes of words, and verified.

The join runs thrice. At first each line meets its leads, the earliest lines of its MARKS,
hashes of a few of its words that similar lines often have in common, then WITNESSES lines
with the same lead. This settles the many variants of a line without pairing them with
each other. Lines not settled then meet all earlier lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stored, stored_by, under_safe_names

# Jaccard similarity from which lines count as the same: 4 / 5.
SIMILARITY = 0.8
SHARED = 3
# Words are counted by hash in so many buckets; STEPS ranks to a doubling of the count.
COUNTERS, STEPS = 1 << 18, 2.6
# A mark is made of so many words, those of least and of greatest hash and the next ones:
# rare words would not do, for the words of a line with many variants are not rare.
MARKED, MARKS = 3, (1, 4, -3, -6)
# In the second pass lines meet so many lines of each lead, chosen by hash.
WITNESSES = 16
_NO_ID = -(1 << 63)
_HASH_BITS = 56


def _words(line: Column) -> Column:
    return F.array_distinct(F.filter(F.split(line, f"[{SPACES}]+"), lambda w: w != ""))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``, different in every row, in order of doc_id, null first.

    It is doc_id itself where no two rows share one. Else rows are numbered and stored:
    those of one id, or of none, by the hash of their text.
    """
    doc = F.col("doc_id").cast("long")
    counts = docs.groupBy(doc.alias("id")).agg(F.count("*").alias("n"))
    if counts.where("n > 1").isEmpty():
        return docs.withColumn("_key", doc)
    # The place in the input spreads rows that are equal in all else.
    placed = docs.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.orderBy(doc.asc_nulls_first(), F.xxhash64(F.col("text").cast("string")), "_at")
    placed = placed.withColumn("_key", F.monotonically_increasing_id())
    return stored(placed.select(*docs.columns, "_key"), "line-rows")


class Places:
    """One number for every line, in order of rows' keys and then of lines.

    It is a long if keys and line numbers of these rows fit into one, else a decimal.
    A null key comes first.
    """

    def __init__(self, docs: DataFrame):
        breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
        least, most, lines = docs.agg(
            F.min("_key"), F.max("_key"), F.max(breaks)
        ).first()
        least, most = (0, 0) if least is None else (least, most)
        self.width = (lines or 0) + 1
        fits = (most - least + 2) * self.width < 1 << 63
        self.kind = "long" if fits else "decimal(38,0)"
        self.first = least - 1 if fits else _NO_ID - 1

    def document(self) -> Column:
        wide = F.col("_key").cast(self._step())
        return F.coalesce(wide - F.lit(str(self.first)).cast(self._step()), F.lit(0).cast(self._step()))

    def _step(self) -> str:
        return "long" if self.kind == "long" else "decimal(25,0)"

    def of(self, line_no: Column) -> Column:
        width = F.lit(self.width).cast("long" if self.kind == "long" else "decimal(12,0)")
        return (self.document() * width + line_no).cast(self.kind)

    def split(self, place: Column) -> tuple[Column, Column]:
        width = F.lit(self.width).cast("long" if self.kind == "long" else "decimal(12,0)")
        number = F.pmod(place, width)
        if self.kind == "long":
            # `/` divides doubles, which can fall short from 2^53 on.
            return F.call_function("div", place, width), number.cast("int")
        return ((place - number) / width).cast(self._step()), number.cast("int")


def distinct_lines(docs: DataFrame, places: Places) -> DataFrame:
    """``place`` of the first occurrence, and ``line``, of every line with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select("_key", F.posexplode(F.split(text, "\n")).alias("no", "line"))
    lines = lines.where(F.col("line").rlike(f"[^{SPACES}]"))
    lines = lines.select("line", places.of(F.col("no")).alias("place"))
    return lines.groupBy("line").agg(F.min("place").alias("place")).select("place", "line")


def _counter(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")


def _rarity(lines: DataFrame) -> bytearray:
    """The rank of every counter, 0 to 127, rare first; 0 only for a word found once."""
    # Every task sends on a count for most counters, so there are no more tasks than needed.
    n_tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = lines.select(F.explode(F.split("line", f"[{SPACES}]+")).alias("word")).coalesce(n_tasks)
    counts = words.groupBy(_counter(F.xxhash64("word")).alias("at")).agg(F.count("*").alias("n"))
    rank = F.least(F.floor(F.log2("n") * STEPS), F.lit(127)).cast("long")
    # A fixed number of counters, whatever the input.
    by_part = counts.groupBy((F.col("at") % 64).alias("part")).agg(
        F.collect_list(F.shiftleft(F.col("at").cast("long"), 7).bitwiseOR(rank)).alias("ranks")
    )
    ranks = bytearray(COUNTERS)
    for row in by_part.collect():
        for coded in row["ranks"]:
            ranks[coded >> 7] = coded & 127
    return ranks


def prefixes(lines: DataFrame, ranks: bytearray) -> DataFrame:
    """``place, size, words, odd, marks``: the rarest words of every line, rarest first.

    A word has its rank in the upper bits and its hash below; ``size`` is the number
    of words of the line. ``odd`` has a bit for each of 64 classes of words, set if the
    line has an odd number of words of that class: two lines differ in at most as many
    bits as in words.
    """
    table = F.lit(bytes(ranks))

    def key(hashed: Column) -> Column:
        rank = F.ascii(F.substring(table, _counter(hashed) + 1, F.lit(1)).cast("string"))
        low = hashed.bitwiseAND(F.lit((1 << _HASH_BITS) - 1))
        return F.shiftleft(rank.cast("long"), _HASH_BITS).bitwiseOR(low)

    words = F.filter(F.split("line", f"[{SPACES}]+"), lambda w: w != "")
    hashes = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))

    def toggled(bits: Column, word: Column) -> Column:
        place = F.shiftright(word, 40).bitwiseAND(F.lit(63)).cast("int")
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))

    odd = F.aggregate("words", F.lit(0).cast("long"), toggled)
    ordered = lines.select("place", F.sort_array(hashes).alias("hashes"))
    sized = ordered.select("place", "hashes", F.sort_array(F.array_distinct(F.transform("hashes", key))).alias("words"))
    sized = sized.select("place", "hashes", "words", F.size("words").alias("size"), odd.alias("odd"))
    # A slice that would begin before the first word is empty and makes no mark.
    parts = (F.slice("hashes", at, MARKED) for at in MARKS)
    marks = F.array_compact(F.array(*(F.when(F.size(part) > 0, F.xxhash64(part)) for part in parts)))
    words = F.slice("words", F.lit(1), _length("size")).alias("words")
    return sized.select("place", "size", words, "odd", F.array_distinct(marks).alias("marks"))


def _length(size: str) -> Column:
    """Words of the prefix: size - ceil(0.8 size) + SHARED, in whole numbers; a line may have fewer."""
    return (F.col(size) - F.ceil(F.col(size) * 4 / 5) + SHARED).cast("int")


def _may_match(table: DataFrame) -> DataFrame:
    """Lines with as many words that occur twice or more as a similar line must share."""
    least = F.least(F.lit(SHARED), F.ceil(F.col("size") * 4 / 5))
    return table.where(F.size(F.filter("words", _repeated)) >= least)


def _repeated(word: Column) -> Column:
    return F.shiftright(word, _HASH_BITS) > 0


def _short(word: Column) -> Column:
    """Enough of the hash to join on; words that fall together only add candidates."""
    return word.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def _rows(table: DataFrame) -> DataFrame:
    """``word, code, shape, odd``: prefix words that other lines may have too.

    ``code`` is the place of a line that is open, else -1 less the place; ``shape`` is
    the size of the line and the word's place in it.
    """
    rows = _may_match(table).select("code", "size", "odd", F.posexplode("words").alias("at", "word"))
    shape = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    # Told here, for the join would tell it of one side alone, and both would be shuffled.
    rows = rows.where(_repeated(F.col("word")) & F.col("code").isNotNull())
    return rows.select(_short(F.col("word")).alias("word"), "code", shape.alias("shape"), "odd")


def _near(size: Column, odd: Column, size_2: Column, odd_2: Column) -> Column:
    """Whether lines can be similar: those differ in at most a ninth of their words, so in
    no more bits, and neither is shorter than 0.8 of the other."""
    apart = 9 * F.bit_count(odd.bitwiseXOR(odd_2))
    return (apart <= size + size_2) & (5 * size >= 4 * size_2) & (5 * size_2 >= 4 * size)


def _earlier(one: str, other: str) -> Column:
    """Whether ``other`` is a line before ``one`` that can be similar; both are structs."""
    near = (F.col(f"{x}.{name}") for x in (one, other) for name in ("size", "odd"))
    return (F.col(f"{other}.place") < F.col(f"{one}.place")) & _near(*near)


def _led(table: DataFrame) -> DataFrame:
    """Lines and the earliest line of one of their marks, if they can be similar."""
    line = F.struct("place", "size", "odd")
    marked = table.select(line.alias("line"), F.explode("marks").alias("mark"))
    first = marked.groupBy("mark").agg(F.min("line").alias("lead"))
    return marked.join(first, "mark").where(_earlier("line", "lead")).select("line", "lead").distinct()


def _places(one: str, other: str) -> tuple[Column, Column]:
    return F.col(f"{one}.place").alias("a"), F.col(f"{other}.place").alias("b")


def _witnessed(led: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs of a line that is not settled and an earlier line with the same lead.

    Of each lead WITNESSES lines are met, so that the pairs grow with the lines alone.
    """
    lead = F.col("lead.place").alias("b")
    by_hash = Window.partitionBy("b").orderBy(F.xxhash64("other.place"), "other.place")
    some = led.select(lead, F.col("line").alias("other")).withColumn("rank", F.row_number().over(by_hash))
    some = some.where(F.col("rank") <= WITNESSES)
    open_ = led.join(settled, F.col("line.place") == F.col("a"), "left_anti").select(lead, "line")
    return open_.join(some, "b").where(_earlier("line", "other")).select(*_places("line", "other")).distinct()


def _overlap(size: str, size_2: str) -> Column:
    """Words that lines of these sizes must share: ceil(4 / 9 of the sum)."""
    return F.ceil((F.col(size) + F.col(size_2)) * 4 / 9)


def _candidates(rows: DataFrame) -> DataFrame:
    """Pairs of an open line and an earlier line that pass the filters.

    Both sides of the join have the same columns, so one shuffle serves both.
    """
    both = rows.alias("l").join(rows.alias("r"), "word")
    place = F.when(F.col("r.code") < 0, -1 - F.col("r.code")).otherwise(F.col("r.code"))
    both = both.where(F.col("l.code") > place)
    sides = ((F.shiftright(f"{x}.shape", 32), F.col(f"{x}.odd")) for x in "lr")
    both = both.where(_near(*next(sides), *next(sides)))
    low = F.lit((1 << 32) - 1)
    both = both.select(
        F.col("l.code").alias("a"),
        place.alias("b"),
        *(F.shiftright(f"{x}.shape", 32).alias(f"size_{y}") for x, y in ("la", "rb")),
        *(F.col(f"{x}.shape").bitwiseAND(low).alias(f"at_{y}") for x, y in ("la", "rb")),
    )
    rest = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    before = F.least("at_a", "at_b")
    fits = rest + before >= _overlap("size_a", "size_b")
    # Words of the prefix that ends first are in both prefixes or not shared at all, so
    # what the lines share is what the prefixes share and the rest of that line at most.
    beyond = F.greatest(*(F.col(size) - _length(size) for size in ("size_a", "size_b")), F.lit(0))
    overlap = _overlap("size_a", "size_b")
    least = F.greatest(F.least(F.lit(SHARED), overlap), overlap - beyond).cast("int")
    pairs = both.where(fits).groupBy("a", "b", least.alias("least")).agg(F.count("*").alias("n"))
    return pairs.where(F.col("n") >= F.col("least"))


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Places ``a`` that have a similar earlier line."""
    first = lines.select(F.col("place").alias("a"), F.col("line").alias("line_a"))
    second = lines.select(F.col("place").alias("b"), F.col("line").alias("line_b"))
    both = pairs.select("a", "b").join(first, "a").join(second, "b")
    words = F.struct(_words(F.col("line_a")).alias("x"), _words(F.col("line_b")).alias("y"))

    def alike(p: Column) -> Column:
        return 9 * F.size(F.array_intersect(p["x"], p["y"])) >= 4 * (F.size(p["x"]) + F.size(p["y"]))

    # Bound to a name, the words are split once for all three uses.
    similar = F.transform(F.array(words), alike)[0]
    return both.where(similar).select("a").distinct()


def similar_to_earlier(lines: DataFrame) -> DataFrame:
    """Places of distinct lines that are similar to an earlier one."""
    table = stored(prefixes(lines, _rarity(lines)), "line-prefixes")
    led = stored(_led(table), "line-led")
    first = stored(_verified(led.select(*_places("line", "lead")), lines), "line-settled")
    second = stored(_verified(_witnessed(led, first), lines), "line-settled")
    settled = first.union(second)
    joined = table.join(settled, F.col("place") == F.col("a"), "left")
    code = F.when(F.col("a").isNull(), F.col("place")).otherwise(-1 - F.col("place"))
    marked = joined.withColumn("code", code.cast(table.schema["place"].dataType))
    others = _verified(_candidates(_rows(marked)), lines)
    return settled.union(others)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and counts of lines.

    A line with a word goes if an equal line, or one whose set of words has a Jaccard
    similarity of 0.8 or more with its own, comes earlier: in an earlier line of the
    document or in a document of smaller doc_id, itself removed or not. Lines without a
    word stay. Adds ``n_lines`` and ``n_removed``, in place of columns of these names;
    all others, whatever their names, stay. A null text stays null; null ids come first. Every row is a document of
    its own: rows with the same doc_id, or without one, follow each other by the hash of
    their text. No row goes. Very long texts are split into lines like others.
    """
    docs = docs.drop("n_lines", "n_removed")
    return under_safe_names(docs, ("doc_id", "text"), _without_repeats)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """Like :func:`dedup_lines`, but with the columns of ``docs`` alone."""
    run = lambda rows: _without_repeats(rows).select(*rows.columns)
    return under_safe_names(docs, ("doc_id", "text"), run)


def _without_repeats(docs: DataFrame) -> DataFrame:
    columns, docs = docs.columns, keyed(docs)
    places = Places(docs)
    lines = stored_by(distinct_lines(docs, places), "lines", "place")
    gone = similar_to_earlier(lines)
    kept = lines.select("place").join(gone, F.col("place") == F.col("a"), "left_anti")
    doc, number = places.split(F.col("place"))
    kept = kept.groupBy(doc.alias("_doc")).agg(F.collect_list(number).alias("_kept"))
    joined = docs.withColumn("_key", places.document()).join(kept, F.col("_key") == F.col("_doc"), "left")
    joined = joined.withColumn("_lines", F.split(F.col("text").cast("string"), "\n"))
    blank = F.array_compact(
        F.transform("_lines", lambda line, i: F.when(~line.rlike(f"[^{SPACES}]"), i))
    )
    stay = F.sort_array(F.concat(F.coalesce("_kept", F.array().cast("array<int>")), blank))
    joined = joined.withColumn("_places", stay)
    text = F.array_join(F.transform("_places", lambda i: F.get("_lines", i)), "\n")
    n_lines = F.coalesce(F.size("_lines"), F.lit(0))
    return joined.select(
        *(F.when(F.col("text").isNotNull(), text).alias("text") if c == "text" else F.col(c) for c in columns),
        F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(n_lines - F.size("_places"), F.lit(0)).cast("long").alias("n_removed"),
    )
