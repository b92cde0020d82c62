"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an equal line, or one within one edit (a character replaced, inserted or deleted), stands earlier in the corpus. Lines are
ordered by (document id, line number).

Variants. A line stands for itself and for what is left when one of its characters is deleted. Two lines of equal length are one
replacement apart if they agree after deletion at one and the same place, so that place is part of the variant's key; a longer line is
one insertion apart from a shorter one if a deletion turns it into the shorter line. Lines that share a key are neighbours as they stand,
so the earliest neighbour of a line is a minimum per key: groups of any size are aggregated, never paired. The neighbour found is then
confirmed by its edit distance.

Emitting all variants of all lines would write the square of their lengths. One edit leaves all pieces of a line but one as they are, so
lines are first hashed without each of their halves, then those that met another without each of their eighths, and variants are
emitted only inside an eighth outside of which two lines agree. No neighbour is lost on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import broadcast_below
from engram.session import cut_lineage

MIN_CHARS = 12          # shorter lines are never dropped: an edit changes too much of them
SMALL = 200_000         # rows of a table of ids that may be broadcast


def outside(line: Column, m: Column, i: int, pieces: int) -> Column:
    """Key of a line without piece i of `pieces`, counted for lines of m characters (its own length, or one less for the longer one)."""
    start, end = F.floor(m * i / pieces).cast("int"), F.floor(m * (i + 1) / pieces).cast("int")
    return F.xxhash64(m, F.lit(i), F.left(line, start), F.when(m > end, F.right(line, m - end)).otherwise(""))


def keys(line: Column, pieces: int) -> Column:
    """array<struct<m, i, key>>: for each piece and for both roles of a line, as the one of m and the one of m + 1 characters."""
    n = F.char_length(line)
    return F.array(*[F.struct(m.cast("int").alias("m"), F.lit(i).alias("i"), outside(line, m.cast("int"), i, pieces).alias("key")) for m in (n, n - 1) for i in range(pieces)])


def crowded(lines: DataFrame, pieces: int) -> DataFrame:
    """(a, b, m, i) of lines that share the key of all but piece i with another line. lines: (a, b, keys)."""
    rows = lines.select("a", "b", F.explode("keys").alias("k")).select("a", "b", "k.m", "k.i", "k.key")
    shared = rows.groupBy("key").agg(F.min(F.struct("a", "b")).alias("lo"), F.max(F.struct("a", "b")).alias("hi")).filter("lo <> hi").select("key")
    return rows.join(shared, "key", "left_semi").select("a", "b", "m", "i")


def variants(near: DataFrame, pieces: int) -> DataFrame:
    """(a, b, first, role, key): variants of a line inside the pieces where another line may differ.

    Role s: same place deleted; w: the line as it is; d: one character deleted, to meet a whole line."""
    n, m = F.char_length("line"), F.col("m")
    start, end = F.floor(m * F.col("i") / pieces).cast("int"), F.floor(m * (F.col("i") + 1) / pieces).cast("int")
    longer = n > m
    last = F.when(longer & (F.col("i") == pieces - 1), end).otherwise(end - 1)
    places = F.when(last >= start, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))
    at = near.withColumn("p", F.explode(places))
    without = F.concat(F.left("line", F.col("p")), F.substring(F.col("line"), F.col("p") + 2, n))
    cut = at.select("a", "b", "first", F.when(longer, "d").otherwise("s").alias("role"),
                    F.when(longer, F.xxhash64(F.lit("w"), without)).otherwise(F.xxhash64(F.lit("s"), F.col("p"), without)).alias("key"))
    whole = near.filter(~longer).select("a", "b", "first", F.lit("w").alias("role"), F.xxhash64(F.lit("w"), F.col("line")).alias("key"))
    return cut.unionByName(whole.dropDuplicates(["a", "b"]))


def neighbours(v: DataFrame) -> DataFrame:
    """(a, b, prior): the earliest place of a line that shares a key with line (a, b) and comes before it."""
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("first")))
    groups = v.groupBy("key").agg(least("s").alias("s"), least("w").alias("w"), least("d").alias("d"), F.count("*").alias("n")).filter("n > 1")
    met = v.join(groups.select("key", "s", "w", "d"), "key")
    other = F.when(F.col("role") == "s", F.col("s")).when(F.col("role") == "w", F.col("d")).otherwise(F.col("w"))
    return met.withColumn("prior", other).filter("prior < first").groupBy("a", "b", "first").agg(F.min("prior").alias("prior"))


def inked(text: Column) -> Column:
    """Whether a text holds more than white space of any kind."""
    return text.rlike(r"(?U)\S")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, no, line) of the documents that have an id; th tells rows of one id and different texts apart."""
    return docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("no", "line"))


def exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(at struct<id, th, no>, line): the lines of MIN_CHARS characters or more."""
    at = lines_of(docs, id_col, text_col)
    return at.filter(F.char_length(F.trim("line")) >= MIN_CHARS).select(F.struct("id", "th", "no").alias("at"), "line")


def dropped_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, no) of every line that goes."""
    name = [F.xxhash64("line").alias("a"), F.xxhash64(F.reverse("line"), F.crc32(F.col("line").cast("binary"))).alias("b")]
    lines = exploded(docs, id_col, text_col)
    found = lines.select("at", *name, keys(F.col("line"), 2).alias("keys"))
    places = cut_lineage(found.select("at", "a", "b"))
    classes = found.groupBy("a", "b").agg(F.min("at").alias("first"), F.first("keys").alias("keys"))
    classes = cut_lineage(classes.withColumn("keys", F.transform("keys", lambda k: F.struct(k["m"].alias("m"), k["i"].alias("i"), k["key"].alias("key")))))
    halves = cut_lineage(crowded(classes, 2).select("a", "b").distinct().join(classes.select("a", "b", "first"), ["a", "b"]))
    # texts of the lines that may have a neighbour, read again where they first stand
    wanted = broadcast_below(halves.select(F.col("first").alias("at"), "a", "b"), SMALL)
    texts = cut_lineage(lines.join(wanted, "at").dropDuplicates(["a", "b"]).select("a", "b", F.col("at").alias("first"), "line"))
    eighths = crowded(texts.select("a", "b", keys(F.col("line"), 8).alias("keys")), 8).distinct()
    near = eighths.join(texts, ["a", "b"])
    prior = neighbours(variants(near, 8))
    # the edit distance confirms what equal keys say
    pair = (prior.join(texts.select("a", "b", "line"), ["a", "b"])
            .join(texts.select(F.col("first").alias("prior"), F.col("line").alias("before")), "prior"))
    close = pair.filter(F.levenshtein("line", "before", 1).between(0, 1)).select("a", "b").withColumn("close", F.lit(True))
    marks = classes.select("a", "b", "first").join(close, ["a", "b"], "left")
    # a class without copies and without a neighbour has nothing to drop
    gone = places.join(marks, ["a", "b"]).filter((F.col("at") != F.col("first")) | F.col("close"))
    return gone.select("at.id", "at.th", "at.no").distinct()


def gone_by_document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, __gone): the numbers of the lines that go, by document."""
    return dropped_lines(docs, id_col, text_col).groupBy("id", "th").agg(F.collect_set("no").alias("__gone"))


def cut(docs: DataFrame, id_col: str, text_col: str, marks: DataFrame) -> DataFrame:
    """docs without the lines in __gone of marks (id, th, __gone, ...), plus __lines, __dropped and the other columns of marks."""
    more = [c for c in marks.columns if c not in ("id", "th", "__gone")]
    marked = docs.withColumn("__th", F.xxhash64(text_col)).join(marks.withColumnsRenamed({"id": "__id", "th": "__th2"}),
                                                                 (F.col(id_col) == F.col("__id")) & (F.col("__th") == F.col("__th2")), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    stay = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: ~F.array_contains("__gone", i))
    kept = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(parts, i + 1)), "\n"))
    return (marked.withColumn("__lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long"))
            .withColumn("__dropped", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
            .withColumn(text_col, kept).select(*docs.columns, "__lines", "__dropped", *more))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with earlier-seen lines taken out of `text_col`, plus __lines and __dropped (counts).

    Texts are split at line feeds. Lines of fewer than MIN_CHARS characters (without outer spaces) stay wherever they stand. A null text
    stays null, an empty one empty; a row without id keeps its text and is compared with nothing. Equal rows (same id and text) are one
    document and stay equal. A text whose lines all go becomes empty; the row stays. Other columns are kept; an empty table stays empty.
    """
    return cut(docs, id_col, text_col, gone_by_document(docs, id_col, text_col))


def copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th) of the documents whose whole text, if it is more than white space, is the text of an earlier document."""
    at = docs.filter(F.col(id_col).isNotNull() & inked(F.col(text_col))).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.xxhash64(F.reverse(text_col), F.crc32(F.col(text_col).cast("binary"))).alias("b"))
    first = at.groupBy("th", "b").agg(F.min("id").alias("id"))
    return at.join(first, ["id", "th", "b"], "left_anti").select("id", "th").distinct()


def new_short_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th) of the documents that hold the first of the equal lines under MIN_CHARS; blank lines do not count."""
    short = lines_of(docs, id_col, text_col).filter((F.char_length(F.trim("line")) < MIN_CHARS) & inked(F.col("line")))
    return short.groupBy("line").agg(F.min(F.struct("id", "th")).alias("at")).select("at.id", "at.th").distinct()


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """dedup_lines without the documents that hold nothing new: exact copies of an earlier text, and documents that lose lines and are
    left with white space only, or with short lines only that all stand earlier too.

    A document with a short line that stands nowhere earlier stays with all its short lines. A document without any text before stays.
    """
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    # each part is written before they meet: one plan of all of them keeps the driver's memory full of plans and generated code
    gone, again, new = (cut_lineage(part(docs, id_col, text_col)) for part in (gone_by_document, copies, new_short_lines))
    marks = cut_lineage(gone.join(flag(again, "__copy"), ["id", "th"], "full").join(flag(new, "__new"), ["id", "th"], "full"))
    out = cut(docs, id_col, text_col, marks)
    long_left = F.exists(F.split(F.col(text_col), "\n", -1), lambda line: F.char_length(F.trim(line)) >= MIN_CHARS)
    new = (F.col("__dropped") == 0) | (inked(F.col(text_col)) & (long_left | F.col("__new").isNotNull()))
    return out.filter(F.col("__copy").isNull() & new).drop("__copy", "__new")
