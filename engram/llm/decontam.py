"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index holds postings (term, document, position) of training texts. Only terms that can decide a match are indexed: every term of the
test texts is counted over the corpus, and each window of test words is represented by its rarest terms (anchors). A posting of an
anchor, shifted by the anchor's offset in the test item, names the place where the item would begin; a window can only occur in a
document where the shifted lists of all its anchors meet. Places that survive this intersection are confirmed word by word.

Frequent terms are never anchors unless a window has no others, and then only windows made of them pay. Joins have the test side as the
small side, so a passage that sits in a third of all documents is not gathered by term; groups are (document, item, begin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engram.llm.common import broadcast_below
from engram.session import cut_lineage

# words after lower-casing A-Z: runs of digits, a-z and all characters beyond ASCII; the pattern also takes A-Z, which are lowered later.
# The separators are named one by one: Java keeps single characters of a class in a bit set and asks ranges one after another (24 times slower)
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANCHORS = 3             # terms that represent a window
SMALL = 500_000         # rows of a test-side table that may be broadcast (two or three longs each)


def lowered(word: Column) -> Column:
    """A-Z lower-cased and nothing else; `lower` does the same on pure ASCII and is faster."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(text: Column) -> Column:
    """Array of the words of a text as they stand, not lowered; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def term(word: Column) -> Column:
    return F.xxhash64(lowered(word))


def test_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, at, word, term, n): the words of the test items by position; n is the number of words of the item.

    `item` is the hash of a text, so rows that repeat an item id with another text are items of their own, and texts without an id are
    searched too. Test texts without words have no row."""
    texts = items.select(F.xxhash64(text_col).alias("item"), words(F.col(text_col)).alias("w")).dropDuplicates(["item"])
    return texts.select("item", F.posexplode("w").alias("at", "word"), F.size("w").alias("n")).select("item", "at", lowered(F.col("word")).alias("word"), term(F.col("word")).alias("term"), "n")


def windows(terms: DataFrame, width: int) -> DataFrame:
    """(item, start, len): windows of `width` consecutive words; an item of fewer words is one window."""
    ends = terms.select("item", "n").distinct()
    return ends.select("item", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - width, F.lit(0)))).alias("start"), F.least("n", F.lit(width)).alias("len"))


def document(id_col: str, text_col: str) -> Column:
    """Key of a document: its id, which may be null or repeated, and a hash of its text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).alias("doc")


def tallied(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(doc, term, n) in one scan: how often each wanted term stands in the corpus (doc null), and how many words each document has (term null).

    A null word behind the last one carries the length of its document."""
    at = docs.select(document(id_col, text_col), F.posexplode(F.concat(words(F.col(text_col)), F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    at = at.select("doc", "pos", F.when(F.col("word").isNotNull(), term(F.col("word"))).alias("term"))
    wanted = broadcast_below(wanted.select(F.col("term").alias("want")).unionByName(wanted.sparkSession.range(1).select(F.lit(None).cast("long").alias("want"))), SMALL)
    return (at.join(wanted, F.col("term").eqNullSafe(F.col("want")), "left_semi")
            .groupBy(F.when(F.col("term").isNull(), F.col("doc")).alias("doc"), "term").agg(F.count("*").alias("df"), F.max("pos").cast("long").alias("n"))
            .select("doc", "term", F.when(F.col("term").isNull(), F.col("n")).otherwise(F.col("df")).alias("n")))


def postings(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(term, doc, pos) of the wanted terms, at most SMALL of which are broadcast."""
    at = docs.select(document(id_col, text_col), F.posexplode(words(F.col(text_col))).alias("pos", "word")).select("doc", "pos", term(F.col("word")).alias("term"))
    return at.join(broadcast_below(wanted, SMALL), "term", "left_semi")


def anchors(terms: DataFrame, counts: DataFrame, spans: DataFrame) -> DataFrame:
    """(item, start, len, at, term, rank): the rarest terms of each window whose terms all occur in the corpus."""
    places = spans.withColumn("at", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)))
    inside = places.join(terms.select("item", "at", "term").join(counts, "term"), ["item", "at"])
    own = W.partitionBy("item", "start")
    rank = F.row_number().over(own.orderBy("df", "at"))
    return (inside.withColumn("all", F.count("*").over(own)).filter("all = len").withColumn("rank", rank)
            .filter(F.col("rank") <= ANCHORS).select("item", "start", "len", "at", "term", "rank"))


def begins(index: DataFrame, chosen: DataFrame, slop: int = 0) -> DataFrame:
    """(doc, item, start, len, begin, near): intersection of the offset-adjusted lists of each window's anchors.

    `begin` is the position where the item's first word would stand. With slop = 0 the lists must meet exactly. With slop > 0 also
    windows whose anchors all stand within `slop` of where the rarest one puts them are returned, marked `near`."""
    points = chosen.select("item", "at", "term").distinct()
    lists = index.join(broadcast_below(points, SMALL), "term").select("doc", "item", "at", (F.col("pos") - F.col("at")).alias("begin"))
    need = chosen.groupBy("item", "start", "len").agg(F.collect_set("at").alias("need"), F.min_by("at", "rank").alias("lead"))
    if slop == 0:
        met = lists.groupBy("doc", "item", "begin").agg(F.collect_set("at").alias("have"))
        least = need.groupBy("item").agg(F.min(F.size("need")).alias("least"))
        met = met.join(broadcast_below(least, SMALL), "item").filter(F.size("have") >= F.col("least"))
        spans = need.groupBy("item").agg(F.collect_list(F.struct("start", "len", "need")).alias("spans"))
        got = met.join(broadcast_below(spans, SMALL // 100), "item").select("doc", "item", "begin", "have", F.explode("spans").alias("s"))
        return (got.filter((F.size(F.array_except("s.need", "have")) == 0) & (F.col("begin") + F.col("s.start") >= 0))   # not before the text
                .select("doc", "item", "s.start", "s.len", "begin", F.lit(False).alias("near")))
    # each list entry also stands for the begins within the slop around it
    spread = lists.select("doc", "item", "at", "begin", F.explode(F.sequence(F.col("begin") - slop, F.col("begin") + slop)).alias("b"))
    met = spread.groupBy("doc", "item", "b").agg(F.collect_set("at").alias("have"), F.collect_set(F.when(F.col("begin") == F.col("b"), F.col("at"))).alias("exact"))
    got = met.join(broadcast_below(need, SMALL), "item").filter((F.size(F.array_except("need", "have")) == 0) & F.array_contains("exact", F.col("lead")) & (F.col("b") + F.col("start") >= 0))
    return got.select("doc", "item", "start", "len", F.col("b").alias("begin"), (F.size(F.array_except("need", "exact")) > 0).alias("near"))


def search(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, width: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """(matches, (doc, n_words)); matches: (doc, item, start, len, begin, near)."""
    terms = cut_lineage(test_terms(items, item_col, item_text))
    tally = cut_lineage(tallied(docs, id_col, text_col, terms.select("term").distinct()))
    counts = tally.filter("term IS NOT NULL").select("term", F.col("n").alias("df"))
    chosen = cut_lineage(anchors(terms, counts, windows(terms, width)))
    index = cut_lineage(postings(docs, id_col, text_col, chosen.select("term").distinct()))
    found = cut_lineage(begins(index, chosen, slop))
    # confirm word by word; only documents with candidates are cut into words
    phrases = terms.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select("item", F.transform("w", lambda x: x["word"]).alias("test"))
    few = broadcast_below(found.select("doc").distinct(), SMALL)
    texts = docs.select(document(id_col, text_col), F.col(text_col).alias("text")).join(few, "doc", "left_semi").dropDuplicates(["doc"])
    per_doc = found.groupBy("doc").agg(F.collect_set(F.struct("item", "start", "len", "begin", "near")).alias("c"))
    have = texts.select("doc", F.transform(words(F.col("text")), lowered).alias("w")).join(per_doc, "doc")
    first = F.greatest(F.col("c.begin") + F.col("c.start") - F.when(F.col("c.near"), slop).otherwise(0), F.lit(0))
    reach = F.col("c.begin") + F.col("c.start") + F.col("c.len") + F.when(F.col("c.near"), slop).otherwise(0) - first
    placed = have.select("doc", F.explode("c").alias("c"), "w").select("doc", "c.*", first.cast("int").alias("first"), F.slice("w", first.cast("int") + 1, reach.cast("int")).alias("there"))
    placed = placed.join(broadcast_below(phrases, SMALL // 100), "item").withColumn("test", F.slice("test", F.col("start") + 1, F.col("len")))
    # word k of the window has to stand at most `slop` places from where it would stand in an exact match
    low = lambda k: F.greatest(F.col("begin") + F.col("start") + k - slop, F.lit(0))
    beside = lambda k: F.slice("there", (low(k) - F.col("first") + 1).cast("int"), (F.col("begin") + F.col("start") + k + slop + 1 - low(k)).cast("int"))
    close = F.forall(F.sequence(F.lit(0), F.col("len") - 1), lambda k: F.array_contains(beside(k), F.element_at("test", k + 1)))
    sure = placed.filter(F.when(F.col("near"), close).otherwise(F.col("there") == F.col("test")) if slop else F.col("there") == F.col("test"))
    return sure.select("doc", "item", "start", "len", "begin", "near").distinct(), tally.filter("term IS NULL").select("doc", F.col("n").alias("n_words"))


def matches(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, width: int = 10, slop: int = 0) -> DataFrame:
    """(doc, th, item, start, len, begin, near): exact phrase matches (near = false), and with slop > 0 proximity matches (near = true).

    doc is the id and th the xxhash64 of the text, so rows that share an id or have none are told apart; item is the xxhash64 of the item's
    text. A phrase match is a window of `width` words that stands in the document at position begin + start. In a proximity match every
    word of the window stands at most `slop` positions from its place, the rarest one exactly there."""
    sure, _ = search(docs, id_col, text_col, items, item_col, item_text, width, slop)
    return sure.select("doc.id", "doc.th", "item", "start", "len", "begin", "near").withColumnRenamed("id", "doc")


def contamination(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, width: int = 10) -> DataFrame:
    """(id, n_words, n_hit, items, n_items, contaminated) per document: words inside occurrences of windows, and the ids of their items.

    Null and empty texts have no words and no hits, on either side; test items of fewer than `width` words are one window. Repeated
    item texts are found once and named by all their ids. An item without id is searched like the others: it has no name in `items`
    and counts as one in n_items. Rows that repeat a document id are judged by their own texts, rows with a null id too. Other columns
    are not read; empty tables give no hits.
    """
    hits, n_words = search(docs, id_col, text_col, items, item_col, item_text, width, 0)
    hits = cut_lineage(hits)
    names = items.select(F.xxhash64(item_text).alias("item"), F.col(item_col).cast("string").alias("name")).distinct()
    begin, end = F.col("begin") + F.col("start"), F.col("begin") + F.col("start") + F.col("len") - 1
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence(begin, end))))
    spans = hits.groupBy("doc").agg(F.size(covered).cast("long").alias("n_hit"))
    # one row per document and item before names are added
    named = (hits.select("doc", "item").distinct().join(broadcast_below(names, SMALL), "item").groupBy("doc")
             .agg(F.array_sort(F.collect_set("name")).alias("items"), F.max(F.col("name").isNull().cast("long")).alias("unnamed")))
    known = n_words.join(spans.join(named, "doc"), "doc", "left").withColumnRenamed("doc", "__doc")
    out = docs.select(id_col, document(id_col, text_col).alias("__at")).join(known, F.col("__at") == F.col("__doc"), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(id_col, F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), names.alias("items"),
                      (F.size(names) + F.coalesce("unnamed", F.lit(0))).cast("long").alias("n_items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
