"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans; labelers then vote on every proposal: the strict pattern with its checks, a gazetteer (mail domains, card
issuers, address blocks, dialling codes), the words in front, the characters around, and the form of the span. A labeler votes 1 or 0 or
abstains. Expectation maximisation over the counts of vote patterns estimates how reliable each labeler is, without any label. The
posteriors train the final classifier, a naive Bayes model over features of the span and its surroundings, and proposals it accepts are
spans. Spans of the strict patterns stay whatever it says.

What is gathered to the driver is the table of vote patterns, at most 4 kinds x 3^5 rows whatever the corpus.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engram.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# Base patterns. Possessive quantifiers stop Java from going back where going back cannot help, and a start inside a run of the same
# characters is skipped unless the run began at the end of the last match; both leave the matches as they are.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
# gazetteers and context words (fixed values)
DOMAINS = "com org net edu gov io info de fr es uk eu ch at it nl be us ca".split()
FOR_WORDS = {"email": "mail email contact write reach address", "ip": "ip host server address client from", "card": "card visa mastercard credit payment account",
             "phone": "phone tel call mobile fax contact whatsapp"}
AGAINST = "version v release nc token password key id sha hash isbn order section"
VOTES = ("strict", "gazetteer", "context", "around", "form")
CONTEXT = 32            # characters kept in front of a span
ACCEPT = 0.9            # probability from which a proposal that is no base span is taken


def proposals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, kind, base, s, e, hit, before, after): spans of all patterns with their places in code points, end exclusive.

    The text between two matches ends where the next begins, so places are running sums of lengths over the matches of a text; they are
    summed per text and pattern in a window. Only texts with a digit or an at sign are looked at."""
    text = F.col(text_col)
    found = []
    for base, patterns in ((True, BASE), (False, LOOSE)):
        for kind, p in patterns.items():
            gaps, hits = F.split(text, p, -1), F.regexp_extract_all(text, F.lit(p), F.lit(0))
            has = {"email": text.contains("@") if base else text.rlike(r"\x20at\x20|[\[(]at[\])]"), "phone": text.contains("+") if base else text.rlike("[0-9]{3}")}.get(kind, text.rlike("[0-9]"))
            zipped = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), F.slice(gaps, 2, 1 << 30).alias("next"))
            rows = F.transform(F.filter(zipped, lambda z: z["hit"].isNotNull()), lambda z: F.struct(
                z["hit"].alias("hit"), F.char_length(z["gap"]).alias("gap"), F.right(z["gap"], F.lit(CONTEXT)).alias("before"), F.left(z["next"], F.lit(8)).alias("after")))
            empty = F.array().cast("array<struct<hit:string,gap:int,before:string,after:string>>")
            found.append(F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.when(has, rows).otherwise(empty).alias("rows")))
    some = docs.filter(text.rlike(r"[0-9@]|\x20at\x20|[\[(]at[\])]")).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.explode(F.array(*found)).alias("f"))
    rows = some.select("id", "th", "f.kind", "f.base", F.posexplode("f.rows").alias("no", "r")).select("id", "th", "kind", "base", "no", "r.hit", "r.gap", "r.before", "r.after").distinct()
    run = W.partitionBy("id", "th", "kind", "base").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    n = F.char_length("hit")
    return rows.withColumn("e", F.sum(F.col("gap") + n).over(run)).select("id", "th", "kind", "base", (F.col("e") - n).alias("s"), "e", "hit", "before", "after")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Sum of the digits from the right, every second one doubled and cast out of nines, divides by ten."""
    n = F.char_length(d)
    def add(total, i):
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: Column, hit: Column) -> Column:
    """The checks of the base kinds."""
    d = digits(hit)
    part = lambda p: F.regexp_replace(p, "^0+", "")
    ip = F.forall(F.split(hit, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.coalesce(F.left(part(p), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    card = F.when(F.char_length(d).between(12, 19), luhn(d)).otherwise(False)
    return F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", F.char_length(d).between(9, 15)).otherwise(True)


def votes(spans: DataFrame) -> DataFrame:
    """Adds a column per labeler: 1, 0 or null."""
    kind, hit, d = F.col("kind"), F.col("hit"), digits(F.col("hit"))
    yes_no = lambda c: F.when(c, 1).otherwise(0)
    lead = F.lower("before")
    words = lambda ws: r"(?<![a-z])(?:" + "|".join(ws.split()) + r")[a-z]*[\s:=#\"'(]*(?:is\s+|at\s+)?$"
    context = F.when(lead.rlike(words(AGAINST)), 0)
    for k in KINDS:
        context = context.when((kind == k) & lead.rlike(words(FOR_WORDS[k])), 1)
    domain = F.lower(F.regexp_extract("hit", r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS)
    first = F.regexp_extract("hit", r"^0*([0-9]{1,3})", 1).try_cast("int")
    gazetteer = (F.when(kind == "email", yes_no(domain)).when(kind == "ip", yes_no(first.between(1, 223)))
                 .when(kind == "card", yes_no(F.left(d, F.lit(1)).isin("3", "4", "5", "6"))).when(kind == "phone", F.when(hit.startswith("+"), yes_no(~F.substring("hit", 2, 1).isin("0")))))
    around = yes_no(~F.col("before").rlike(r"[\p{L}\p{N}_=\"./-]$") & ~F.col("after").rlike(r"^(?:[\p{L}\p{N}_\"/@-]|\.[0-9])"))
    form = (F.when(kind == "email", yes_no(hit.rlike(r"^[A-Za-z0-9]") & (F.char_length("hit") <= 64))).when(kind == "ip", yes_no(~hit.rlike(r"(?:^|\.)0[0-9]")))
            .when(kind == "card", yes_no(hit.rlike(r"^(?:[0-9]{13,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$")))
            .when(kind == "phone", yes_no(hit.rlike(r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){1,4}$|^\+[0-9]{9,15}$"))))
    return spans.withColumns({"strict": yes_no(F.col("valid")), "gazetteer": gazetteer, "context": context, "around": around, "form": form})


def reliabilities(patterns: list[tuple], rounds: int = 40) -> dict[tuple, float]:
    """Posterior of each (kind, votes): expectation maximisation for a two-class model with a hit rate and a false-alarm rate per labeler
    and kind. patterns: (kind, votes, count)."""
    out = {}
    for kind in KINDS:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        prior, hit, false = 0.5, [0.8] * len(VOTES), [0.2] * len(VOTES)
        for _ in range(rounds):
            post = []
            for v, _ in rows:
                z = log(prior / (1 - prior)) + sum(log(h / f) if x else log((1 - h) / (1 - f)) for x, h, f in zip(v, hit, false) if x is not None)
                post.append(1 / (1 + exp(-max(min(z, 500), -500))))
            n1 = sum(p * n for p, (_, n) in zip(post, rows))
            n0 = sum((1 - p) * n for p, (_, n) in zip(post, rows))
            prior = (n1 + 1) / (n1 + n0 + 2)
            for j in range(len(VOTES)):
                voted = [(p, v[j], n) for p, (v, n) in zip(post, rows) if v[j] is not None]
                hit[j] = (sum(p * n * x for p, x, n in voted) + 4) / (sum(p * n for p, _, n in voted) + 5)
                false[j] = (sum((1 - p) * n * x for p, x, n in voted) + 1) / (sum((1 - p) * n for p, _, n in voted) + 5)
        out |= {(kind, v): p for p, (v, _) in zip(post, rows)} if rows else {}
    return out


def features() -> Column:
    """array<string>: what the classifier sees of a span; every feature takes a bounded number of values."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("hit", "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    bucket = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("string")
    last = F.lower(F.regexp_extract("before", r"(\w+)\W*$", 1))
    return F.array(F.concat(F.lit("shape"), bucket(shape, 256)), F.concat(F.lit("word"), bucket(last, 1024)),
                   F.concat(F.lit("before"), bucket(F.right("before", F.lit(1)), 64)), F.concat(F.lit("after"), bucket(F.left("after", F.lit(1)), 64)),
                   F.concat(F.lit("length"), F.least(F.char_length("hit"), F.lit(40)).cast("string")), F.concat(F.lit("valid"), F.col("valid").cast("string")),
                   *[F.concat(F.lit(v), F.coalesce(F.col(v).cast("string"), F.lit("-"))) for v in VOTES])


def classified(spans: DataFrame) -> DataFrame:
    """Adds `p`, the probability of the final classifier, to spans with votes."""
    spark = spans.sparkSession
    counts = spans.groupBy("kind", *VOTES).count().collect()     # at most 4 * 3^5 rows
    post = reliabilities([(r["kind"], tuple(r[v] for v in VOTES), r["count"]) for r in counts])
    code = F.concat_ws("", "kind", *[F.coalesce(F.col(v).cast("string"), F.lit("-")) for v in VOTES])
    known = [(k + "".join("-" if x is None else str(x) for x in v), p) for (k, v), p in post.items()]
    soft = spark.createDataFrame(known, "code string, y double")
    taught = spans.withColumn("code", code).join(F.broadcast(soft), "code").select("kind", "y", F.explode(features()).alias("f"))
    weight = taught.groupBy("kind", "f").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))   # a bounded number of features
    totals = taught.filter(F.col("f").startswith("valid")).groupBy("kind").agg(F.sum("y").alias("t1"), F.sum(1 - F.col("y")).alias("t0"))
    weight = weight.join(F.broadcast(totals), "kind").select("kind", "f", F.log((F.col("n1") + 0.5) / (F.col("t1") + 1)).alias("a"), F.log((F.col("n0") + 0.5) / (F.col("t0") + 1)).alias("b"),
                                                             F.log((F.col("t1") + 1) / (F.col("t0") + 1)).alias("prior"))
    table = weight.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("f", F.col("a") - F.col("b")))).alias("w"), F.first("prior").alias("prior"))
    z = F.aggregate(F.transform(features(), lambda f: F.coalesce(F.element_at("w", f), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return spans.join(F.broadcast(table), "kind", "left").withColumn("p", F.coalesce(1 / (1 + F.exp(-(F.col("prior") + z))), F.lit(0.0))).drop("w", "prior")


def pii_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, kind, base, s, e, hit, p): base spans and accepted proposals; a proposal that overlaps a base span of its text is left out.
    th is xxhash64 of the text, which tells rows of one id apart."""
    spans = proposals(docs, id_col, text_col).withColumn("valid", F.col("base") & passes(F.col("kind"), F.col("hit")))
    # strict matches that fail their checks are proposals no more; they still teach the labelers
    spans = cut_lineage(votes(spans))
    scored = cut_lineage(classified(spans).select("id", "th", "kind", F.col("valid").alias("base"), F.col("base").alias("pattern"), "s", "e", "hit", "p"))
    base = scored.filter("base")
    more = scored.filter(~F.col("base") & ~F.col("pattern") & (F.col("p") >= ACCEPT))
    b = base.select(F.col("id").alias("bid"), F.col("th").alias("bth"), F.col("s").alias("bs"), F.col("e").alias("be"))
    more = more.join(b, F.col("id").eqNullSafe(F.col("bid")) & (F.col("th") == F.col("bth")) & (F.col("s") < F.col("be")) & (F.col("bs") < F.col("e")), "left_anti")
    return base.unionByName(more).drop("pattern")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_spans, spans): counts of base spans and arrays of struct<s, order, kind, e> by start, then kind.

    A null or empty text has none. Null ids keep their row; rows that repeat id and text each get the same spans. Texts of any length are
    searched whole. Other columns are not read; an empty table gives an empty one.
    """
    spans = pii_spans(docs, id_col, text_col)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    entry = F.struct("s", order.cast("int").alias("order"), "kind", "e")
    per_doc = spans.groupBy("id", "th").agg(*[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
                                            F.array_sort(F.collect_list(F.when(F.col("base"), entry))).alias("base_spans"), F.array_sort(F.collect_list(entry)).alias("spans"))
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__th"))
    out = rows.join(per_doc, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__th") == F.col("th")), "left")
    none = F.array().cast("array<struct<s:bigint,order:int,kind:string,e:bigint>>")
    return out.select(F.col("__id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.coalesce("base_spans", none).alias("base_spans"), F.coalesce("spans", none).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
