"""The numbered queries over the text and vector tables, with SQL twins where SQL can express them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import decontam, dialogue, hilbert, hyperminhash, langid, line_dedup, mtree, periodic, pii, quality, spiece, token_counts, toxicity
from engram.llm.common import broadcast_below, fold, labelled_sample, read

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.tokenized(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), keep_ids=False, digests=True)


@query("op8_hilbert_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "lang", "source")
    cells = {"lang": hilbert.label_cell(F.col("lang"), 6), "source": hilbert.label_cell(F.col("source"), 6), "size": hilbert.log_cell(F.col("size"), 6)}
    out = hilbert.shards(docs, cells, ["doc_id", "text_crc32", "size"], "size", 16, law="rows", bits=6)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 4) == 2
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(labelled_sample(docs, read(spark, sf_dir, "labels"), "quality", held, quality.SAMPLE))
    out = quality.score(docs, "doc_id", "text", model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 3) == 1
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(labelled_sample(docs, read(spark, sf_dir, "labels"), "toxic", held, toxicity.SAMPLE))
    out = toxicity.score(docs, "doc_id", "text", model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_features")


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    docs = read(spark, sf_dir, "documents")
    profiles = langid.learn(langid.sampled(docs.filter(~held), "doc_id", "text", "lang"), "text", "lang")
    out = langid.predict(docs, "doc_id", "text", profiles)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op4_near_duplicates", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 80 * (na.n + nb.n - c)),
ar AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
cc(node, lab) AS (SELECT x, x FROM ar UNION SELECT ar.y, cc.lab FROM cc JOIN ar ON ar.x = cc.node),
lb AS (SELECT node, min(lab) AS lab FROM cc GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(lb.lab, d.doc_id) AS component_id, coalesce(lb.lab, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN lb ON lb.node = d.doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text", width=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 50 == 0, k=5)


@query("op6_line_dedup", """
WITH l AS (SELECT doc_id, CAST(hash(text) AS UBIGINT) AS th, CAST(i - 1 AS BIGINT) AS no, string_split(text, chr(10))[i] AS line, len(string_split(text, chr(10))) AS n
           FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
t AS (SELECT * FROM l WHERE length(trim(line, ' ')) >= 12),
c AS (SELECT line, min((doc_id, no)) AS f, length(line) AS n FROM t GROUP BY line),
k AS (SELECT line, f, n AS m, left(line, n // 2) AS h, 0 AS side FROM c UNION ALL SELECT line, f, n - 1, left(line, (n - 1) // 2), 0 FROM c
      UNION ALL SELECT line, f, n, right(line, n - n // 2), 1 FROM c UNION ALL SELECT line, f, n - 1, right(line, n - 1 - (n - 1) // 2), 1 FROM c),
x AS (SELECT DISTINCT a.line FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.h = b.h AND b.f < a.f AND levenshtein(a.line, b.line) <= 1),
g AS (SELECT t.doc_id, t.no FROM t JOIN c ON t.line = c.line WHERE (t.doc_id, t.no) <> c.f OR t.line IN (SELECT line FROM x)),
o AS (SELECT l.doc_id, max(l.n) AS n_lines, count(g.no) AS n_dropped,
             sha256(coalesce(string_agg(CASE WHEN g.no IS NULL THEN l.line END, chr(10) ORDER BY l.no), '')) AS text_sha256
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, text_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("op2_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
q AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT DISTINCT q.doc_id, q.s, q.n, p.item_id FROM q JOIN p ON q.g = p.g AND q.n = p.n),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text")
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.scan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.as_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def crc(text):
    """Unsigned crc32 of a text column."""
    return F.crc32(text.cast("binary"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults of the contract, chosen by crc32(`conv_id:turn`) % 20; nulls are one space."""
    space = F.lit(" ")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (crc(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.filter("k <> 0").select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                        F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"))


def repair_sql() -> str:
    """The contract of op11 as a forward recursion over rows: for each state of the end the least (cost, audit, repaired lines)."""
    far = 1_000_000_000

    def via(labels: str, cost: str, letter: str, line: str | None) -> str:
        lines = "x.t" if line is None else f"x.t || chr(10) || {line}"
        return f"list_transform([{labels}], lambda x: {{'c': x.c + {cost}, 'a': x.a || '{letter}', 't': {lines}}})"

    def least(*lists: str) -> str:
        return f"list_min({functools.reduce(lambda a, b: f'list_concat({a}, {b})', lists)})"

    only = lambda r: f"(e + CASE WHEN r = '{r}' THEN 0 ELSE {far} END)"
    own, user, assistant = "role || ':' || text", "'user:'", "'assistant:'"
    kept = lambda labels, r: via(labels, only(r), "K", own)
    again = lambda labels, role: via(labels, "(e + 3)", "R", f"{role} || text")
    step = {0: least(via("l0", "4", "D", None)), 1: least(via("l1", "4", "D", None), kept("l0", "s")),
            2: least(via("l2", "4", "D", None), kept("l0, l1, l3", "u"), again("l0, l1, l3", user)),
            3: least(via("l3", "4", "D", None), kept("l2", "a"), again("l2", assistant))}
    first = f"{{'c': {far}::BIGINT, 'a': '', 't': ''}}"
    return rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
              xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
                                          lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS k FROM conversations, tab),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM d0, range(2) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dam),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM o),
f AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p,
             CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 't' ELSE '-' END AS f FROM w),
g AS (SELECT *, CASE f WHEN '-' THEN 0 WHEN 't' THEN 3 ELSE {far} END AS e FROM f),
s(conv_id, i, l0, l1, l2, l3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': ''}}, {first}, {{'c': 3::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}}, {{'c': 6::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}
  FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL
  SELECT conv_id, i, l0, l1, l2, {least("[l3]", via("l2", "3", "I", assistant))} FROM (
    SELECT conv_id, i, l0, l1, {least("[l2]", via("l0, l1, l3", "3", "I", user))} AS l2, l3 FROM (
      SELECT conv_id, g.i, {", ".join(f"{v} AS l{k}" for k, v in step.items())} FROM s JOIN g USING (conv_id) WHERE g.i = s.i + 1) x) y),
z AS (SELECT conv_id, least(arg_max(l0, i), arg_max(l3, i)) AS b FROM s GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
             count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN c ON c.conv_id = q.conv_id LEFT JOIN z ON z.conv_id = q.conv_id"""


@query("op11_conversations", repair_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    summary, rows = dialogue.repair(damaged(conversations))
    hashes = dialogue.digests(rows).select(F.col("conv").alias("conv2"), "repaired_sha256")
    every = conversations.select("conv_id").distinct()
    out = every.join(summary, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("conv2")), "left")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = crc(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    found = periodic.runs(read(spark, sf_dir, "documents"), "doc_id", "text", repeat=(g, 3 + g % 8, F.coalesce(h % 10 == 0, F.lit(False)).cast("long")), keep_text=False, digests=True)
    # the longest run; of equal ones the smallest start, then period
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("byte_bpe_50k.json"))
