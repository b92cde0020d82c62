"""Near-duplicate documents by HyperMinHash.

A document is the set of its word shingles. The 64-bit hashes of the set fall into 128 buckets; of the smallest hash of each bucket only
the number of leading zeros and ten mantissa bits are kept (16 bits per bucket, as in HyperLogLog with a mantissa). Four buckets form a
band, and documents that agree in a band are candidates. A collision-corrected Jaccard estimate from the registers drops clear
non-pairs, and the rest are confirmed on full sets.

No bucket is expanded into all its pairs:
1. Documents with equal sets form one class; only one representative goes on.
2. In each bucket every member is compared with one hub, the member that shares most buckets with others. This joins almost all of a
   group of near copies with one row per member and bucket.
3. Only buckets whose members are not yet in one component go on. They are cut into tiles, and a pair of tiles is compared inside
   one task on the registers; pairs inside a component, pairs that agree in an earlier band and pairs whose set sizes or estimate rule
   out the threshold are dropped there. The others stay lists of partners, whose full sets meet in the same groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import broadcast_below, remembered
from engram.operators.graph import components
from engram.session import cut_lineage

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 10
ROWS = 4                        # registers per band
BANDS = REGISTERS // ROWS
EMPTY = np.uint16(0xFFFF)
SLACK = 4.5                     # standard errors by which an estimate may fall short of the threshold
TILE = 512                      # members of a bucket compared at once
REMEMBERED = 300_000            # word hashes kept per Python worker
MIX = np.uint64(0x9E3779B97F4A7C15)


def finish(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit keys."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text. Words are runs without ASCII white space, A-Z lower-cased.

    A text with fewer words than `width` is one shingle of all its words; without words the set is empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = remembered("hyperminhash", "words", dict)
    if len(known) >= REMEMBERED:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= 64 and len(known) < REMEMBERED:
                known[w] = h
        out.append(h)
    h = np.array(out, dtype=np.uint64)
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        key = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            key = finish(key * MIX + h[k:len(h) - n + 1 + k])
    return np.unique(key)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and mantissa (10 bits) of the smallest hash of each bucket; empty buckets are EMPTY.

    The hashes are sorted, so the first of each bucket is its smallest; a smaller register means a smaller hash."""
    out = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    if len(hashes):
        bucket, first = np.unique(hashes >> np.uint64(64 - BUCKET_BITS), return_index=True)
        rest = ((hashes[first] << np.uint64(BUCKET_BITS)) >> np.uint64(12)).astype(np.float64)   # 52 bits, exact as doubles
        m, e = np.frexp(rest)
        zeros = np.where(rest == 0, 53, 52 - e)
        mantissa = np.where(rest == 0, 0, (m - 0.5) * (1 << (MANTISSA + 1))).astype(np.int64)
        # more zeros sort first; within equal zeros the mantissa decides
        out[bucket.astype(np.int64)] = ((54 - zeros) << MANTISSA | mantissa).astype(np.uint16)
    return out


def band_keys(reg: np.ndarray) -> list[int]:
    """A signed 64-bit key per band that is not empty."""
    rows = np.ascontiguousarray(reg).reshape(BANDS, ROWS)
    key = finish(rows.view(np.uint64).ravel() + np.arange(1, BANDS + 1, dtype=np.uint64) * MIX)
    return key[(rows != EMPTY).any(axis=1)].view(np.int64).tolist()


def estimate(agree: np.ndarray, used: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from the share of agreeing registers, less the agreement that unrelated sets of these sizes show.

    Two unrelated minima of a bucket agree if they fall into one cell of (zeros, mantissa): about 2^-MANTISSA times 2 r / (1 + r)^2
    for a ratio r of the set sizes."""
    r = n / m
    chance = 2.0 ** -MANTISSA * 2 * r / (1 + r) ** 2
    share = agree / np.maximum(used, 1)
    return (share - chance) / (1 - chance)


def floor_of(n: np.ndarray, m: np.ndarray, used: np.ndarray, percent: int) -> np.ndarray:
    """Smallest estimate that a pair of sets of sizes n and m at the threshold may show.

    The `used` registers of a union of u shingles are a random choice of `used` of the u, so the agreeing ones are hypergeometric; the
    slack is SLACK standard errors and one and a half registers. Small sets fill a register per shingle and have hardly any slack."""
    j = percent / 100
    u = np.maximum((n + m) / (1 + j), 2.0)
    k = np.maximum(used, 1)
    return j - SLACK * np.sqrt(j * (1 - j) / k * np.clip((u - k) / (u - 1), 0, 1)) - 1.5 / k


def alike(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """For rows of registers and set sizes side by side: may the two sets reach `percent`? Sizes rule out exactly."""
    out = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    at = np.flatnonzero(out)
    for i in range(0, len(at), 50_000):
        k = at[i:i + 50_000]
        same, blank = a[k] == b[k], (a[k] == EMPTY) & (b[k] == EMPTY)
        used = REGISTERS - blank.sum(axis=1)
        n, m = na[k].astype(float), nb[k].astype(float)
        out[k] = estimate(same.sum(axis=1) - (REGISTERS - used), used, n, m) >= floor_of(n, m, used, percent)
    return out


def possible(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """`alike` as a matrix, rows of a against rows of b."""
    out = 100 * np.minimum.outer(na, nb) >= percent * np.maximum.outer(na, nb)
    agree = np.zeros(out.shape, np.int32)
    blank = np.zeros(out.shape, np.int32)
    for k in range(REGISTERS):
        x, y = a[:, k], b[:, k]
        same = x[:, None] == y[None, :]
        agree += same
        if (x == EMPTY).any():
            blank += same & (x == EMPTY)[:, None]
    used = REGISTERS - blank
    n, m = na[:, None].astype(float), nb[None, :].astype(float)
    return out & (estimate(agree - blank, used, n, m) >= floor_of(n, m, used, percent))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc, th, n_shingles, set_hi, set_lo, reg): id, hash of the text, set size, 128-bit digest of the set and registers of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, reg = [], [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), width)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                hi.append(int.from_bytes(d[:8], "big", signed=True))
                lo.append(int.from_bytes(d[8:], "big", signed=True))
                reg.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(reg, pa.binary())],
                                             names=["doc", "th", "n_shingles", "set_hi", "set_lo", "reg"])
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(run, "doc long, th long, n_shingles long, set_hi long, set_lo long, reg binary")


SMALL = 500_000                 # rows of (node, id, hash) that may be broadcast (some 40 bytes each)


def full_sets(named: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc, s): the full shingle sets of the wanted nodes (doc). named: (id, hash, text) of all documents; nodes: (doc, rep), the
    document that stands for a node. Texts stay where they are while few nodes are wanted; sets and no texts are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())], names=["doc", "s"])

    few = broadcast_below(cut_lineage(nodes.join(wanted, "doc", "left_semi").select("doc", F.col("rep.doc").alias("at"), F.col("rep.th").alias("th"))), SMALL)
    texts = named.join(few, F.col("id").eqNullSafe(F.col("at")) & (F.col("hash") == F.col("th"))).select("doc", "text")
    return texts.mapInArrow(run, "doc long, s binary").dropDuplicates(["doc"])      # rows may repeat


def confirmed(pairs: DataFrame, named: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (src, dst) whose full shingle sets reach `percent`. Sets are made once per document that occurs in a pair."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            got = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], names=["src", "dst"])

    sets = full_sets(named, nodes, pairs.select(F.explode(F.array("src", "dst")).alias("doc")).distinct(), width)
    both = (pairs.join(sets.select(F.col("doc").alias("src"), F.col("s").alias("a")), "src")
            .join(sets.select(F.col("doc").alias("dst"), F.col("s").alias("b")), "dst"))
    return both.select("src", "dst", "a", "b").mapInArrow(keep, "src long, dst long")


def hub_pairs(members: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """(src, dst): each member of a bucket with the bucket's hub, where sizes and registers allow the threshold. members: (key, doc)."""
    crowd = members.groupBy("key").agg(F.count("*").alias("n"))
    inside = members.join(crowd, "key")
    weight = inside.groupBy("doc").agg(F.sum("n").alias("w"))
    weighed = inside.join(weight, "doc")
    hubs = weighed.groupBy("key").agg(F.max_by("doc", F.struct("w", -F.col("doc"))).alias("hub"))
    near = members.join(hubs, "key").filter("doc <> hub")
    pairs = near.select(F.least("doc", "hub").alias("src"), F.greatest("doc", "hub").alias("dst")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (3, 5)]
            size = [batch.column(c).to_numpy() for c in (2, 4)]
            got = batch.filter(pa.array(alike(regs[0], size[0], regs[1], size[1], percent)))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], names=["src", "dst"])
    one = sketch.select(F.col("doc").alias("src"), F.col("n_shingles").alias("na"), F.col("reg").alias("ra"))
    two = sketch.select(F.col("doc").alias("dst"), F.col("n_shingles").alias("nb"), F.col("reg").alias("rb"))
    return pairs.join(one, "src").join(two, "dst").select("src", "dst", "na", "ra", "nb", "rb").mapInArrow(run, "src long, dst long")


def tile_pairs(key: int, crossed: bool, doc: np.ndarray, comp: np.ndarray, side: np.ndarray, size: np.ndarray, reg: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the pairs that one pair of tiles makes; `side` tells the tile when two different ones are crossed."""
    if len(doc) <= 48:
        i, j = np.triu_indices(len(doc), 1)
        ok = (comp[i] != comp[j]) & (side[i] != side[j] if crossed else True)
        i, j = i[ok], j[ok]
        ok = alike(reg[i], size[i], reg[j], size[j], percent)
        i, j = i[ok], j[ok]
    else:
        one, two = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if crossed else [np.arange(len(doc))] * 2
        found = []
        for k in range(0, len(one), TILE):
            part = one[k:k + TILE]
            ok = comp[part][:, None] != comp[two][None, :]
            if not crossed:
                ok &= part[:, None] < two[None, :]
            if ok.any():
                x, y = np.nonzero(ok & possible(reg[part], size[part], reg[two], size[two], percent))
                found.append((part[x], two[y]))
        i, j = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, int) for c in (0, 1))
    if len(i):                        # only the first band in which a pair agrees makes it
        a, b = reg[i].reshape(-1, BANDS, ROWS), reg[j].reshape(-1, BANDS, ROWS)
        first = ((a == b).all(axis=2) & (a != EMPTY).any(axis=2)).argmax(axis=1)
        bands = np.ascontiguousarray(a[np.arange(len(i)), first]).view(np.uint64).ravel()
        mine = finish(bands + (first.astype(np.uint64) + np.uint64(1)) * MIX).view(np.int64) == key
        i, j = i[mine], j[mine]
    return i, j


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, starts, ends) of whole groups of the first three columns, from batches sorted by them; a group may span batches."""
    rest = None
    for batch in _ending(batches):
        parts = [t for t in (rest, None if batch is None else pa.Table.from_batches([batch])) if t is not None and len(t)]
        if not parts:
            continue
        table = pa.concat_tables(parts).combine_chunks()
        a, b, c = (table.column(k).to_numpy() for k in range(3))
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
        ends = np.r_[starts[1:], len(a)]
        if batch is not None:
            rest = table.slice(starts[-1])
            starts, ends = starts[:-1], ends[:-1]
        if len(starts):
            yield table.slice(0, ends[-1]), starts, ends


def _ending(batches):
    """The batches, then None."""
    yield from batches
    yield None


def open_lists(members: DataFrame, labels: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """(key, ta, tb, doc, dsts): candidates of different components in buckets that hold more than one component, as a row per group
    and document with its list of partners; a document that only is a partner has an empty list.

    A bucket's members are dealt to tiles by a hash of the id; each unordered pair of tiles is one group of about 2 * TILE rows."""
    comp = members.join(labels, members.doc == labels.node, "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    live = comp.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    dealt = comp.join(live.select("key", tiles.alias("tiles")), "key").withColumn("tile", F.pmod(F.xxhash64("doc", "key"), F.col("tiles")).cast("int"))
    # a member of tile t goes to the groups (t, o) of all tiles o, so two tiles meet in exactly one group
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    spread = (dealt.withColumn("o", other).select("key", "doc", "component", "tile", F.least("tile", "o").alias("ta"), F.greatest("tile", "o").alias("tb"))
              .join(sketch.select("doc", "n_shingles", "reg"), "doc").select("key", "ta", "tb", "tile", "doc", "component", "n_shingles", "reg"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_groups(batches):
            key, ta, tb, tile, doc, comp, size = (table.column(c).to_numpy() for c in range(7))
            reg = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            at, lists = [], []
            for s, e in zip(starts, ends):
                i, j = tile_pairs(key[s], ta[s] != tb[s], doc[s:e], comp[s:e], (tile[s:e] != ta[s]).astype(int), size[s:e], reg[s:e], percent)
                if len(i):
                    order = np.argsort(i, kind="stable")
                    own, first = np.unique(i[order], return_index=True)
                    partner_only = np.setdiff1d(j, own)
                    at += (s + np.r_[own, partner_only]).tolist()
                    lists += np.split(doc[s:e][j[order]], first[1:]) + [doc[:0]] * len(partner_only)
            got = np.array(at, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[got]) for x in (key, ta, tb, doc)] + [pa.array(lists, pa.list_(pa.int64()))], names=["key", "ta", "tb", "doc", "dsts"])

    return grouped(spread).mapInArrow(run, "key long, ta int, tb int, doc long, dsts array<long>")


def grouped(df: DataFrame) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "key", "ta", "tb").sortWithinPartitions("key", "ta", "tb")


def open_links(lists: DataFrame, named: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """(src, dst): the pairs of `open_lists` that full sets confirm. A set goes once to each group in which its document has a pair."""
    sets = full_sets(named, nodes, lists.select("doc").distinct(), width)
    rows = lists.join(sets, "doc").select("key", "ta", "tb", "doc", "s", "dsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_groups(batches):
            docs, src, dst = table.column(3).to_numpy(), [], []
            for s, e in zip(starts, ends):
                sets = [np.frombuffer(x, np.uint64) for x in table.column(4).slice(s, e - s).to_pylist()]
                place = {d: k for k, d in enumerate(docs[s:e].tolist())}
                size = np.array([len(x) for x in sets])
                words, code = np.unique(np.concatenate(sets), return_inverse=True)
                begin = np.r_[0, np.cumsum(size)]
                mark = np.zeros(len(words), np.int32)
                for k, partners in enumerate(table.column(5).slice(s, e - s).to_pylist()):
                    if partners:
                        mark[code[begin[k]:begin[k + 1]]] = 1
                        to = np.array([place[d] for d in partners])
                        if 8 * len(to) > len(sets):
                            both = np.add.reduceat(mark[code], begin[:-1])[to]
                        else:
                            both = np.array([mark[code[begin[t]:begin[t + 1]]].sum() for t in to])
                        mark[code[begin[k]:begin[k + 1]]] = 0
                        ok = 100 * both >= percent * (size[k] + size[to] - both)
                        src += [docs[s + k]] * int(ok.sum())
                        dst += docs[s + to[ok]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return grouped(rows).mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept, th, first): components of documents linked by 100 * intersection >= percent * union of shingle sets.

    component_id is the smallest id that links reach, and kept says that it is the row's own. A document without words or text (null,
    empty, white space) has an empty set and is linked with nothing. Every row is a document of its own set: rows that share an id are linked
    through their sets only, and rows without an id take part like the others (component_id is null only if nothing they reach has
    an id). th is the xxhash64 of the text; first marks the rows of the (id, th) that stands for its component: the smallest id, then th.
    An empty table gives an empty one; other columns are not read. At the threshold itself a pair of different sets shares no band with
    a probability of 5e-8.
    """
    sketch = cut_lineage(sketches(docs, id_col, text_col, width))
    filled = sketch.filter("n_shingles > 0")
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "th")
    # a node per set, named by a number: ids may repeat or be missing. Size and registers are the same for equal sets
    reps = filled.groupBy("set_hi", "set_lo").agg(F.min(order).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("reg").alias("reg"))
    reps = cut_lineage(reps.select(F.monotonically_increasing_id().alias("doc"), "n_shingles", "reg", "set_hi", "set_lo", "rep"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(np.frombuffer(r.as_buffer(), np.uint16)) for r in batch.column(1)]
            docs_out = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array([x for k in keys for x in k], pa.int64()), pa.array(docs_out, pa.int64())], names=["key", "doc"])
    bands = reps.select("doc", "reg").mapInArrow(emit, "key long, doc long")
    crowded = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = cut_lineage(bands.join(crowded, "key", "left_semi"))
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    nodes = reps.select("doc", "rep")
    sketched = reps.drop("rep")
    first = cut_lineage(hub_pairs(members, sketched, percent))
    linked = cut_lineage(confirmed(first, named, nodes, width, percent))
    labels = components(linked)
    rest = cut_lineage(open_links(cut_lineage(open_lists(members, labels, sketched, percent)), named, nodes, width, percent))
    if rest.limit(1).count():
        labels = components(linked.unionByName(rest))
    by_class = reps.join(labels, reps.doc == labels.node, "left").select("set_hi", "set_lo", "rep", F.coalesce("component", "doc").alias("group"))
    lead = by_class.groupBy("group").agg(F.min("rep").alias("lead"))
    out = sketch.join(by_class.join(lead, "group").select("set_hi", "set_lo", "lead"), ["set_hi", "set_lo"], "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc")).otherwise(F.col("lead.doc"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"), "th",
                      (alone | (order == F.col("lead"))).alias("first"))
