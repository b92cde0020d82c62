"""Cheapest repair of conversations: bidirectional Dijkstra over the edit lattice.

A repaired conversation reads `(s?(ua)+)?` in the initials of its roles. A node of the lattice is (rows consumed, what stands at the end of
the repaired part); an edge keeps, re-roles or deletes the next row or inserts an empty turn. One heap works from the start, one from
the accepted ends. When the sum of their least costs passes the best crossing, every cheapest path has an edge whose tail is settled
from the front and whose head is settled from the back, so the least audit is the least of the concatenations over these edges.

Two audits of one cost that lead to the same node hold the same number of row letters, and an insertion is never free, so neither begins
with the other: the least prefix and the least suffix make the least audit.

Conversations of any length are cut into stretches of at most STRETCH rows. The lattice of a stretch is searched from every entry state
to every exit state, and the same search runs once more over the stretches of a conversation. Rows stand in one global order (range
partitions), so no task sorts a whole conversation, and first occurrences are minima per (conversation, role, text).
"""

from __future__ import annotations

import heapq
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from engram.functions.ranks import numbered
from engram.session import cut_lineage

STRETCH = 1024
START, SYSTEM, USER, ASSISTANT = range(4)     # what stands at the end of the repaired part
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
MAY_FOLLOW = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
ACCEPTED = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 3, 4, 3, 3
SOUND, BLANK, DUPLICATE, TRUNCATED = "-bdt"

Node = tuple[int, int]
Edge = tuple[Node, int, str]                  # other end, cost, letters


def _settle(heap: list, labels: dict[Node, tuple[int, str]], settled: set[Node], edges: Callable[[Node], list[Edge]], front: bool) -> None:
    """Takes the next node off a heap and labels its neighbours with (cost, least audit)."""
    _, _, node = heapq.heappop(heap)
    if node in settled:
        return
    settled.add(node)
    cost, audit = labels[node]
    for other, more, letters in edges(node):
        label = (cost + more, audit + letters if front else letters + audit)
        if other not in labels or label < labels[other]:
            labels[other] = label
            # of equal costs the nodes nearer to this search's own end go first: free edges lead away from it
            heapq.heappush(heap, (label[0], other[0] if front else -other[0], other))


def cheapest(ahead: Callable[[Node], list[Edge]], back: Callable[[Node], list[Edge]], sources: list[Node], targets: list[Node]) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest paths of one edge or more from a source to a target; None if there is none."""
    sides = []
    for ends, edges, front in ((sources, ahead, True), (targets, back, False)):
        labels: dict[Node, tuple[int, str]] = {x: (0, "") for x in ends}
        heap, settled = [(0, x[0] if front else -x[0], x) for x in ends], set()
        heapq.heapify(heap)
        for _ in ends:
            _settle(heap, labels, settled, edges, front)
        sides.append((heap, labels, settled, edges, front))
    (f_heap, f_labels, f_settled, *_), (b_heap, b_labels, b_settled, *_) = sides
    best, meet = None, []

    def crossings(node: Node, front: bool) -> None:
        """Edges between a node that has just been settled and nodes settled by the other side."""
        nonlocal best
        for other, more, letters in (ahead if front else back)(node):
            tail, head = (node, other) if front else (other, node)
            if tail in f_settled and head in b_settled:
                cost = f_labels[tail][0] + more + b_labels[head][0]
                if best is None or cost <= best:
                    if cost != best:
                        meet.clear()
                    best = cost
                    meet.append((tail, head, letters))

    for node in list(f_settled):
        crossings(node, True)
    while f_heap and b_heap and (best is None or f_heap[0][0] + b_heap[0][0] <= best):
        side = sides[0] if f_heap[0][0] <= b_heap[0][0] else sides[1]
        node = side[0][0][2]
        known = node in side[2]
        _settle(*side)
        if not known:
            crossings(node, side[4])
    if best is None:
        return None
    return best, min(f_labels[tail][1] + letters + b_labels[head][1] for tail, head, letters in meet)


def lattice(roles: str, faults: str) -> tuple[Callable[[Node], list[Edge]], Callable[[Node], list[Edge]]]:
    """Edges ahead of and back from a node (rows consumed, state) of the edit lattice of some rows."""
    n = len(roles)

    def row(i: int) -> list[tuple[str, int, str, int | None]]:
        """Edits of row i as (letter, cost, kept role or "", state after)."""
        out = [("D", DELETE, None)]
        if faults[i] in (SOUND, TRUNCATED):
            extra = LEFT_TRUNCATED if faults[i] == TRUNCATED else 0
            if roles[i] in AFTER:
                out.append(("K", KEEP + extra, AFTER[roles[i]]))
            out += [("R", REROLE + extra, USER), ("R", REROLE + extra, ASSISTANT)]
        return out

    def ahead(node: Node) -> list[Edge]:
        i, state = node
        out = [((i, new), INSERT, "I") for new in (USER, ASSISTANT) if state in MAY_FOLLOW[new]]
        if i < n:
            out += [((i + 1, state if new is None else new), cost, letter) for letter, cost, new in row(i) if new is None or state in MAY_FOLLOW[new]]
        return out

    def back(node: Node) -> list[Edge]:
        i, state = node
        out = [((i, old), INSERT, "I") for old in MAY_FOLLOW.get(state, ()) if state in (USER, ASSISTANT)]
        if i > 0:
            for letter, cost, new in row(i - 1):
                if new is None:
                    out.append(((i - 1, state), cost, letter))
                elif new == state:
                    out += [((i - 1, old), cost, letter) for old in MAY_FOLLOW[new]]
        return out

    return ahead, back


def best_edits(roles: str, faults: str, entry: int = START, exits: tuple[int, ...] = ACCEPTED) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest edits that lead from an entry state over all rows to one of the exit states."""
    if not roles:
        return (0, "") if entry in exits else None
    ahead, back = lattice(roles, faults)
    return cheapest(ahead, back, [(0, entry)], [(len(roles), x) for x in exits])


def joined_edits(tables: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """The same over stretches: `tables` give for each stretch (entry, exit) -> (cost, least audit)."""
    into = [{} for _ in tables]
    for i, table in enumerate(tables):
        for (entry, leave), (cost, audit) in table.items():
            into[i].setdefault(leave, []).append(((i, entry), cost, audit))

    def ahead(node: Node) -> list[Edge]:
        i, state = node
        return [((i + 1, leave), *tables[i][entry, leave]) for entry, leave in tables[i] if entry == state] if i < len(tables) else []

    def back(node: Node) -> list[Edge]:
        i, state = node
        return into[i - 1].get(state, []) if i > 0 else []

    return cheapest(ahead, back, [(0, START)], [(len(tables), x) for x in ACCEPTED])


def placed(audit: str, roles: str) -> list[tuple[int, str | None]]:
    """Repaired rows of an audit as (row, new role or None for its own); row -1 is an inserted one."""
    out: list[tuple[int, str | None]] = []
    row, state = 0, START
    for letter in audit:
        if letter in "IR":
            state = ASSISTANT if state == USER else USER
            out.append((row if letter == "R" else -1, "assistant" if state == ASSISTANT else "user"))
        elif letter == "K":
            state = AFTER[roles[row]]
            out.append((row, None))
        row += letter != "I"
    return out


# -- tables -------------------------------------------------------------------------------------------------------------------

WHITE = r"\x20\x09-\x0D"
EDITS = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
ITEMS = pa.list_(pa.struct([("n", pa.int64()), ("role", pa.string())]))


def _stretches(rows: DataFrame, stretch: int) -> DataFrame:
    """(conv, block, n0, roles, faults, distinct turns and their ends) of the rows of a conversation, at most `stretch` at a time."""
    first = F.substring("role", 1, 1)
    coded = rows.select(
        "conv", "n", "turn", F.when(first.isin(*AFTER), first).otherwise("o").alias("r"),
        F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("key"),
        F.when(~F.col("text").rlike(f"[^{WHITE}]"), BLANK).when(~F.col("text").rlike(rf"[.!?][{WHITE}]*\z"), TRUNCATED).otherwise(SOUND).alias("f"))
    # blank rows need no look at earlier ones, and only what stands twice comes back
    again = (coded.filter(F.col("f") != BLANK).groupBy("conv", "key").agg(F.min("n").alias("first"), F.count("*").alias("c")).filter("c > 1")
             .select(F.col("conv").alias("conv2"), F.col("key").alias("key2"), "first"))
    marked = (coded.join(again, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("key") == F.col("key2")) & (F.col("f") != BLANK), "left")
              .withColumn("f", F.when(F.col("n") > F.col("first"), DUPLICATE).otherwise(F.col("f"))))
    return (marked.groupBy("conv", F.floor(F.col("n") / stretch).alias("block"))
            .agg(F.min("n").alias("n0"), F.array_sort(F.collect_list(F.struct("n", "r", "f"))).alias("l"),
                 F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("turns"))
            .select("conv", "block", "n0", F.array_join("l.r", "").alias("roles"), F.array_join("l.f", "").alias("faults"), "low", "high", "turns"))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each stretch its table of cheapest edits, from every entry state to every exit state; whole conversations need one."""
    known: dict[tuple, list] = {}                 # short stretches repeat
    for batch in batches:
        out = []
        for key in zip(*(batch.column(k).to_pylist() for k in ("roles", "faults", "opens", "closes"))):
            got = known.get(key)
            if got is None:
                roles, faults, opens, closes = key
                exits = [ACCEPTED] if opens and closes else [(x,) for x in (ACCEPTED if closes else range(4))]
                tries = [(entry, x, best_edits(roles, faults, entry, x)) for entry in ((START,) if opens else range(4)) for x in exits]
                got = [{"entry": entry, "leave": x[-1], "cost": best[0], "audit": best[1]} for entry, x, best in tries if best is not None]
                if len(roles) <= 16 and len(known) < 100_000:
                    known[key] = got
            out.append(got)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, EDITS)], names=[*batch.schema.names, "edits"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the stretches of a conversation in order (last column): cost, audit and the repaired rows."""
    for batch in batches:
        cost, audits, items = [], [], []
        for parts in batch.column("parts").to_pylist():
            if len(parts) == 1:
                c, audit = parts[0]["edits"][0]["cost"], parts[0]["edits"][0]["audit"]
            else:
                c, audit = joined_edits([{(e["entry"], e["leave"]): (e["cost"], e["audit"]) for e in p["edits"]} for p in parts])
            n0 = parts[0]["n0"]                   # the rows of a conversation are numbered without gaps
            cost.append(c)
            audits.append(audit)
            items.append([{"n": None if row < 0 else n0 + row, "role": role} for row, role in placed(audit, "".join(p["roles"] for p in parts))])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cost, pa.int64()), pa.array(audits, pa.string()), pa.array(items, ITEMS)],
                                         names=[*batch.schema.names[:-1], "cost", "audit", "items"])


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", " + more


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(summary, repaired rows) of conversations whose rows are taken by turn, nulls first, then role, then text.

    summary: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row per conversation. A row's first fault counts: blank (nothing
    but white space), duplicate (role and text stand earlier), truncated (last character that is not white space is none of `.!?`). gaps is
    maxTurn - minTurn + 1 - distinctTurns without null turns (0 if all are null); illegal counts neighbours whose initials are not su, ua or au.
    Edits cost: keep 0, re-role 3, delete 4 (required for blank and duplicate rows), insert an empty user or assistant turn 3; truncated rows
    that stay add 3. The audit is the ASCII-least one of the cheapest. repaired rows: (conv, place, role, text), text "" where inserted.

    A null role or text is one space; a null conversation id is a conversation of its own; of equal rows all but one are duplicates;
    texts of any length are hashed, never gathered; other columns are not read; an empty table gives empty ones. A task gathers at most
    a stretch of rows, or the letters of one conversation (16 per row): its audit is one string of the result.
    """
    rows = numbered(df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text")),
                    ["conv", "turn", "role", "text"], "n")
    along = W.partitionBy("conv").orderBy("block")
    parts = (_stretches(rows, stretch).withColumn("before", F.lag(F.substring("roles", -1, 1)).over(along))
             .withColumn("opens", F.col("before").isNull()).withColumn("closes", F.lead("block").over(along).isNull())
             .withColumn("twice", (F.lag("high").over(along) == F.col("low")).cast("int")))
    found = parts.mapInArrow(_search, _schema(parts, "edits array<struct<entry:int,leave:int,cost:bigint,audit:string>>"))
    fault = lambda letter: F.sum(F.char_length("faults") - F.char_length(F.regexp_replace("faults", letter, ""))).cast("long")
    chain = found.withColumn("chain", F.concat(F.coalesce("before", F.lit("")), "roles"))
    illegal = F.expr("cast(char_length(chain) - 1 - size(filter(sequence(1, char_length(chain)), i -> substring(chain, i, 2) in ('su', 'ua', 'au'))) as bigint)")
    whole = chain.groupBy("conv").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.coalesce("twice", F.lit(0))), F.lit(0)).cast("long").alias("gaps"),
        fault(BLANK).alias("blank"), fault(DUPLICATE).alias("duplicate"), fault(TRUNCATED).alias("truncated"), F.sum(illegal).alias("illegal"),
        F.array_sort(F.collect_list(F.struct("block", "n0", "roles", "edits"))).alias("parts"))
    chosen = cut_lineage(whole.mapInArrow(_choose, _schema(whole.drop("parts"), "cost long, audit string, items array<struct<n:bigint,role:string>>")))
    item = chosen.select("conv", F.posexplode("items").alias("place", "item")).select("conv", "place", "item.n", F.col("item.role").alias("new"))
    own = (item.filter(F.col("n").isNotNull()).join(rows.select("n", "role", "text"), "n")
           .select("conv", "place", F.coalesce("new", "role").alias("role"), "text"))
    put = item.filter(F.col("n").isNull()).select("conv", "place", F.col("new").alias("role"), F.lit("").alias("text"))
    return chosen.drop("items"), own.unionByName(put)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): hash of `role:text` of the repaired rows in order, joined by line feeds. Rows stream through the hash, so
    a conversation of any length takes no more memory than a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                line = f"{role}:{text}".encode()
                if state is not None and conv == now:
                    state.update(b"\n")
                    state.update(line)
                else:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(line)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field(0).type), pa.array([d[1] for d in done], pa.string())], names=["conv", "repaired_sha256"])
            kind = batch.schema.field(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

    kind = dict(repaired.dtypes)["conv"]
    return repaired.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "role", "text").mapInArrow(run, f"conv {kind}, repaired_sha256 string")
