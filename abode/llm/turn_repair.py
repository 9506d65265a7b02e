"""Conversation structure repair (operator 12): generalised LR parsing over a role grammar with weighted edits.

A conversation's turns give role symbols (the role's first letter). ``GRAMMAR`` states which
sequences are whole: ``(s?(ua)+)?``. ``Parser`` builds its SLR table and parses all repairs at
once: every turn is kept, re-roled or deleted, and turns may be inserted before any turn and at the
end. Stacks are nodes of one graph, a node being (state, node below), so stacks share what they have in
common and equal stacks are the same node. Of the repairs that reach one node the parser
keeps that with the least (cost, audit); an audit is the initials of the edits.

A repair is given up once another is so much cheaper that it stays so whatever follows (``_leads``).

Two audits at one place have the same number of edits that consume a turn and end in one, so neither
begins with the other, and their order stays when both go on. Hence a frontier is a small
set of (node, cost above the least, rank of the audit), only finitely many of them occur, and
what one kind of turn makes of one frontier is computed once per worker (``Parser.step``). A turn
costs one lookup; per conversation one reference a turn is kept to read the audit back.

``plan_repairs`` marks faults natively, finds repeated (role, text) by a window over their digests,
and streams each conversation's symbols, without texts, in turn order. ``repaired_turns`` streams the
turns once more behind their audit and emits the repaired ones; it holds one turn at a time.
A conversation's audit is one string, so its turns are one task's work in order; the sort spills.

Defined results: null roles and texts are one space; a null conversation id is one
conversation; null turns stand first; rows with equal turn go by role, then by the text's digest;
repeated rows are turns of their own (the later ones duplicates); roles with another initial than s, u or a can only be re-roled or
deleted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The contract's costs, and the grammar of whole conversations (rule 0 is the start).
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3                 # a truncated turn that stays
EDITABLE = {"u": "user", "a": "assistant"}   # roles that an insert or a re-role may give
GRAMMAR = (("C", ()), ("C", ("P",)), ("C", ("s", "P")), ("P", ("P", "u", "a")), ("P", ("u", "a")))
LEGAL = ("su", "ua", "au")
END = "$"
NO_SPACE = r"[^\x20\x09-\x0D]"
FAULTS = ("", "blank", "duplicate", "truncated")
LONGEST = (1 << 63) - 1
STACKS = 64                   # a grammar with more different stacks keeps all repairs under way


class Parser:
    """SLR automaton of a grammar without empty rules but for the start symbol, and its repair steps."""

    def __init__(self, grammar=GRAMMAR, costs=COSTS, truncated=TRUNCATED, editable=tuple(EDITABLE)):
        self.grammar, self.costs, self.truncated, self.editable = (("start", (grammar[0][0],)), *grammar), costs, truncated, editable
        heads = {h for h, _ in self.grammar}
        follow = self._follow(heads)
        states, self.go = [self._closure({(0, 0)}, heads)], {}
        for i, state in enumerate(states):  # grows while it is read
            for symbol in sorted({self.grammar[r][1][dot] for r, dot in state if dot < len(self.grammar[r][1])}):
                target = self._closure({(r, dot + 1) for r, dot in state if self.grammar[r][1][dot:dot + 1] == (symbol,)}, heads)
                if target not in states:
                    states.append(target)
                self.go[i, symbol] = states.index(target)
        self.reduce = {}
        for i, state in enumerate(states):
            for r, dot in state:
                if dot == len(self.grammar[r][1]):
                    for t in follow[self.grammar[r][0]]:
                        if (i, t) in self.reduce or (i, t) in self.go:
                            raise ValueError(f"state {i} has two actions on {t!r}")
                        self.reduce[i, t] = r
        self.nodes, self.known, self.shifts, self.steps = [(0, None)], {(0, None): 0}, {}, {}
        self.start = ((0, 0, 0),)  # frontier: (node, cost above the least, rank of the audit)
        self.lead = self._leads()

    def _closure(self, items, heads):
        items = set(items)
        while True:
            wanted = {self.grammar[r][1][dot] for r, dot in items if dot < len(self.grammar[r][1])} & heads
            more = {(i, 0) for i, (h, _) in enumerate(self.grammar) if h in wanted} - items
            if not more:
                return frozenset(items)
            items |= more

    def _follow(self, heads):
        first = {h: set() for h in heads}
        follow = {h: set() for h in heads} | {"start": {END}}
        for _ in range(len(self.grammar) + 1):
            for h, body in self.grammar:
                if body:
                    first[h] |= first[body[0]] if body[0] in heads else {body[0]}
                for x, nxt in zip(body, (*body[1:], None)):
                    if x in heads:
                        follow[x] |= follow[h] if nxt is None else first[nxt] if nxt in heads else {nxt}
        return follow

    def _node(self, state, below):
        if (state, below) not in self.known:
            self.known[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.known[state, below]

    def shift(self, node: int, symbol: str):
        """Node after all reductions before ``symbol`` and its shift (for the end: whether it is accepted), or None."""
        if (node, symbol) not in self.shifts:
            top, rule = node, None
            while (rule := self.reduce.get((self.nodes[top][0], symbol))) not in (None, 0):
                head, body = self.grammar[rule]
                for _ in body:
                    top = self.nodes[top][1]
                top = self._node(self.go[self.nodes[top][0], head], top)
            if symbol == END:
                found = rule == 0 or None
            else:
                target = self.go.get((self.nodes[top][0], symbol))
                found = None if target is None else self._node(target, top)
            self.shifts[node, symbol] = found
        return self.shifts[node, symbol]

    def _with_inserts(self, node: int) -> list[tuple[int, str]]:
        """(node, inserts) of the fewest inserts that reach each node; a cycle of inserts only costs."""
        out = {node: ""}
        queue = [node]
        for top in queue:  # grows while it is read, by number of inserts
            for t in self.editable:
                nxt = self.shift(top, t)
                if nxt is not None and len(out[top]) < len(self.go) and nxt not in out:
                    out[nxt] = out[top] + "I"
                    queue.append(nxt)
        return list(out.items())

    def _moves(self, node: int, kind) -> dict[int, int]:
        """Node -> least cost of what a turn's kind can make of a node."""
        symbol, must_go, cut = kind
        out = {node: self.costs["D"]}
        for top, inserts in [] if must_go else self._with_inserts(node):
            for t in {symbol, *self.editable}:
                nxt = self.shift(top, t)
                if nxt is not None:
                    paid = len(inserts) * self.costs["I"] + (self.truncated if cut else 0) + self.costs["K" if t == symbol else "R"]
                    out[nxt] = min(paid, out.get(nxt, paid))
        return out

    def _leads(self) -> dict[tuple[int, int], int]:
        """(a, b) -> lead by which b must be cheaper than a so that whatever follows, b ends cheaper.

        What b loses at most while it follows a: the most over a's moves of the least over b's, repeated until nothing
        changes. Pairs that keep losing have no lead. A grammar without finitely many stacks has none at all.
        """
        symbols = sorted({x for _, body in self.grammar for x in body} - {h for h, _ in self.grammar})
        kinds = [(x, False, cut) for x in (*symbols, "") for cut in (False, True)]
        moves, seen = {}, [0]
        for node in seen:  # grows while it is read
            for kind in kinds:
                moves[node, kind] = self._moves(node, kind)
                seen += [n for n in moves[node, kind] if n not in seen]
            if len(seen) > STACKS:
                return {}
        ends = {n: min((len(i) * self.costs["I"] for top, i in self._with_inserts(n) if self.shift(top, END)), default=None) for n in seen}
        pairs = [(a, b) for a in seen for b in seen if a != b and None not in (ends[a], ends[b])]
        lead = {(a, b): max(0, ends[b] - ends[a]) for a, b in pairs} | {(a, a): 0 for a in seen}
        for _ in range(len(seen)):
            after = dict(lead)
            for a, b in pairs:
                if (a, b) in lead:
                    worst = [min((cb + lead[x, y] - ca for y, cb in moves[b, k].items() if (x, y) in lead), default=None)
                             for k in kinds for x, ca in moves[a, k].items()]
                    if None in worst:
                        del after[a, b]
                    else:
                        after[a, b] = max(lead[a, b], *worst)
            if after == lead:
                return lead
            lead = after
        return {pair: v for pair, v in lead.items() if pair[0] == pair[1]}

    def step(self, frontier, kind):
        """(next frontier, least cost, per slot (slot before, edits)) of a turn's ``kind`` (symbol, must go, truncated)."""
        if (frontier, kind) not in self.steps:
            symbol, must_go, cut = kind
            best = {}

            def offer(node, cost, rank, slot, edits):
                if node is not None and (node not in best or (cost, rank, edits) < best[node][:3]):
                    best[node] = (cost, rank, edits, slot)

            for slot, (node, cost, rank) in enumerate(frontier):
                offer(node, cost + self.costs["D"], rank, slot, "D")
                for top, inserts in [] if must_go else self._with_inserts(node):
                    paid = cost + len(inserts) * self.costs["I"] + (self.truncated if cut else 0)
                    offer(self.shift(top, symbol), paid + self.costs["K"], rank, slot, inserts + "K")
                    for t in self.editable:
                        offer(self.shift(top, t), paid + self.costs["R"], rank, slot, inserts + "R")
            best = {n: v for n, v in best.items() if not any((n, m) in self.lead and v[0] > w[0] + self.lead[n, m] for m, w in best.items())}
            least = min(b[0] for b in best.values())
            ranks = {key: i for i, key in enumerate(sorted({(rank, edits) for _, rank, edits, _ in best.values()}))}
            order = sorted(best)
            self.steps[frontier, kind] = (tuple((n, best[n][0] - least, ranks[best[n][1], best[n][2]]) for n in order), least,
                                          [(best[n][3], best[n][2]) for n in order])
        return self.steps[frontier, kind]

    def finish(self, frontier):
        """(cost, slot, inserts) of the least repair that ends here."""
        return min((cost + len(inserts) * self.costs["I"], rank, inserts, slot) for slot, (node, cost, rank) in enumerate(frontier)
                   for top, inserts in self._with_inserts(node) if self.shift(top, END))

    def repair(self, kinds) -> tuple[int, str]:
        """(cost, audit) of a sequence of turn kinds."""
        walk = Walk(self)
        for kind in kinds:
            walk.turn(kind)
        return walk.end()


@functools.cache
def shared_parser() -> Parser:
    """One parser per worker process: its steps serve all conversations."""
    return Parser()


class Walk:
    """A parse in progress: the frontier and, per turn, where each slot came from."""

    def __init__(self, parser: Parser):
        self.parser, self.frontier, self.cost, self.back = parser, parser.start, 0, []

    def turn(self, kind) -> None:
        self.frontier, least, back = self.parser.step(self.frontier, kind)
        self.cost += least
        self.back.append(back)

    def end(self) -> tuple[int, str]:
        cost, _, inserts, slot = self.parser.finish(self.frontier)
        edits = [inserts]
        for back in reversed(self.back):
            slot, done = back[slot]
            edits.append(done)
        return self.cost + cost, "".join(reversed(edits))


def _turns(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest), without nulls in role and text."""
    rows = chats.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.withColumn("digest", F.sha2("text", 256))


ORDER = ("turn", "role", "digest")


def faults(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, fault): each turn's first fault, as an index into ``FAULTS``."""
    rows = _turns(chats)
    last = F.regexp_extract("text", rf"(?s)({NO_SPACE})[\x20\x09-\x0D]*\z", 1)
    rows = rows.select("conv_id", "turn", "role", "digest", last.alias("last"))
    before = Window.partitionBy("conv_id", "role", "digest").orderBy("turn")
    fault = (F.when(F.col("last") == "", 1).when(F.row_number().over(before) > 1, 2)
             .when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0))
    return rows.select("conv_id", "turn", "role", "digest", fault.alias("fault"))


def plan_repairs(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; one row per conversation."""
    rows = faults(chats).select("conv_id", F.substring("role", 1, 1).alias("symbol"), "turn", "fault", "role", "digest")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).select("conv_id", "symbol", "turn", "fault")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kind = chats.schema["conv_id"].dataType.simpleString()

    def run(batches):
        parser, conv, walk = shared_parser(), None, None

        def result():
            cost, audit = walk.end()
            gaps = 0 if low is None else min(LONGEST, high - low + 1 - distinct)
            return (conv, gaps, *counts[1:], illegal, cost, audit)

        for batch in batches:
            out = []
            for c, symbol, turn, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "symbol", "turn", "fault"))):
                if walk is None or c != conv:
                    if walk is not None:
                        out.append(result())
                    conv, walk, counts, illegal, before = c, Walk(parser), [0, 0, 0, 0], 0, None
                    low = high = None
                    distinct = 0
                walk.turn((symbol, fault in (1, 2), fault == 3))
                counts[fault] += 1
                illegal += before is not None and before + symbol not in LEGAL
                before = symbol
                if turn is not None and turn != high:
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
            yield _batch(out, names, schema)
        if walk is not None:
            yield _batch([result()], names, schema)

    fields = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    schema = _arrow(chats, [pa.int64()] * 6 + [pa.string()], names)
    return rows.mapInArrow(run, fields)


def _arrow(chats: DataFrame, types, names):
    from pyspark.sql.pandas.types import to_arrow_type
    return pa.schema(list(zip(names, [to_arrow_type(chats.schema["conv_id"].dataType), *types])))


def _batch(rows, names, schema):
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def repaired_turns(chats: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, position, action, turn, role, text) of the repaired conversations, in order inside each partition."""
    rows = _turns(chats).select("conv_id", F.lit(1).alias("step"), *ORDER, "text", F.lit(None).cast("string").alias("audit"))
    none = [F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "digest", "text")]]
    both = rows.unionByName(plans.select("conv_id", F.lit(0).alias("step"), *none, "audit"))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "step", *ORDER).drop("digest")
    names = ["conv_id", "position", "action", "turn", "role", "text"]
    schema = _arrow(chats, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()], names)
    kind = chats.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, audit, at, position, before = None, "", 0, 0, ""

        def expected():
            return "a" if before == "u" else "u"

        for batch in batches:
            out = []

            def inserts():
                nonlocal at, position, before
                while audit[at:at + 1] == "I":
                    before = expected()
                    out.append((conv, position, "I", None, EDITABLE[before], ""))
                    at, position = at + 1, position + 1

            for c, step, turn, role, text, plan in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "step", "turn", "role", "text", "audit"))):
                if step == 0:
                    conv, audit, at, position, before = c, plan, 0, 0, ""
                else:
                    action = audit[at]
                    at += 1
                    if action != "D":
                        before = expected() if action == "R" else role[:1]
                        out.append((conv, position, action, turn, EDITABLE[before] if action == "R" else role, text))
                        position += 1
                inserts()
            yield _batch(out, names, schema)

    return both.mapInArrow(run, f"conv_id {kind}, position long, action string, turn long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text``, joined by newlines; follows ``repaired_turns`` in the same stage."""
    names = ["conv_id", "repaired_sha256"]
    schema = _arrow(repaired, [pa.string()], names)
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, sha = None, None
        for batch in batches:
            out = []
            for c, position, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                sha.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            yield _batch(out, names, schema)
        if sha is not None:
            yield _batch([(conv, sha.hexdigest())], names, schema)

    return repaired.select("conv_id", "position", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


# Kinds of damage that the contract's query does to a turn, by the remainder of its key's crc32.
DROPPED, EMPTIED, UNPUNCTUATED, REPEATED, AS_USER, KINDS = 0, 1, 2, 3, 4, 20


def damaged(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the contract's damage."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = chats.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                        F.pmod(F.crc32(key), F.lit(KINDS)).alias("kind")).where(F.col("kind") != DROPPED)
    text = F.when(F.col("kind") == EMPTIED, "").when(F.col("kind") == UNPUNCTUATED, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == REPEATED, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == AS_USER, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), copies.alias("copy"))
    return rows.drop("copy")


def oracle() -> str:
    """DuckDB SQL of the query: least repairs by a recursive walk over the four ends an output may have."""
    space = r"[\x20\x09-\x0D]*"
    # (end before, role given, edits before the turn's own): e is the empty output
    moves = [(x, "s", "") for x in "e"] + [(x, "u", "" if x != "u" else "I") for x in "esua"] + [(x, "a", "" if x == "u" else "I") for x in "esua"]
    filled = {("u", "u"): "assistant:", ("e", "a"): "user:", ("s", "a"): "user:", ("a", "a"): "user:"}
    values = ", ".join(f"('{x}', '{r}', '{i}', {'NULL' if not i else repr(filled[x, r])})" for x, r, i in moves)
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT k.* EXCLUDE (key), xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {KINDS} AS kind FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = {AS_USER} THEN 'user' ELSE role END AS role,
  CASE WHEN kind = {EMPTIED} THEN '' WHEN kind = {UNPUNCTUATED} THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM h, range(CASE WHEN kind = {REPEATED} THEN 2 ELSE 1 END) AS c(copy) WHERE kind <> {DROPPED}),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  lag(left(role, 1)) OVER w || left(role, 1) AS pair, regexp_extract(text, '(?s)({NO_SPACE}){space}\z', 1) AS last
  FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
f AS MATERIALIZED (SELECT *, left(role, 1) AS symbol,
  CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
moves(x, r, ins, filled) AS (VALUES {values}),
walk AS (SELECT conv_id, 0::BIGINT AS i, 'e' AS x, 0::BIGINT AS cost, '' AS audit, NULL::VARCHAR AS said FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, x, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, x ORDER BY cost, audit) AS best FROM (
      SELECT w.conv_id, f.i, w.x, w.cost + {COSTS['D']} AS cost, w.audit || 'D' AS audit, w.said
      FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
      UNION ALL
      SELECT w.conv_id, f.i, m.r, w.cost + length(m.ins) * {COSTS['I']} + CASE WHEN f.symbol = m.r THEN {COSTS['K']} ELSE {COSTS['R']} END
          + CASE WHEN f.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END, w.audit || m.ins || CASE WHEN f.symbol = m.r THEN 'K' ELSE 'R' END,
        concat_ws(chr(10), w.said, m.filled, CASE WHEN f.symbol = m.r THEN f.role WHEN m.r = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text)
      FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN moves m ON m.x = w.x
      WHERE f.fault NOT IN ('blank', 'duplicate') AND (f.symbol = m.r OR m.r <> 's')) s) r WHERE best = 1),
ends AS (SELECT conv_id, arg_min({{'cost': cost, 'audit': audit, 'said': said}}, {{'cost': cost, 'audit': audit}}) AS e FROM (
    SELECT conv_id, cost + CASE x WHEN 'u' THEN 1 WHEN 's' THEN 2 ELSE 0 END * {COSTS['I']} AS cost,
      audit || CASE x WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END AS audit,
      CASE x WHEN 'u' THEN said || chr(10) || 'assistant:' WHEN 's' THEN said || chr(10) || 'user:' || chr(10) || 'assistant:' ELSE said END AS said
    FROM walk w WHERE i = (SELECT max(i) FROM f WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id)) GROUP BY conv_id),
c AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ({", ".join(repr(p) for p in LEGAL)})) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(e.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM a.conv_id"""
