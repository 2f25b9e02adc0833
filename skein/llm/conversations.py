r"""Conversation repair: the cheapest edits that give each conversation the roles (s?(ua)+)?, by composition of weighted machines.

Three machines: the input acceptor is a conversation's chain of rows, each a symbol of its role's initial and its first fault; the edit
transducer keeps (K, 0), gives another role to (R, 3), deletes (D, 4) or inserts (I, 3) a row, deletes blank and repeated rows in any
case and charges 3 more for a cut-off row that stays; the grammar acceptor reads the roles that come out. Their product is built only where a
conversation needs it: what a symbol allows from a grammar state, and what a symbol does to the weights of the states after it, are made once and
kept. Weights are (cost, label string), the lesser string first at equal cost; from one state no two strings of a row's step are equal or
begin one another, so a step's own string decides, and the path from the last row back to the first takes linear time.

Each row's first fault counts: blank (no code point but \x20 and \x09-\x0D), duplicate (role and text seen earlier in the conversation), truncated
(the last such code point is none of .!?). Rows go by turn, null turns first; rows of one turn by role, then by the sha256 of their text. A null
role or text is one space; a null conv_id is a conversation; a role without initial (empty) or with another one than s, u, a can't be kept. Other columns
are left out, whatever their names. An empty table gives an empty one; ids without rows give zeros, an empty audit and the hash of the empty string.

Scale: a row's symbol is found in Spark, duplicates by a window over (conversation, role, text's hash), and only symbols meet by
conversation, a byte each, as the audit that is returned holds a letter a row. Texts never meet: they pass by in order, one batch at a
time, with the labels of their conversation, on their way to a hash or to repaired rows. A very long text is a row of a batch.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import common as C

SPACE = " \t\n\x0b\f\r"
#: Initials with a meaning, and another one; faults by number: a symbol is 4 * initial + fault.
INITIALS, (NONE, TRUNCATED, DUPLICATE, BLANK) = "sua-", range(4)
ROLES = {"u": "user", "a": "assistant"}
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3, "truncated": 3}

#: The grammar acceptor of (s?(ua)+)?: state -> initial -> state, from state 0.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = {0, 3}
_LEGAL = {INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in ("su", "ua", "au")}


class Repair:
    """The product of edit transducer and grammar, and the shortest paths of inputs through it."""

    def __init__(self, costs: dict[str, int] | None = None):
        self.costs = COSTS | (costs or {})
        self.arcs: dict[tuple[int, int], list] = {}
        self.steps: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.ends = self._end()

    def edits(self, symbol: int) -> list[tuple[str, str, int]]:
        """The edit transducer's arcs on a symbol: (label, initial that comes out, cost)."""
        initial, fault = INITIALS[symbol // 4], symbol % 4
        out = [("D", "", self.costs["D"])]
        if fault in (NONE, TRUNCATED):
            more = self.costs["truncated"] if fault == TRUNCATED else 0
            out += [("K", initial, self.costs["K"] + more), *(("R", r, self.costs["R"] + more) for r in ROLES)]
        return out

    def inserts(self, state: int) -> list[tuple[str, int, int]]:
        """(labels, cost, state) of insertions only: a state met twice would cost more for nothing, so these are few."""
        out, seen = [("", 0, state)], {state}
        for labels, cost, s in out:
            for r in ROLES:
                if (to := GRAMMAR[s].get(r)) is not None and to not in seen:
                    seen.add(to)
                    out.append((labels + "I", cost + self.costs["I"], to))
        return out

    def through(self, symbol: int, state: int) -> list[tuple[str, int, int]]:
        """(labels, cost, state) of the product's ways from a grammar state over a row: insertions, then one edit."""
        if (symbol, state) not in self.arcs:
            out = []
            for (before, cost, s), (label, initial, more) in product(self.inserts(state), self.edits(symbol)):
                to = s if not initial else GRAMMAR[s].get(initial)
                if to is not None:
                    out.append((before + label, cost + more, to))
            self.arcs[symbol, state] = out
        return self.arcs[symbol, state]

    def _end(self) -> tuple:
        best = [min((cost, labels, s) for labels, cost, s in self.inserts(state) if s in FINAL) for state in GRAMMAR]
        return tuple(b[0] for b in best), tuple(b[1:] for b in best)

    def step(self, rest: tuple, symbol: int) -> int:
        """The number of the step that puts a row before the weights `rest` of the grammar's states: (weights less their least, their least, (labels, state) by state)."""
        key = rest, symbol
        if key not in self.known:
            best = [min((cost + rest[s], labels, s) for labels, cost, s in self.through(symbol, state)) for state in GRAMMAR]
            least = min(b[0] for b in best)
            self.steps.append((tuple(b[0] - least for b in best), least, tuple(b[1:] for b in best)))
            self.known[key] = len(self.steps) - 1
        return self.known[key]

    def path(self, symbols: bytes) -> tuple[int, str]:
        """(cost, labels) of the least path over a conversation's symbols."""
        if not symbols:
            return 0, ""
        rest, cost, taken = self.ends[0], 0, array("l")
        for symbol in reversed(symbols):
            k = self.step(rest, symbol)
            taken.append(k)
            rest, least, _ = self.steps[k]
            cost += least
        state, out = 0, []
        cost += rest[0]
        for k in reversed(taken):
            labels, state = self.steps[k][2][state]
            out.append(labels)
        out.append(self.ends[1][state][0])
        return cost, "".join(out)


class Rewriter:
    """Follows a conversation's labels as its rows pass by. row() and end() give the repaired rows (role, text, label) that come out."""

    def __init__(self, labels: str):
        self.labels, self.at, self.state = labels, 0, 0

    def _inserted(self):
        while self.labels[self.at : self.at + 1] == "I":
            yield self._free(), b"", "I"
            self.at += 1

    def _free(self) -> str:
        """The role of user and assistant that the grammar allows here."""
        initial = next(r for r in ROLES if r in GRAMMAR[self.state])
        self.state = GRAMMAR[self.state][initial]
        return ROLES[initial]

    def row(self, role: str, text: bytes):
        yield from self._inserted()
        label = self.labels[self.at]
        self.at += 1
        if label == "R":
            yield self._free(), text, "R"
        elif label == "K":
            self.state = GRAMMAR[self.state][role[0]]
            yield role, text, "K"

    def end(self):
        yield from self._inserted()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its .!?, 3 repeats it, 4 makes its role user. Nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("_k"))
    d = d.where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_n")).drop("_n")


def _rows(conversations: DataFrame) -> DataFrame:
    """conv (long, a number for null), turn, role, text as bytes and its hash."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    conv = F.coalesce(F.col("conv_id").cast("long"), F.expr("-9223372036854775807L - 1L"))
    return conversations.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("hash"))


_FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _order() -> list:
    """The order of a conversation's rows."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]


def _symbols(rows: DataFrame) -> DataFrame:
    """conv, turn, whether it is null, and symbol of each row."""
    kept = F.rtrim("text", F.lit(SPACE))
    again = F.row_number().over(W.partitionBy("conv", "role", "hash").orderBy(F.col("turn").asc_nulls_first()))
    r = rows.select("conv", "turn", "role", "hash", kept.alias("kept")).select("conv", "turn", "role", "hash", (F.col("kept") == "").alias("blank"), (~F.expr("right(kept, 1)").isin(".", "!", "?")).alias("cut"))
    r = r.withColumn("again", again > 1)
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(NONE)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return r.select("conv", "turn", "role", "hash", "again", (initial * 4 + fault).cast("int").alias("symbol"))


def _facts(costs):
    """Batches of symbols in order -> a row of facts for each conversation."""

    def facts(conv, symbols, low, high, distinct, repair):
        faults = [x % 4 for x in symbols]
        illegal = sum(1 for a, b in zip(symbols, symbols[1:]) if (a // 4) * 4 + b // 4 not in _LEGAL)
        cost, audit = repair.path(bytes(symbols))
        return conv, high - low + 1 - distinct if distinct else 0, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, audit

    def run(batches):
        repair, now, out = Repair(costs), None, []
        symbols, low, high, distinct = bytearray(), 0, 0, 0
        for pdf in batches:
            for conv, symbol, turn, missing in zip(pdf["conv"].tolist(), pdf["symbol"].tolist(), pdf["turn"].tolist(), pdf["no_turn"].tolist()):
                if conv != now:
                    if now is not None:
                        out.append(facts(now, symbols, low, high, distinct, repair))
                    now, symbols, distinct = conv, bytearray(), 0
                if symbol < 0:
                    continue
                symbols.append(symbol)
                if not missing:
                    if not distinct:
                        low, distinct = turn, 1
                    elif turn != high:
                        distinct += 1
                    high = turn
            if out:
                yield pd.DataFrame(out, columns=["conv", *(x.split()[0] for x in _FACTS.split(", "))])
                out = []
        if now is not None:
            yield pd.DataFrame([facts(now, symbols, low, high, distinct, repair)], columns=["conv", *(x.split()[0] for x in _FACTS.split(", "))])

    return run


def _paths(rows: DataFrame, ids: DataFrame | None, costs) -> DataFrame:
    """conv and the facts of its rows, a row for each conversation of rows and ids."""
    s = _symbols(rows)
    if ids is not None:
        own = ids.select(F.coalesce(F.col("conv_id").cast("long"), F.expr("-9223372036854775807L - 1L")).alias("conv")).distinct()
        s = s.unionByName(own.withColumn("symbol", F.lit(-1)), allowMissingColumns=True)
    s = s.repartition("conv").sortWithinPartitions("conv", *_order(), "again")
    light = s.select("conv", "symbol", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"))
    return light.mapInPandas(_facts(costs), "conv long, " + _FACTS)


def _passing(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Facts and rows of a conversation one after another: kind 0, its facts; kind 1, its rows in order."""
    names = [x.split()[0] for x in _FACTS.split(", ")]
    zero = [F.lit("" if n == "audit" else 0).cast(x.split()[1]).alias(n) for n, x in zip(names, _FACTS.split(", "))]
    one = paths.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").cast("binary").alias("text"), F.lit("").cast("binary").alias("hash"), *names)
    two = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", F.col("text").cast("binary").alias("text"), "hash", *zero)
    both = one.unionByName(two).repartition("conv").sortWithinPartitions("conv", "kind", *_order())
    return both.select("conv", "kind", "role", "text", *names)


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("conv_id", F.when(F.col("conv") != F.expr("-9223372036854775807L - 1L"), F.col("conv"))).select("conv_id", *[c for c in df.columns if c != "conv"])


def repair(conversations: DataFrame, ids: DataFrame | None = None, costs: dict[str, int] | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, a row for each conversation and each of ids (conv_id).

    gaps: turns that are missing between the first and the last; illegal: neighbours whose initials are not su, ua or au.
    repaired_sha256: of `role:text` of the repaired rows, joined by line feeds.
    """
    C.prepare(conversations.sparkSession)
    rows, names = _rows(conversations), [x.split()[0] for x in _FACTS.split(", ")]

    def run(batches):
        now = None

        def take(pieces):
            nonlocal first
            for role, text, _ in pieces:
                h.update((b"" if first else b"\n") + role.encode() + b":")
                h.update(text)
                first = False

        def done():
            take(rewriter.end())
            return *now, h.hexdigest()

        out = []
        for pdf in batches:
            for kind, role, text, *facts in zip(pdf["kind"].tolist(), pdf["role"], pdf["text"], *(pdf[c].tolist() for c in ["conv", *names])):
                if kind == 0:
                    if now is not None:
                        out.append(done())
                    now, rewriter, h, first = facts, Rewriter(facts[-1]), hashlib.sha256(), True
                else:
                    take(rewriter.row(role, text))
            if out:
                yield pd.DataFrame(out, columns=["conv", *names, "repaired_sha256"])
                out = []
        if now is not None:
            yield pd.DataFrame([done()], columns=["conv", *names, "repaired_sha256"])

    return _shown(_passing(rows, _paths(rows, ids, costs)).mapInPandas(run, f"conv long, {_FACTS}, repaired_sha256 string"))


def repaired_rows(conversations: DataFrame, costs: dict[str, int] | None = None) -> DataFrame:
    """conv_id, position (from 0), role, text, edit: the repaired conversations themselves, a row each."""
    C.prepare(conversations.sparkSession)
    rows = _rows(conversations)

    def run(batches):
        rewriter, now, at = None, None, 0
        columns = ["conv", "position", "role", "text", "edit"]

        def take(pieces):
            nonlocal at
            for role, text, label in pieces:
                out.append((now, at, role, text.decode("utf-8", "replace"), label))
                at += 1

        for pdf in batches:
            out = []
            for conv, kind, role, text, audit in zip(pdf["conv"].tolist(), pdf["kind"].tolist(), pdf["role"], pdf["text"], pdf["audit"]):
                if kind == 0:
                    if rewriter is not None:
                        take(rewriter.end())
                    rewriter, now, at = Rewriter(audit), conv, 0
                else:
                    take(rewriter.row(role, text))
            yield pd.DataFrame(out, columns=columns)
        if rewriter is not None:
            out = []
            take(rewriter.end())
            yield pd.DataFrame(out, columns=columns)

    return _shown(_passing(rows, _paths(rows, None, costs)).mapInPandas(run, "conv long, position long, role string, text string, edit string"))
