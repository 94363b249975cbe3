"""Structure repair of conversations: a run-length dynamic program over rows of any number.

A repaired conversation is empty, or one optional system row and then pairs of user and assistant. Four states
read that: 0 at the start, 1 after the system row, 2 after a user, 3 after an assistant; 0 and 3 may end. A row is a
symbol (its role's initial and its fault), a symbol a matrix of least costs between states, and rows in
sequence the min-plus product of their matrices. Equal consecutive symbols are one run, whose matrix is made of cached
binary powers. Since the product is associative, a conversation is cut into segments (where a task or SEGMENT rows
end), the segments' matrices are multiplied, and only then the choices are unrolled in each segment: the edits of
a row from each of the four states, so that no segment waits for another. A last pass in order walks through them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

#: Costs of the edits; a truncated row that stays adds STAYS.
DELETE, REROLE, INSERT, STAYS = 4, 3, 3, 3
BLANKS = " \t\n\x0b\f\r"
FAR = 1 << 60
#: A symbol is three times the initial's place in INITIALS (3: another) plus the fault: 0 none, 1 truncated. GONE must go.
INITIALS, GONE = "sua", 12
#: The state that a user or an assistant leads to, whichever the state asks for.
STEP = (2, 2, 3, 2)
#: Least cost to end in each state.
AT_END = (0, 2 * INSERT, INSERT, 0)
ROLE = {2: "user", 3: "assistant"}
#: Rows of a segment at most; a conversation has one more segment for each task its rows come from.
SEGMENT = 1 << 17


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times of the rows, by crc32 of ``conv_id:turn`` mod 20: 0 drops a row, 1 empties
    its text, 2 takes its ``.!?`` away, 3 repeats it (times is 2), 4 makes its role user. A null role, text, or part
    of that key is one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    return given.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("times"))


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def _inserts() -> np.ndarray:
    """Least cost from state to state by inserts alone."""
    one = np.full((4, 4), FAR)
    np.fill_diagonal(one, 0)
    for q, to in enumerate(STEP):
        one[q, to] = min(one[q, to], INSERT)
    return _merge(one, one)


def edits_of(symbol: int) -> dict[str, tuple[int, tuple[int | None, ...]]]:
    """The cost of each edit of a row, and the state that it leads to from each state."""
    out: dict[str, tuple[int, tuple[int | None, ...]]] = {"D": (DELETE, (0, 1, 2, 3))}
    if symbol != GONE:
        more, initial = STAYS * (symbol % 3), (*INITIALS, "")[symbol // 3]
        out["K"] = (more, {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}.get(initial, (None,) * 4))
        out["R"] = (REROLE + more, STEP)
    return out


@lru_cache(4096)
def power(symbol: int, k: int) -> np.ndarray:
    """The matrix of 2 ** k rows of one symbol, inserts before each included."""
    if k:
        return _merge(power(symbol, k - 1), power(symbol, k - 1))
    own = np.full((4, 4), FAR)
    for cost, to in edits_of(symbol).values():
        for q, state in enumerate(to):
            if state is not None:
                own[q, state] = min(own[q, state], cost)
    return _merge(_inserts(), own)


@lru_cache(4096)
def run_matrix(symbol: int, length: int) -> np.ndarray:
    """The matrix of a run, from the powers of its length's bits."""
    parts = [power(symbol, k) for k in range(length.bit_length()) if length >> k & 1]
    out = parts[0]
    for p in parts[1:]:
        out = _merge(out, p)
    return out


@lru_cache(1 << 16)
def choices(symbol: int, times: int, after: tuple[int, ...]) -> tuple[str, tuple[int, ...]]:
    """What to do with a row (and ``times`` - 1 copies behind it) from each of the four states, and the costs to the end
    before it, from those after it. Of the cheapest edits the ASCII-least: letters, then the state they lead to."""
    after = tuple(x + DELETE * (times - 1) for x in after)
    edits = sorted(edits_of(symbol).items())
    before = (power(symbol, 0) + np.array(after)).min(1).tolist()
    said = []
    for q in range(4):
        letters, at = "", q
        while True:
            found = [(e, to[at]) for e, (cost, to) in edits if to[at] is not None and cost + after[to[at]] == before[at]]
            insert = INSERT + before[STEP[at]] == before[at]
            if insert and (not found or found[0][0] > "I"):
                letters, at = letters + "I", STEP[at]
                continue
            said.append(f"{letters}{found[0][0]}{found[0][1]}")
            break
    return ",".join(said), tuple(before)


def _same(column: pa.Array, last) -> np.ndarray:
    """Whether each value equals the one before it (``last`` for the first); nulls are equal."""
    values, nulls = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros(len(values), bool)
    out[1:] = (values[1:] == values[:-1]) & (nulls[1:] == nulls[:-1])
    out[0] = last is not _NONE and last == column[0].as_py()
    return out


_NONE = object()
FACTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
ENDS = ["first_kind", "last_kind", "least", "most"]
WIDE = "conv_id long, turn long, role string, digest string, times long, symbol int, seg long, pos long, matrix array<long>, " + ", ".join(f"{c} long" for c in FACTS + ENDS)


class Segment:
    """Sums of a segment's rows, added in order."""

    def __init__(self, conv: int | None, seg: int):
        self.conv, self.seg, self.matrix, self.counts = conv, seg, None, dict.fromkeys(FACTS, 0)
        self.ends = dict.fromkeys(ENDS)

    def add(self, symbols: np.ndarray, times: np.ndarray, kinds: np.ndarray, faults: np.ndarray, turns: pa.Array) -> None:
        lengths = np.stack([np.ones_like(times), times - 1], 1).ravel()
        all_symbols = np.stack([symbols, np.full_like(symbols, GONE)], 1).ravel()[lengths > 0]
        lengths = lengths[lengths > 0]
        first = np.flatnonzero(np.concatenate([[True], all_symbols[1:] != all_symbols[:-1]]))
        for symbol, n in zip(all_symbols[first].tolist(), np.add.reduceat(lengths, first).tolist(), strict=True):
            m = run_matrix(symbol, n)
            self.matrix = m if self.matrix is None else _merge(self.matrix, m)
        copies = times - 1
        is_blank = faults == 1
        self.counts["blank"] += int(times[is_blank].sum())
        self.counts["duplicate"] += int((faults == 2).sum() + copies[~is_blank].sum())
        self.counts["truncated"] += int((faults == 3).sum())
        seen = kinds if self.ends["last_kind"] is None else np.concatenate([[self.ends["last_kind"]], kinds])
        self.counts["illegal"] += int(copies.sum()) + int((~legal(seen[:-1], seen[1:])).sum())
        if self.ends["first_kind"] is None:
            self.ends["first_kind"] = int(kinds[0])
        self.ends["last_kind"] = int(kinds[-1])
        known = turns.drop_null().to_numpy(zero_copy_only=False)
        if len(known):
            self.counts["turns"] += int((known[1:] != known[:-1]).sum()) + (self.ends["most"] is None or int(known[0]) != self.ends["most"])
            self.ends["least"] = int(known[0]) if self.ends["least"] is None else self.ends["least"]
            self.ends["most"] = int(known[-1])


def legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether initial b may follow a: su, ua or au."""
    return (a == 0) & (b == 1) | (a == 1) & (b == 2) | (a == 2) & (b == 1)


def segments(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (sorted in each partition) with their segment and place, and a row of sums a segment."""
    names = [f.split()[0] for f in WIDE.replace("array<long>", "longs").split(", ")]
    kept = ["conv_id", "turn", "role", "digest", "times", "symbol"]

    def run(batches):
        task, n_segs, in_conv, last, now = TaskContext.get().partitionId(), -1, 0, _NONE, None
        types = {"role": pa.string(), "digest": pa.string(), "symbol": pa.int32(), "matrix": pa.list_(pa.int64())}

        def out(**columns):
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[c].cast(types.get(c, pa.int64())) if c in columns else pa.nulls(n, types.get(c, pa.int64())) for c in names], names=names)

        def closed(s: Segment):
            one = {"conv_id": s.conv, "seg": s.seg, "matrix": s.matrix.ravel().tolist(), **s.counts, **s.ends}
            return out(**{k: pa.array([v], types.get(k, pa.int64())) for k, v in one.items()})

        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0)
            new = ~_same(conv, last)
            at = np.arange(len(new))
            start = np.maximum.accumulate(np.where(new, at, -in_conv))
            place = at - start
            breaks = new | (place % SEGMENT == 0)
            seg = (task << 40) + n_segs + np.cumsum(breaks)
            last, in_conv, n_segs = conv[-1].as_py(), int(place[-1]) + 1, n_segs + int(breaks.sum())
            by = dict(zip(batch.schema.names, batch.columns, strict=True))
            yield out(**{c: by[c] for c in kept}, seg=pa.array(seg), pos=pa.array(place))
            symbols, times, kinds, faults = (by[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("symbol", "times", "kind", "fault"))
            edges = np.flatnonzero(breaks).tolist()
            for a, b in zip([0, *edges], [*edges, len(new)], strict=True):
                if a == b:
                    continue
                if now is None or int(seg[a]) != now.seg:
                    if now is not None:
                        yield closed(now)
                    now = Segment(conv[a].as_py(), int(seg[a]))
                now.add(symbols[a:b], times[a:b], kinds[a:b], faults[a:b], by["turn"].slice(a, b - a))
        if now is not None:
            yield closed(now)

    return rows.mapInArrow(run, WIDE)


def conversations(sums: DataFrame, partitions: int) -> DataFrame:
    """From the sums of segments: a row a segment with the costs to the end after it (seg, after), and a row a
    conversation (seg null) with gaps, blank, duplicate, truncated, illegal and cost. Only the segments of one
    conversation are held, some 300 bytes for 2^17 rows."""
    facts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", "seg", "after", *facts]

    def solved(parts: list[dict]) -> list[dict]:
        after, out = np.array(AT_END), []
        for p in reversed(parts):
            out.append({"seg": p["seg"], "after": after.tolist()})
            after = (np.array(p["matrix"]).reshape(4, 4) + after).min(1)
        total = {c: sum(p[c] for p in parts) for c in FACTS}
        most, least = None, None
        for a, b in zip([None, *parts], parts, strict=False):
            if a is not None and not legal(np.array([a["last_kind"]]), np.array([b["first_kind"]]))[0]:
                total["illegal"] += 1
            total["turns"] -= b["least"] is not None and b["least"] == most
            least = b["least"] if least is None else least
            most = b["most"] if b["most"] is not None else most
        gaps = 0 if most is None else most - least + 1 - total["turns"]
        return [*out, {"conv_id": parts[0]["conv_id"], "gaps": gaps, "cost": int(after[0]), **{c: total[c] for c in facts if c in total}}]

    def run(batches):
        parts: list[dict] = []
        schema = pa.schema([(c, pa.list_(pa.int64()) if c == "after" else pa.int64()) for c in names])
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                if parts and parts[0]["conv_id"] != r["conv_id"]:
                    out += solved(parts)
                    parts = []
                parts.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if parts:
            yield pa.RecordBatch.from_pylist(solved(parts), schema)

    dealt = sums.select("conv_id", "seg", "matrix", *FACTS, *ENDS).repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "seg")
    return dealt.mapInArrow(run, "conv_id long, seg long, after array<long>, " + ", ".join(f"{c} long" for c in facts))


def unrolled(rows: DataFrame, ends: DataFrame, partitions: int) -> DataFrame:
    """The rows with ``say``: their edits from each of the four states, found from a segment's end backwards."""
    dealt = rows.join(ends.select("seg", "after"), "seg").repartition(partitions, "seg").sortWithinPartitions("seg", F.col("pos").desc())
    names = ["conv_id", "turn", "role", "digest", "times", "say"]

    def run(batches):
        seg, costs = None, ()
        for batch in batches:
            said = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("seg", "symbol", "times")]
            after = batch.column(batch.schema.get_field_index("after"))
            for i, (s, symbol, times) in enumerate(zip(*columns, strict=True)):
                if s != seg:
                    seg, costs = s, tuple(after[i].as_py())
                low = min(costs)  # choices follow from the differences alone, so few are ever worked out
                one, costs = choices(symbol, times, tuple(c - low for c in costs))
                said.append(one)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names[:-1]], pa.array(said, pa.string())], names=names)

    return dealt.mapInArrow(run, "conv_id long, turn long, role string, digest string, times long, say string")


def walked(decided: DataFrame, texts: DataFrame, partitions: int) -> DataFrame:
    """conv_id, place, edit, role and text of every edit in order, rows of a conversation together and sorted; role and
    text are those after the edit, and the old ones where it deletes."""
    key = ["conv_id", "turn", "role", "digest"]
    both = decided.select(*key, F.lit(0).alias("which"), "times", "say", F.lit(None).cast("string").alias("text")).unionByName(
        texts.select(*key, F.lit(1).alias("which"), F.lit(None).cast("long").alias("times"), F.lit(None).cast("string").alias("say"), "text"))
    dealt = both.repartition(partitions, "conv_id").sortWithinPartitions(*key, "which")

    def run(batches):
        conv, state, place, open_row = _NONE, 0, 0, None
        out: list[tuple] = []

        def put(edit, role, text):
            nonlocal place
            out.append((conv, place, edit, role, text))
            place += 1

        def ended():
            nonlocal state
            while conv is not _NONE and state in (1, 2):
                state = STEP[state]
                put("I", ROLE[state], "")

        def packed():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "edit", "role", "text"])

        for batch in batches:
            by = dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns), strict=True))
            for c, role, which, times, say, text in zip(by["conv_id"], by["role"], by["which"], by["times"], by["say"], by["text"], strict=True):
                if which == 0:
                    if conv is _NONE or c != conv:
                        ended()
                        conv, state, place = c, 0, 0
                    open_row = (times, say)
                    continue
                if open_row is None:  # a repeated row, which its copies above stand for
                    continue
                (times, say), open_row = open_row, None
                say = say.split(",")[state]
                for letter in say[:-2]:
                    state = STEP[state]
                    put(letter, ROLE[state], "")
                letter, state = say[-2], int(say[-1])
                put(letter, ROLE[state] if letter == "R" else role, text)
                for _ in range(times - 1):
                    put("D", role, text)
                    if len(out) >= 4096:
                        yield packed()
                if len(out) >= 4096:
                    yield packed()
            if out:  # texts of one batch at most
                yield packed()
        ended()
        if out:
            yield packed()

    return dealt.mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256 of edits that stand in order, conversations together: a running hash."""

    def run(batches):
        conv, letters, sha, lines = _NONE, [], None, 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(letters)], pa.string()), pa.array([sha.hexdigest()], pa.string())], names=["conv_id", "audit", "repaired_sha256"])
        for batch in batches:
            for c, _, edit, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if conv is _NONE or c != conv:
                    if conv is not _NONE:
                        yield pack()
                    conv, letters, sha, lines = c, [], hashlib.sha256(), 0
                letters.append(edit)
                if edit != "D":
                    sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "replace"))
                    lines += 1
        if conv is not _NONE:
            yield pack()

    return edits.mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def _symbols(rows: DataFrame) -> DataFrame:
    """One row of equal rows (conv_id, turn, role, digest, times) with kind, fault (1 blank, 2 duplicate, 3 truncated) and symbol."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    last = F.when(end == "", 1).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    light = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "times", last.alias("fault"))
    equal = cut(light.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("times").alias("times"), F.min("fault").alias("fault")))
    # The first place of a text is looked up by that place, so that a text said a million times is dealt to many tasks.
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = equal.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("t")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("t.turn").alias("t"))
    here = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    marked = equal.join(first, here, "left").withColumn("fault", F.when((F.col("fault") != 1) & F.col("d").isNull(), 2).otherwise(F.col("fault")))
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    symbol = F.when(F.col("fault").isin(1, 2), GONE).otherwise(3 * kind + F.when(F.col("fault") == 3, 1).otherwise(0))
    return marked.select("conv_id", "turn", "role", "digest", "times", kind.alias("kind"), "fault", symbol.alias("symbol"))


def solve(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (conv_id, turn, role, text, times): the edits of every conversation (see walked), and its counts
    (conv_id, gaps, blank, duplicate, truncated, illegal, cost).

    Rows are taken by turn, nulls first, equal turns by role and by the md5 of the text; null conv_id is a
    conversation. A conversation of any size is sorted and solved over many tasks; only the last walk, whose hash is
    one sequence, takes its rows one after the other in one task, and holds a batch of them.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "digest"]
    ranged = _symbols(rows).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    found = cut(segments(ranged))
    solved = cut(conversations(found.where(F.col("matrix").isNotNull()), partitions))
    decided = unrolled(found.where(F.col("matrix").isNull()).select(*order, "times", "symbol", "seg", "pos"), solved.where(F.col("seg").isNotNull()), partitions)
    return walked(decided, rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "text"), partitions), solved.where(F.col("seg").isNull()).drop("seg", "after")


def _by_conv(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("conv_id", "_pg_conv")
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("_pg_conv")), "left").drop("_pg_conv")


def report(conversations: DataFrame) -> DataFrame:
    """What damage() leaves of each conversation, counted, and its cheapest repair: audit and digest.

    Every conv_id of the input, null included, gives one row; one without rows after the damage has zeros, an empty audit
    and the digest of nothing. Null and long texts, ties and repeated rows: see damage() and solve(). Other
    columns are not read. An empty table gives no rows.
    """
    edits, counts = solve(damage(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = _by_conv(_by_conv(ids, counts), digests(edits))
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The same rows by a backward program over whole strings, one recursive step a row."""
    put = lambda row, cost, letter, line: f"{{'c': ({row}).c + {cost}, 'a': '{letter}' || ({row}).a, 't': " + (f"list_prepend({line}, ({row}).t)" if line else f"({row}).t") + "}"
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
    base = []
    for q in range(4):
        options = [put(f"q{q}", DELETE, "D", None)]
        options += [f"CASE WHEN stays AND kind = '{k}' THEN {put(f'q{to}', 'more', 'K', 'line')} END" for k, to in keeps[q]]
        options.append(f"CASE WHEN stays THEN {put(f'q{step[q]}', f'{REROLE} + more', 'R', f"'{ROLE[step[q]]}:' || text")} END")
        base.append(f"least({', '.join(options)}) AS b{q}")
    insert = lambda q, of: f"least(b{q}, {put(of, INSERT, 'I', f"'{ROLE[step[q]]}:'")}) AS "
    return f"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d
  FROM conversations, tab),
hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM given WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM hurt),
judged AS (
  SELECT *, left(role, 1) AS kind, role || ':' || text AS line, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
    CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM (SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM placed)),
back AS (
  SELECT conv_id, max(i) AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS q0,
    {{'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS q1, {{'c': 3::BIGINT, 'a': 'I', 't': ['assistant:']}} AS q2,
    {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS q3
  FROM judged GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i - 1, {insert(0, 'x2')}q0, {insert(1, 'x2')}q1, x2, {insert(3, 'b2')}q3 FROM (
    SELECT *, {insert(2, 'b3')}x2 FROM (
      SELECT conv_id, i, {', '.join(base)} FROM (
        SELECT b.*, j.kind, j.text, j.line, j.fault IN ('', 't') AS stays, CASE WHEN j.fault = 't' THEN {STAYS} ELSE 0 END AS more
        FROM back b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i)))),
best AS (SELECT conv_id, q0 FROM back WHERE i = 0),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE i > 1 AND prev || kind NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(q0.c, 0)::BIGINT AS cost,
  coalesce(q0.a, '') AS audit, sha256(coalesce(array_to_string(q0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL = _sql()


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
