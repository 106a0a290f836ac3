"""Chat formatting by minimum-cost role repair.

The legal turns form an automaton: start -> system, start or system or assistant -> user,
user -> assistant; a conversation may end before its first turn, after a user or after an assistant.
A message is taken as it is (0), merged into the turn before it (1), relabelled (2; 1 if its role is
unknown), both, or preceded by an empty turn of the role that is missing (3).  Dynamic programming over
the automaton's states finds the cheapest repair; ties go to the option that is first in that order.

Scale.  Messages are dealt by range of (conversation, turn), so a conversation of any size is spread
over partitions.  The cost of a stretch of messages is a 4x4 matrix of the min-plus semiring; the
matrices of the stretches that partition edges cut, at most two a partition, give the costs at every
edge.  From those each cut stretch finds, for every state it may be left in, the state in which it is
entered; chained from the end these give every stretch its states, by the same choices as one pass over
the whole conversation makes.  So the result is the same however messages are dealt.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import in_small_batches, parts_by_bytes, trimmed
from .graph import ensure_checkpoint_dir

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("system", "user", "assistant")
UNKNOWN = "unknown"
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 2, 1, 3
NEVER = 10**9
MAY_END = (START, USER, ASSISTANT)
STATE_OF = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
FOLLOWS = {START: ("system", "user"), SYSTEM: ("user",), USER: ("assistant",), ASSISTANT: ("user",)}
KNOWN = 4096
#: Messages in a row of the result at most.
PART = 10_000


def role_of(role: str | None) -> str:
    """The role as the automaton knows it: lower-cased and trimmed, anything else is unknown."""
    role = (role or "").strip().lower()
    return role if role in STATE_OF else UNKNOWN


@lru_cache(None)
def options(state: int, role: str) -> tuple[tuple[int, int, str, str, str], ...]:
    """(cost, next state, action, role given, role inserted before) of a message, in order of preference."""
    out = []
    for given in (role, *[r for r in ROLES if r != role]):
        if given == UNKNOWN:
            continue
        change = 0 if given == role else RELABEL_UNKNOWN if role == UNKNOWN else RELABEL
        word = "relabel" if change else "keep"
        if given in FOLLOWS[state]:
            out.append((change, STATE_OF[given], word, given, ""))
        if state == STATE_OF[given]:
            out.append((change + MERGE, state, "relabel+merge" if change else "merge", given, ""))
        for between in FOLLOWS[state]:
            if given in FOLLOWS[STATE_OF[between]]:
                out.append((change + INSERT, STATE_OF[given], word, given, between))
    rank = {"keep": 0, "merge": 1, "relabel": 2, "relabel+merge": 3}
    return tuple(sorted(out, key=lambda o: (rank[o[2]] + 4 * bool(o[4]), o[0], ROLES.index(o[3]))))


@lru_cache(None)
def matrix(role: str) -> np.ndarray:
    """Least cost from state to state over one message."""
    m = np.full((4, 4), NEVER, np.int64)
    for s in range(4):
        for cost, to, *_ in options(s, role):
            m[s, to] = min(m[s, to], cost)
    return m


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product: one stretch after another."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), NEVER)


FRESH = (0, NEVER, NEVER, NEVER)


def repair(roles: tuple[str, ...], costs: tuple[int, ...] = FRESH, leave: int | None = None) -> tuple[int, int, tuple[tuple[str, str, str], ...]]:
    """The least cost, the state entered in, and each message's (action, role given, role inserted before).

    ``costs`` are those of the states before the first message.  ``leave`` is the state to end in; None is
    the cheapest in which a conversation may end.  On ties the earliest listed state goes first, at the end
    and then message by message backwards, and of one state's options the preferred one.
    """
    cost = list(costs)
    back = []
    for role in roles:
        best = [NEVER] * 4
        step: list = [None] * 4
        for s in range(4):
            if cost[s] < NEVER:
                for o in options(s, role):
                    total = cost[s] + o[0]
                    if total < best[o[1]]:
                        best[o[1]], step[o[1]] = total, (s, o)
        cost = best
        back.append(step)
    state = min(MAY_END, key=lambda s: cost[s]) if leave is None else leave
    total, path = cost[state], []
    for step in reversed(back):
        state, o = step[state]
        path.append((o[2], o[3], o[4]))
    return total - costs[state], state, tuple(reversed(path))


def entries(roles: tuple[str, ...], costs: tuple[int, ...]) -> list[int]:
    """For each state to leave in, the state in which ``repair`` enters; -1 for one that cannot be left in."""
    cost, at = list(costs), list(range(4))
    for role in roles:
        best, came = [NEVER] * 4, [-1] * 4
        for s in range(4):
            if cost[s] < NEVER:
                for o in options(s, role):
                    if cost[s] + o[0] < best[o[1]]:
                        best[o[1]], came[o[1]] = cost[s] + o[0], at[s]
        cost, at = best, came
    return at


@lru_cache(KNOWN)
def known_repair(roles: tuple[str, ...]):
    """``repair`` of a whole conversation, remembered: short role sequences recur."""
    return repair(roles)


def _mark(role: str) -> str:
    return f"<|{role}|>\n"


CLOSE = "<|end|>\n"


def render(texts: list[str], path: tuple[tuple[str, str, str], ...], entry: int, last: bool) -> str:
    """The repaired turns of a stretch; merged messages are joined by a blank line."""
    out, is_open = [], entry != START
    for text, (action, role, before) in zip(texts, path, strict=True):
        if action.endswith("merge"):
            out.append("\n\n" + text)
            continue
        if is_open:
            out.append(CLOSE)
        if before:
            out += [_mark(before), CLOSE]
        out += [_mark(role), text]
        is_open = True
    if last and is_open:
        out.append(CLOSE)
    return "".join(out)


def _stretches(batches, *columns: str):
    """(partition, conversation, whether it is the partition's first or last, rows) of each conversation of a sorted partition, in order."""
    pid, held, number = 0, [], 0
    for b in batches:
        if b.num_rows:
            pid = b.column("pid")[0].as_py()
            for row in zip(b.column("conv").to_pylist(), *[b.column(c).to_pylist() for c in columns], strict=True):
                if held and held[0][0] != row[0]:
                    yield pid, held[0][0], number == 0, held
                    held, number = [], number + 1
                held.append(row)
    if held:
        yield pid, held[0][0], True, held


def _edges(batches):
    """Role matrix and size of a partition's first and last conversation."""
    for pid, conv, edge, rows in _stretches(batches, "role"):
        if edge:
            m = None
            for _, role in rows:
                one = matrix(role_of(role))
                m = one if m is None else join(m, one)
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([conv], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.int64()))], ["pid", "conv", "size", "m"])


def cut_costs(edges: list[tuple[int, int | None, int, np.ndarray]]) -> dict[int | None, list[tuple[int, int, tuple[int, ...], tuple[int, ...]]]]:
    """For each cut conversation its stretches: partition, messages before, costs before and after."""
    out = {}
    for conv, group in groupby(sorted(edges, key=lambda x: x[0]), key=lambda x: x[1]):
        chain = list(group)
        if len(chain) > 1:
            costs, before, parts = np.array(FRESH), 0, []
            for pid, _, size, m in chain:
                after = np.minimum((costs[:, None] + m).min(0), NEVER)
                parts.append((pid, before, tuple(costs.tolist()), tuple(after.tolist())))
                costs, before = after, before + size
            out[conv] = parts
    return out


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """conv_id, part, n_messages, n_turns, cost, merges, relabels, inserts, roles, rendered.

    One row a conversation (part 0); one of more than PART messages has a row for each PART of them, to be
    read in order of part.  Messages go by turn, ties by role and text; a null turn comes first, a null role
    is unknown, a null text empty, and rows with a null id are one conversation.  Repeated rows are messages
    of their own; an empty table gives no rows.  Other columns are not looked at.  ``parts`` partitions, or
    as many as the texts' bytes ask for, change nothing but the work's layout: equal messages are told apart by
    a row number, the last key of the range, so that they too are spread; which of them gets which place is all the same.
    """
    spark = turns.sparkSession
    ensure_checkpoint_dir(spark)
    own = in_small_batches(turns).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "text", "tie")]
    count = parts or parts_by_bytes(own, "role", "text")
    dealt = own.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(count, *order).sortWithinPartitions(*order).drop("tie").withColumn("pid", F.spark_partition_id()).checkpoint()
    found = dealt.select("pid", "conv", "role").mapInArrow(_edges, "pid int, conv long, size long, m array<long>").collect()
    chains = cut_costs([(r["pid"], r["conv"], r["size"], np.array(r["m"], np.int64).reshape(4, 4)) for r in found])
    cut = {(pid, conv): costs for conv, chain in chains.items() for pid, _, costs, _ in chain}

    def ways(batches):
        for pid, conv, edge, rows in _stretches(batches, "role"):
            if edge and (pid, conv) in cut:
                way = entries(tuple(role_of(r[1]) for r in rows), cut[pid, conv])
                yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([conv], pa.int64()), pa.array([way], pa.list_(pa.int32()))], ["pid", "conv", "way"])

    entered = {(r["pid"], r["conv"]): r["way"] for r in dealt.select("pid", "conv", "role").mapInArrow(ways, "pid int, conv long, way array<int>").collect()} if cut else {}
    leave: dict[tuple[int, int | None], tuple[int, int, bool]] = {}  # messages before, state to leave in, whether it is the last stretch
    for conv, chain in chains.items():
        state = min(MAY_END, key=lambda s: chain[-1][3][s])
        for k in range(len(chain) - 1, -1, -1):
            pid, before, *_ = chain[k]
            leave[pid, conv] = (before, state, k == len(chain) - 1)
            state = entered[pid, conv][state]

    def row_of(conv, part, rows, cost, path, entry, last):
        actions = [a for a, _, _ in path]
        names = [n for (a, r, x) in path if not a.endswith("merge") for n in ([x] if x else []) + [r]]
        merges, relabels = sum(a.endswith("merge") for a in actions), sum(a.startswith("relabel") for a in actions)
        return (conv, part, len(rows), len(names), cost, merges, relabels, sum(bool(x) for _, _, x in path), ",".join(names), render([r[2] for r in rows], path, entry, last))

    def pieces(pid, conv, rows):
        """Rows of a conversation or stretch, one for each part of PART messages that it reaches into."""
        roles = tuple(role_of(r[1]) for r in rows)
        before, state, last = leave.get((pid, conv), (0, None, True))
        costs = cut.get((pid, conv), FRESH)
        cost, entry, path = known_repair(roles) if state is None and len(roles) < 64 else repair(roles, costs, state)
        at = 0
        while at < len(rows):
            part = (before + at) // PART
            stop = min(len(rows), (part + 1) * PART - before)
            spent, after = 0, entry
            for role, (action, given, between) in zip(roles[at:stop], path[at:stop], strict=True):
                o = next(o for o in options(after, role) if o[2:] == (action, given, between))
                spent, after = spent + o[0], o[1]
            yield row_of(conv, part, rows[at:stop], spent, path[at:stop], entry, last and stop == len(rows))
            at, entry = stop, after

    def table(out):
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], NAMES)

    def whole(batches):
        out = []
        for pid, conv, edge, rows in _stretches(batches, "role", "text"):
            if not (edge and (pid, conv) in cut):
                out += pieces(pid, conv, rows)
                if sum(len(x[-1]) for x in out[-1:]) > 1 << 20 or len(out) >= 256:
                    yield table(out)
                    out = []
        if out:
            yield table(out)

    def stretches(batches):
        for pid, conv, edge, rows in _stretches(batches, "role", "text"):
            if edge and (pid, conv) in cut:
                made = table(list(pieces(pid, conv, rows)))
                yield made.append_column("pid", pa.array([pid] * made.num_rows, pa.int32()))

    schema = "conv_id long, part int, n_messages long, n_turns long, cost long, merges long, relabels long, inserts long, roles string, rendered string"
    done = dealt.mapInArrow(trimmed(whole), schema)
    if not cut:
        return done
    # of a part no more than PART messages come together, however large its conversation
    ordered = F.sort_array(F.collect_list(F.struct("pid", "roles", "rendered")))
    joined = dealt.mapInArrow(trimmed(stretches), schema + ", pid int").groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in NAMES[2:8]], ordered.alias("x"))
    joined = joined.select(*NAMES[:8], F.expr("array_join(filter(x.roles, r -> r <> ''), ',')").alias("roles"), F.expr("array_join(x.rendered, '')").alias("rendered"))
    return done.unionByName(joined)


NAMES = ["conv_id", "part", "n_messages", "n_turns", "cost", "merges", "relabels", "inserts", "roles", "rendered"]

#: The same by plain SQL: for every message and state the cheapest repair so far, with its counts and text; a conversation of at most PART messages is one row.
SQL = r"""
WITH RECURSIVE o(s, role, pref, cost, t, merge, relabel, given, between) AS (VALUES @OPTIONS@),
m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  CASE WHEN lower(trim(role)) IN ('system', 'user', 'assistant') THEN lower(trim(role)) ELSE 'unknown' END AS role, coalesce(text, '') AS text FROM conversations),
p AS (
  SELECT conv_id, 0::BIGINT AS i, n, 0 AS s, 0::BIGINT AS cost, 0::BIGINT AS merges, 0::BIGINT AS relabels, 0::BIGINT AS inserts, '' AS roles, '' AS rendered FROM m WHERE i = 1
  UNION ALL
  SELECT conv_id, i, n, s, cost, merges, relabels, inserts, roles, rendered FROM (
    SELECT m.conv_id, m.i, m.n, o.t AS s, p.cost + o.cost AS cost, merges + o.merge AS merges, relabels + o.relabel AS relabels, inserts + (between <> '')::INT AS inserts,
      CASE WHEN o.merge = 1 THEN roles ELSE concat_ws(',', nullif(roles, ''), nullif(between, ''), given) END AS roles,
      rendered || CASE WHEN o.merge = 1 THEN chr(10) || chr(10) || text ELSE
        CASE WHEN p.s <> 0 THEN '<|end|>' || chr(10) ELSE '' END || CASE WHEN between <> '' THEN '<|' || between || '|>' || chr(10) || '<|end|>' || chr(10) ELSE '' END || '<|' || given || '|>' || chr(10) || text END AS rendered,
      row_number() OVER (PARTITION BY m.conv_id, o.t ORDER BY p.cost + o.cost, p.s, o.pref) AS best
    FROM p JOIN m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1 JOIN o ON o.s = p.s AND o.role = m.role) WHERE best = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, s) AS best FROM p WHERE i = n AND s <> 1)
SELECT conv_id, 0::INT AS part, n AS n_messages, (n - merges + inserts)::BIGINT AS n_turns, cost, merges, relabels, inserts, roles, rendered || '<|end|>' || chr(10) AS rendered FROM e WHERE best = 1
"""


def oracle_sql() -> str:
    """The oracle, with the automaton's moves as rows."""
    rows = [(s, role, k, o[0], o[1], int(o[2].endswith("merge")), int(o[2].startswith("relabel")), o[3], o[4]) for s in range(4) for role in (*ROLES, UNKNOWN) for k, o in enumerate(options(s, role))]
    return SQL.replace("@OPTIONS@", ", ".join(map(str, rows)))
