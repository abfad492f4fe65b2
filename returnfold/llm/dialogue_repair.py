"""Repair of conversations by a suffix-shared automaton.

A conversation is a word of row symbols: the initial of its role and its fault. Words are shared from
their ends: sorted by the reversed word, those that end alike lie together, so each suffix is one node
of the automaton, at which the cheapest way on and its audit are worked out once for each state of the
grammar, whichever conversations pass there. Words are dealt by ranges of (reversed word, conversation),
so a word that very many conversations share is split over tasks. A task keeps the nodes of one path.

Conversations of more than BLOCK rows are cut into blocks from their end. What a block costs from each
state to each is a small matrix; these are put together from the last block to the first, which gives
the cost to go behind each block, and then from the first to the last, which gives the state before it.

Rows are ordered by turn (nulls first), then role, then the MD5 of the text. A null role or text is one
space. A role whose first letter is not s, u or a, or which is empty, can't be kept. Rows without a
conv_id are one conversation. Repeated rows are duplicates. Columns but conv_id, turn, role and text are
left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

BLOCK = 1024
SPACE = " \t\n\x0b\f\r"
#: Costs of edits, and of a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: State -> where an inserted or reroled row leads.
TURN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: (state, initial) -> where a kept row leads.
KEEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: The node behind the last row: for each state (cost to go, audit, last state).
END = ((0, "", START), (2 * INSERT, "II", AFTER_A), (INSERT, "I", AFTER_A), (0, "", AFTER_A))
#: Symbols: "-" must go; s, u, a, o (other role) are sound; S, U, A, O are truncated.
GONE = "-"


def node(symbol: str, then: tuple) -> tuple:
    """The node of symbol before the node then: for each state the least (cost, audit, last state)."""
    late, initial = TRUNCATED * symbol.isupper(), symbol.lower()
    best = []
    for s in range(4):
        cost, audit, last = then[s]
        ways = [(cost + DELETE, "D" + audit, last)]
        if symbol != GONE:
            cost, audit, last = then[TURN[s]]
            ways.append((cost + REROLE + late, "R" + audit, last))
            if (s, initial) in KEEP:
                cost, audit, last = then[KEEP[s, initial]]
                ways.append((cost + late, "K" + audit, last))
        best.append(min(ways))
    # before the row, up to two inserted ones
    best[AFTER_U], best[AFTER_A] = (min(best[s], _inserted(best[TURN[s]])) for s in (AFTER_U, AFTER_A))
    best[START], best[AFTER_S] = (min(best[s], _inserted(best[AFTER_U])) for s in (START, AFTER_S))
    return tuple(best)


def _inserted(way: tuple) -> tuple:
    return way[0] + INSERT, "I" + way[1], way[2]


class Path:
    """The nodes of one reversed word; the next word keeps those of the part that it shares."""

    def __init__(self):
        self.word, self.after, self.nodes = "", None, [END]
        self.made = 0

    def first(self, word: str, after: tuple | None = None) -> tuple:
        """The node of the whole reversed word; after is the cost to go from each state behind its last row, if rows follow."""
        shared = 0
        if after != self.after:
            self.nodes, self.after = [END if after is None else tuple((c, "", s) for s, c in enumerate(after))], after
        else:
            most = min(len(word), len(self.word))
            while shared < most and word[shared] == self.word[shared]:
                shared += 1
            del self.nodes[shared + 1 :]
        for symbol in word[shared:]:
            self.nodes.append(node(symbol, self.nodes[-1]))
        self.made += len(word) - shared
        self.word = word
        return self.nodes[-1]


def through(word: str) -> list[int]:
    """Least costs of a reversed word from each state to each, 16 numbers."""
    far = 1 << 40
    out = [[0] * 4 for _ in range(4)]
    for last in range(4):
        row = [(0 if s == last else far, "", s) for s in range(4)]
        for symbol in word:
            row = [(c, "", s) for c, _, s in node(symbol, tuple(row))]
        for s in range(4):
            out[s][last] = row[s][0]
    return sum(out, [])


def order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.md5(F.col("text").cast("binary"))]


def faults(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with place and back (from the first and the last row, from 0), fault (blank, duplicate, truncated or null), illegal (against the row before) and symbol."""
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))).repartition("conv_id")
    conv = Window.partitionBy("conv_id")
    rows = rows.withColumns({"place": (F.row_number().over(conv.orderBy(*order())) - 1).cast("long"), "size": F.count("*").over(conv)})
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("conv_id", "role", F.md5(F.col("text").cast("binary"))).orderBy("place")) > 1)
    line, bare = conv.orderBy("place"), F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(F.col("seen"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.left("role", F.lit(1))
    pair = F.concat(F.lag(initial).over(line), initial)
    new = F.col("turn").isNotNull() & ~F.lag("turn").over(line).eqNullSafe(F.col("turn"))
    rows = rows.select("conv_id", "turn", "role", "text", "place", "size", fault.alias("fault"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), new.alias("new_turn"))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    back = F.col("size") - F.col("place") - 1
    return rows.select("conv_id", "turn", "new_turn", "role", "text", "place", F.floor(back / BLOCK).alias("block"), "fault", "illegal", symbol.alias("symbol"))


def _answers(blocks: DataFrame) -> DataFrame:
    """blocks (conv_id, block, first, word, after) with cost, and for each state before it audits and lasts; word is reversed, first says whether no block precedes."""
    schema = T.StructType([blocks.schema[c] for c in ("conv_id", "block", "first")]).add("cost", "long").add("audits", T.ArrayType(T.StringType())).add("lasts", T.ArrayType(T.IntegerType()))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = Path()
        for batch in batches:
            costs, audits, lasts = [], [], []
            for word, after, first in zip(*(batch.column(c).to_pylist() for c in ("word", "after", "first"))):
                found = path.first(word, None if after is None else tuple(after))
                costs.append(found[START][0])
                some = found[:1] if first else found
                audits.append([w[1] for w in some])
                lasts.append([w[2] for w in some])
            yield pa.record_batch([*(batch.column(c) for c in ("conv_id", "block", "first")), pa.array(costs, pa.int64()), pa.array(audits, pa.list_(pa.string())), pa.array(lasts, pa.list_(pa.int32()))], schema.names)

    dealt = blocks.repartitionByRange(F.col("after"), F.col("word"), F.col("conv_id")).sortWithinPartitions("after", "word", "conv_id")
    return dealt.mapInArrow(solve, schema)


def _behind(long: DataFrame) -> DataFrame:
    """Blocks of long conversations (conv_id, block, first, word), with after: the cost to go behind each, null behind the last."""
    key = long.schema["conv_id"].dataType

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [through(w) for w in batch.column("word").to_pylist()]
            yield pa.record_batch([batch.column("conv_id"), batch.column("block"), pa.array(made, pa.list_(pa.int64()))], ["conv_id", "block", "m"])

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        go, out = [w[0] for w in END], []
        for block, m in zip(rows.column("block").to_pylist(), rows.column("m").to_pylist()):
            out.append(None if block == 0 else go)
            go = [min(m[4 * s + k] + go[k] for k in range(4)) for s in range(4)]
        return pa.table([rows.column("conv_id"), rows.column("block"), pa.array(out, pa.list_(pa.int64()))], ["conv_id", "block", "after"])

    plain = T.StructType().add("conv_id", key).add("block", "long")
    m = long.select("conv_id", "block", "word").mapInArrow(matrices, T.StructType(plain.fields + [T.StructField("m", T.ArrayType(T.LongType()))]))
    after = m.groupBy("conv_id").applyInArrow(scan, T.StructType(plain.fields + [T.StructField("after", T.ArrayType(T.LongType()))]))
    a, b = long.alias("a"), after.alias("b")
    return a.join(b, F.expr("a.conv_id <=> b.conv_id and a.block = b.block")).select("a.conv_id", "a.block", "a.first", "a.word", "b.after")


def _chosen(long: DataFrame) -> DataFrame:
    """(conv_id, block, audit) of answered blocks of long conversations: the audit from the state that the blocks before lead to."""

    def scan(rows: pa.Table) -> pa.Table:
        rows, state, out = rows.sort_by([("block", "descending")]), START, []
        for lasts in rows.column("lasts").to_pylist():
            out.append(state)
            state = lasts[state]
        return pa.table([rows.column("conv_id"), rows.column("block"), pa.array(out, pa.int32())], ["conv_id", "block", "state"])

    schema = T.StructType([long.schema["conv_id"], T.StructField("block", T.LongType()), T.StructField("state", T.IntegerType())])
    states = long.select("conv_id", "block", "lasts").groupBy("conv_id").applyInArrow(scan, schema)
    a, b = long.alias("a"), states.alias("b")
    return a.join(b, F.expr("a.conv_id <=> b.conv_id and a.block = b.block")).select("a.conv_id", "a.block", F.expr("a.audits[b.state]").alias("audit"))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, block, cost, audit) of each block of rows, as faults() gives them; cost, on first blocks alone, is that of the whole conversation."""
    word = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("place", "symbol")))), lambda x: x["symbol"]), "")
    blocks = rows.groupBy("conv_id", "block").agg(word.alias("word"), (F.min("place") == 0).alias("first"))
    blocks = stored(blocks, "words")
    none = F.lit(None).cast("array<bigint>").alias("after")
    alone = blocks.where("first and block = 0").select("conv_id", "block", "first", "word", none)
    long = blocks.where("not (first and block = 0)")
    short = _answers(alone).select("conv_id", "block", "cost", F.col("audits")[0].alias("audit"))
    if long.isEmpty():
        return short
    long = stored(_answers(stored(_behind(long), "behind")), "answers")
    costs = long.where("first").select("conv_id", "block", "cost", F.lit(None).cast("string").alias("audit"))
    pieces = _chosen(long).select("conv_id", "block", F.lit(None).cast("long").alias("cost"), "audit")
    return short.unionByName(costs.unionByName(pieces).groupBy("conv_id", "block").agg(F.max("cost").alias("cost"), F.max("audit").alias("audit")))


def repaired(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): conversations as mended, from faults() and audits(); rows of one lie together, in order.

    Rows stream past in their order, each block behind its audit, so a task holds one batch.
    """
    key = rows.schema["conv_id"]
    schema = T.StructType([key]).add("place", "long").add("edit", "string").add("role", "string").add("text", "string")
    left = rows.select("conv_id", "block", F.lit(1).alias("kind"), "place", "role", "text", F.lit(None).cast("string").alias("audit"))
    right = pieces.select("conv_id", "block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("place"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")), "audit")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, audit, at, speaker = object(), 0, "", 0, "user"
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])

            def add(conv, edit, role, text):
                nonlocal place, speaker
                for column, value in zip(out, (conv, place, edit, role, text)):
                    column.append(value)
                place, speaker = place + 1, "assistant" if role.startswith("u") else "user"

            def inserted(conv):
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    at += 1
                    add(conv, "I", speaker, "")

            for conv, kind, role, text, piece in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "audit"))):
                if kind == 0:
                    if conv != now:
                        now, place, speaker = conv, 0, "user"
                    audit, at = piece, 0
                    inserted(conv)
                    continue
                edit, at = audit[at], at + 1
                if edit == "K":
                    add(conv, edit, role, text)
                elif edit == "R":
                    add(conv, edit, speaker, text)
                inserted(conv)
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, pa.schema([(key.name, batch.schema.field("conv_id").type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))], schema.names)

    both = left.unionByName(right).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"), "kind", "place")
    return both.mapInArrow(mend, schema)


def digests(mended: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the lines role:text of each conversation of repaired()."""
    schema = T.StructType([mended.schema["conv_id"]]).add("repaired_sha256", "string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                line = f"{role}:{text}".encode()
                if sha is None or conv != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256(line)
                else:
                    sha.update(b"\n" + line)
            yield pa.record_batch([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], schema.names)
        if sha is not None:
            yield pa.record_batch([pa.array([now], kind), pa.array([sha.hexdigest()])], schema.names)

    return mended.mapInArrow(digest, schema)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, mended) of (conv_id, turn, role, text): report has a row a conversation with gaps, blank, duplicate, truncated, illegal, cost and audit; mended is as of repaired().

    gaps is null where it is beyond a long.
    """
    rows = stored(faults(conversations), "faults")
    pieces = stored(audits(rows), "audits")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    span = F.coalesce(F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.count_if("new_turn"), F.lit(0)).try_cast("long")
    found = rows.groupBy("conv_id").agg(span.alias("gaps"), *(F.count_if(F.col("fault") == c).alias(c) for c in ("blank", "duplicate", "truncated")), F.count_if("illegal").alias("illegal"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("block")).alias("b"), "audit"))), lambda x: x["audit"]), "")
    ways = pieces.groupBy("conv_id").agg(F.max("cost").alias("cost"), whole.alias("audit"))
    a, b = found.alias("a"), ways.alias("b")
    report = a.join(b, F.expr("a.conv_id <=> b.conv_id")).select("a.*", "b.cost", "b.audit")
    return report, repaired(rows, pieces)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32 of conv_id:turn deals out; nulls are one space in what is hashed, in role and in text."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("again")).drop("again")


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of conversations, damaged, with its faults, the cheapest repair and the digest of what it gives."""
    given = table(spark, sf_dir, "conversations")
    report, mended = repair(damaged(given))
    counts, shown = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], ["audit", "repaired_sha256"]
    parts = [given.select("conv_id").distinct(), report, digests(mended)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return rows.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in counts), *(F.coalesce(F.max(c), F.lit(empty[c])).alias(c) for c in shown))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"


def _way(v: str, cost: str, letter: str) -> str:
    """A way is its cost in nine digits and its audit, so that the least text is the cheapest and, of these, the ASCII-least."""
    return f"lpad((left({v}, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({v}, 10)"


def _consume(s: int) -> str:
    late = "(CASE WHEN truncated THEN 5 ELSE 0 END)"
    keep = {0: "WHEN i = 's' THEN 1 WHEN i = 'u' THEN 2", 1: "WHEN i = 'u' THEN 2", 2: "WHEN i = 'a' THEN 3", 3: "WHEN i = 'u' THEN 2"}[s]
    kept = {k: _way(f"v{k}", late, "K") for k in (1, 2, 3)}
    return f"least({_way(f'v{s}', '2', 'D')}, CASE WHEN NOT gone THEN {_way(f'v{TURN[s]}', f'1 + {late}', 'R')} END, CASE WHEN gone THEN NULL ELSE CASE CASE {keep} END WHEN 1 THEN {kept[1]} WHEN 2 THEN {kept[2]} WHEN 3 THEN {kept[3]} END END) AS c{s}"


ORACLE = {
    "op11_dialogue_repair": f"""WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), coded AS (SELECT *, {_CRC} % 20 AS d FROM raw
), hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, d FROM coded WHERE d <> 0
), twice AS (
  SELECT conv_id, turn, role, text FROM hurt UNION ALL SELECT conv_id, turn, role, text FROM hurt WHERE d = 3
), placed AS (
  SELECT *, coalesce(nullif(left(role, 1), ''), ' ') AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n, count(*) OVER (PARTITION BY conv_id) AS size FROM twice
), again AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen FROM placed
), marked AS (
  SELECT *, bare = '' AS blank, bare <> '' AND seen AS duplicate, bare <> '' AND NOT seen AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated, bare = '' OR seen AS gone,
    lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM again
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY 1
), way AS (
  SELECT conv_id, max(size) AS n, '000000000' AS v0, '000000010II' AS v1, '000000005I' AS v2, '000000000' AS v3 FROM marked GROUP BY 1
  UNION ALL
  SELECT conv_id, n, least(c0, {_way('u2', '5', 'I')}), least(c1, {_way('u2', '5', 'I')}), u2, u3 FROM (
    SELECT *, least(c2, {_way('c3', '5', 'I')}) AS u2, least(c3, {_way('c2', '5', 'I')}) AS u3 FROM (
      SELECT w.conv_id, w.n - 1 AS n, {', '.join(_consume(s) for s in range(4))} FROM way w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n))
), best AS (
  SELECT conv_id, left(v0, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM way WHERE n = 0
), letters AS (
  SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best
), edits AS (
  SELECT conv_id, p, audit[p] AS edit, length(replace(audit[1:p], 'I', '')) AS n, length(replace(audit[1:p], 'D', '')) AS emitted FROM letters
), joined AS (
  SELECT e.*, m.role, m.text, max(e.emitted = 1 AND e.edit = 'K' AND m.i = 's') OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.n = e.n AND e.edit <> 'I' WHERE e.edit <> 'D'
), mended AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (emitted - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS h FROM joined GROUP BY 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM o.conv_id"""
}
