"""Conversation structure repair: the cheapest edits that make a conversation alternate, with Spark SQL functions.

A conversation's rows are ordered by turn (nulls first), role and text. Window functions flag each row's first fault;
the rows are collected as sorted structs, and a fold over them (`aggregate`) carries four (cost, audit) structs, one for
each state of the repaired roles: nothing yet, after a leading system turn, after a user turn, after an assistant turn.
Each step takes the `least` of the ways into a state, so that ties go to the least audit. An audit has one letter an
edit (K keep, R rerole, D delete, I insert); the roles that it leads to are carried beside it.

A conversation of at most `segment` rows and `chars` characters is one group. Longer ones never meet in one task: their
rows are sorted by ranges of the whole order and cut into segments within those bounds. A segment is folded from each
of the four states; the folds of up to 256 segments' rows make a block's and a conversation's blocks make its own, which
carry structs only, no text. The states of the best way at the segments' ends go back to the segments, which render
their own texts. The hash of a long conversation is one chain over its bytes by nature: it is taken from a stream of the
segments' texts, sorted by Spark, in bounded memory.

Faults: blank (no character but spaces and \\t to \\r), duplicate (role and text as in an earlier row), truncated (the
last character that is no such space is none of `.!?`). Defined cases: null roles and texts are one space, a null turn
stands before all others, null conversations are one of their own. A role is known by its first character; an empty role
has none and can't be kept. A repeated row is a duplicate of the first. An empty table has no row. Other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

#: Rows and characters of a segment, and segments' rows of a block.
SEGMENT, CHARS, BLOCK = 1024, 1 << 20, 256
SPACES = " \t\n\x0b\x0c\r"
#: States of the repaired roles by their last letter: none yet, system, user, assistant.
STATES = "-sua"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: More than any way to repair a conversation costs.
NEVER = 1 << 50


def _order() -> list[Column]:
    return [F.col("__turn").asc_nulls_first(), F.col("__role"), F.col("__text")]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _way(cost: Column, audit: Column, roles: Column, path: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"), roles.alias("roles"), path.alias("path"))


def _more(way: Column, cost: Column | int, letter: Column | str, role: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return _way(way["cost"] + as_column(cost), F.concat(way["audit"], as_column(letter)), F.concat(way["roles"], as_column(role)), way["path"])


def _four(*ways: Column) -> Column:
    return F.struct(*(w.alias(f"w{k}") for k, w in enumerate(ways)))


def _begin(state: int) -> Column:
    """The four ways before any row, from the given state."""
    return _four(*(_way(F.lit(0 if k == state else NEVER), F.lit(""), F.lit(""), F.lit("")) for k in range(4)))


def _filled(f: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of the four ways with turns put in: a user turn after anything but one, an assistant turn after that."""
    user = F.least(f["w2"], *(_more(f[w], INSERT, "I", "u") for w in ("w0", "w1", "w3")))
    return _let(user, lambda u: _let(_four(f["w0"], f["w1"], u, F.least(f["w3"], _more(u, INSERT, "I", "a"))), then))


def _after(f: Column, row: Column) -> Column:
    """The four ways after a row: its initial, must_go, and late where it is truncated."""
    extra = F.when(row["late"], TRUNCATED).otherwise(0)

    def moved(way: Column, state: str) -> Column:
        """Kept where the row's role is the state's, else given it; nothing is made a system turn."""
        kept = row["initial"] == state
        cost = F.when(row["must_go"], F.lit(NEVER)).when(kept, extra).otherwise(F.lit(NEVER) if state == "s" else extra + REROLE)
        return _more(way, cost, F.when(kept, "K").otherwise("R"), F.when(kept, "k").otherwise(state))

    def made(g: Column) -> Column:
        gone = [_more(g[f"w{k}"], DELETE, "D", "-") for k in range(4)]
        user = F.least(gone[2], *(moved(g[w], "u") for w in ("w0", "w1", "w3")))
        return _four(gone[0], F.least(gone[1], moved(g["w0"], "s")), user, F.least(gone[3], moved(g["w2"], "a")))

    return _filled(f, made)


def _best(f: Column) -> Column:
    """The least way to end, with turns put in; its path ends with the state before those."""
    ended = _four(*(_way(f[f"w{k}"]["cost"], f[f"w{k}"]["audit"], f[f"w{k}"]["roles"], F.concat(f[f"w{k}"]["path"], F.lit(STATES[k]))) for k in range(4)))
    return _let(ended, lambda e: _filled(e, lambda g: F.least(g["w0"], g["w3"])))


def _joined(f: Column, folds: Column) -> Column:
    """The four ways after a part, of which `folds` has the four ways from each state."""

    def via(s: int, k: int) -> Column:
        a, b = f[f"w{s}"], F.get(folds, F.lit(s))[f"w{k}"]
        return _way(F.least(a["cost"] + b["cost"], F.lit(NEVER)), F.concat(a["audit"], b["audit"]), F.concat(a["roles"], b["roles"]), F.concat(a["path"], b["path"]))

    return _four(*(F.least(*(via(s, k) for s in range(4))) for k in range(4)))


def _lines(rows: Column, audit: Column, roles: Column) -> Column:
    """The lines role:text that an audit leaves of sorted rows, as one text; null where it leaves none."""
    named = lambda r: F.when(r == "u", "user:").otherwise("assistant:")

    def line(j: Column) -> Column:
        letter, role = F.substring(audit, j, F.lit(1)), F.substring(roles, j, F.lit(1))
        row = F.get(rows, F.length(F.translate(F.substring(audit, F.lit(1), j), "I", "")) - 1)
        kept = F.when(letter == "K", F.concat(row["__role"], F.lit(":"))).otherwise(named(role))
        return F.when(letter == "I", named(role)).when(letter != "D", F.concat(kept, row["__text"]))

    made = F.filter(F.transform(F.sequence(F.lit(1), F.length(audit)), line), lambda x: x.isNotNull())
    return F.when(F.size(made) > 0, F.array_join(made, "\n"))


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _flagged(rows: DataFrame, by: list[str], again: Column) -> DataFrame:
    """rows with what their neighbours and texts tell: blank, duplicate, truncated, __odd (roles that don't follow each
    other) and __new (a turn's first row). by: what the neighbours share; __at orders them."""
    near = Window.partitionBy(*by).orderBy("__at")
    trimmed = F.rtrim("__text", F.lit(SPACES))
    out = rows.withColumns({"initial": F.left("__role", F.lit(1)), "blank": trimmed == "", "__end": F.right(trimmed, F.lit(1)), "__again": again})
    out = out.withColumns({"duplicate": F.col("__again") & ~F.col("blank"), "truncated": ~F.col("__again") & ~F.col("blank") & ~F.col("__end").isin(".", "!", "?")})
    follows = F.concat(F.lag("initial").over(near), F.col("initial")).isin("su", "ua", "au")
    return out.withColumns({"__odd": F.coalesce(~follows, F.lit(False)), "__new": F.col("__turn").isNotNull() & ~F.coalesce(F.lag("__turn").over(near) == F.col("__turn"), F.lit(False))}).drop("__end", "__again")


def _counted() -> list[Column]:
    row = F.struct("__at", "__role", "__text", "initial", (F.col("blank") | F.col("duplicate")).alias("must_go"), F.col("truncated").alias("late"))
    counts = [F.count_if(c).alias(n) for c, n in (("blank", "blank"), ("duplicate", "duplicate"), ("truncated", "truncated"), ("__odd", "illegal"), ("__new", "__turns"))]
    return [F.array_sort(F.collect_list(row)).alias("__rows"), F.min("__turn").alias("__least"), F.max("__turn").alias("__most"), *counts]


def _result(df: DataFrame, best: Column, sha: Column) -> DataFrame:
    gaps = F.coalesce(F.col("__most") - F.col("__least") + 1 - F.col("__turns"), F.lit(0)).alias("gaps")
    return df.select("__conv", gaps, "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"), sha.alias("repaired_sha256"))


def _short(rows: DataFrame) -> DataFrame:
    """Results of conversations that are one group each: one exchange by conversation."""
    rows = rows.withColumn("__at", F.row_number().over(Window.partitionBy("__conv").orderBy(*_order())).cast("long"))
    again = F.row_number().over(Window.partitionBy("__conv", "__role", "__text").orderBy("__at")) > 1
    met = _flagged(rows, ["__conv"], again).groupBy("__conv").agg(*_counted())
    met = met.withColumn("__best", _let(F.aggregate("__rows", _begin(0), _after), _best))
    tail = F.array_compact(F.array(_lines(F.col("__rows"), F.col("__best.audit"), F.col("__best.roles"))))
    return _result(met, F.col("__best"), _sha(F.array_join(tail, "\n")))


def _segments(rows: DataFrame, segment: int, chars: int) -> DataFrame:
    """A row for each segment: __conv, __seg (which rises with the order), __rows, counts, first and last facts and the
    folds from all states. A segment's __part is 0 where none before it shares its run of `segment` rows."""
    said = ("__conv", "__role", "__h1", "__h2")
    first = rows.groupBy(*(F.col(c).alias(f"{c}_") for c in said)).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    same = F.col("__conv").eqNullSafe(F.col("__conv_")) & (F.col("__role") == F.col("__role_")) & (F.col("__h1") == F.col("__h1_")) & (F.col("__h2") == F.col("__h2_"))
    # A row a key and task is shuffled for `first`, and the join can split a key of many rows.
    joined = rows.join(first, same, "left").select(*rows.columns, "__first", F.floor(F.col("__at") / segment).alias("__run"))
    flagged = _flagged(joined, ["__conv", "__run"], F.coalesce(F.col("__first") < F.col("__at"), F.lit(False)))
    before = F.sum(F.length("__text")).over(Window.partitionBy("__conv", "__run").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    ends = [f(c, "__at").alias(n) for f, c, n in ((F.min_by, "__turn", "__turn0"), (F.max_by, "__turn", "__turn1"), (F.min_by, "initial", "__initial0"), (F.max_by, "initial", "__initial1"))]
    out = flagged.withColumn("__part", F.floor(F.coalesce(before, F.lit(0)) / chars)).groupBy("__conv", "__run", "__part").agg(*_counted(), F.min("__at").alias("__seg"), *ends)
    return out.withColumns({"__folds": F.array(*(F.aggregate("__rows", _begin(s), _after, _entered(s)) for s in range(4))), "__segs": F.array("__seg")}).drop("__run")


def _entered(state: int) -> Callable[[Column], Column]:
    """The four ways after a segment, with the state before it as their path."""
    return lambda f: _four(*(_way(f[f"w{k}"]["cost"], f[f"w{k}"]["audit"], f[f"w{k}"]["roles"], F.lit(STATES[state])) for k in range(4)))


_SUMS = ("blank", "duplicate", "truncated", "illegal", "__turns")
_FACTS = ("__seg", "__part", "__least", "__most", "__turn0", "__turn1", "__initial0", "__initial1", "__segs", "__folds", *_SUMS)


def _one(df: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive parts of conversations made one each: sums with what the borders add, ends and folds. No text."""
    met = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_FACTS))).alias("__p"))
    p, head, tail = F.col("__p"), F.get("__p", F.lit(0)), F.element_at("__p", -1)
    opens = lambda f: F.size(F.filter(F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), f), lambda x: x)).cast("long")
    odd = opens(lambda a, b: F.coalesce((b["__part"] == 0) & ~F.concat(a["__initial1"], b["__initial0"]).isin("su", "ua", "au"), F.lit(False)))
    twice = opens(lambda a, b: F.coalesce((b["__part"] == 0) & (a["__turn1"] == b["__turn0"]), F.lit(False)))
    added = lambda c: F.aggregate(F.transform(p, lambda x: x[c]), F.lit(0).cast("long"), lambda n, v: n + v)
    total = {c: added(c) for c in _SUMS}
    total["illegal"], total["__turns"] = total["illegal"] + odd, total["__turns"] - twice
    ends = {c: (tail if c.endswith("1") else head)[c] for c in ("__seg", "__part", "__turn0", "__turn1", "__initial0", "__initial1")}
    spans = {"__least": F.array_min(F.transform(p, lambda x: x["__least"])), "__most": F.array_max(F.transform(p, lambda x: x["__most"])), "__segs": F.flatten(F.transform(p, lambda x: x["__segs"]))}
    folds = F.array(*(F.aggregate(p, _begin(s), lambda f, x: _joined(f, x["__folds"])) for s in range(4)))
    return met.select(*keys, *(v.alias(k) for k, v in {**total, **ends, **spans, "__folds": folds}.items()))


def _hashes(texts: DataFrame) -> DataFrame:
    """__conv and the hash of each conversation's __lines, joined by newlines in the order of __seg; nulls are left out."""
    sorted_ = texts.repartition("__conv").sortWithinPartitions("__conv", "__seg").select("__conv", "__lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, some = None, None, False
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([sha.hexdigest()])], ["__conv", "__sha"])
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, lines in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if sha is None or conv != now:
                    if sha is not None:
                        yield done()
                    now, sha, some = conv, hashlib.sha256(), False
                if lines.is_valid:
                    sha.update((b"\n" if some else b"") + lines.as_buffer().to_pybytes())
                    some = True
        if sha is not None:
            yield done()

    return sorted_.mapInArrow(run, f"__conv {sorted_.schema['__conv'].dataType.simpleString()}, __sha string")


def _long(rows: DataFrame, segment: int, chars: int, block: int, path: str) -> DataFrame:
    """Results of conversations in segments."""
    rows = rows.withColumns({"__h1": F.xxhash64("__text"), "__h2": F.xxhash64(F.lit(1), "__text")})
    rows = rows.repartitionByRange("__conv", *_order()[:2], "__h1", "__h2").sortWithinPartitions("__conv", *_order())
    rows = stored(rows.withColumn("__at", F.monotonically_increasing_id()), f"{path}/rows")
    parts = stored(_segments(rows, segment, chars), f"{path}/segments")
    blocks = _one(parts.withColumn("__b", F.floor(F.col("__seg") / (segment * block))), ["__conv", "__b"])
    whole = stored(_one(blocks, ["__conv"]).withColumn("__best", _let(F.get("__folds", F.lit(0)), _best)).drop("__folds"), f"{path}/whole")
    ways = F.transform("__segs", lambda s, i: F.struct(s.alias("__seg"), F.substring("__best.path", i + 1, F.lit(1)).alias("__in"), F.substring("__best.path", i + 2, F.lit(1)).alias("__out"), (i == F.size("__segs") - 1).alias("__last")))
    found = parts.join(whole.select(F.inline(ways)), "__seg")
    place = lambda c: F.instr(F.lit(STATES), c) - 1
    fold = F.get("__folds", place(F.col("__in")))
    way = F.get(F.array(*(fold[f"w{k}"] for k in range(4))), place(F.col("__out")))
    put_in = F.when(F.col("__last") & (F.col("__out") == "u"), "assistant:").when(F.col("__last") & (F.col("__out") == "s"), "user:\nassistant:")
    lines = found.withColumn("__way", way).select("__conv", "__seg", F.array_compact(F.array(_lines(F.col("__rows"), F.col("__way.audit"), F.col("__way.roles")), put_in)).alias("__l"))
    shas = _hashes(lines.select("__conv", "__seg", F.when(F.size("__l") > 0, F.array_join("__l", "\n")).alias("__lines")))
    shas = shas.withColumnRenamed("__conv", "__c")
    return _result(whole.join(shas, F.col("__conv").eqNullSafe(F.col("__c"))), F.col("__best"), F.col("__sha"))


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT, chars: int = CHARS, block: int = BLOCK) -> DataFrame:
    """A row for each conversation that has one: __conv, gaps, faults, cost, audit and repaired_sha256."""
    path = shared_dir(turns.sparkSession)
    rows = turns.select(F.col(conv).alias("__conv"), F.col(turn).cast("long").alias("__turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(k) for c, k in ((role, "__role"), (text, "__text"))))
    sizes = rows.groupBy("__conv").agg(F.count(F.lit(1)).alias("__n"), F.sum(F.length("__text")).alias("__c"))
    long = stored(sizes.where((F.col("__n") > segment) | (F.col("__c") > chars)).select(F.col("__conv").alias("__big")), f"{path}/long")
    is_long = F.col("__conv").eqNullSafe(F.col("__big"))
    if long.isEmpty():
        return _short(rows)
    return _short(rows.join(long, is_long, "left_anti")).unionByName(_long(rows.join(long, is_long, "left_semi"), segment, chars, block, path))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults put in by the hash of conversation and turn; nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("__f"))
    text = F.when(F.col("__f") == 1, "").when(F.col("__f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__f") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("__f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("__f <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, known = repaired(damaged(turns)), turns.select("conv_id").distinct()
    out = known.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The same for DuckDB: a recursion over rows, roles by the parity of what an audit leaves, and CRC-32 by its table."""
    way = lambda w, cost, letter: f"{{'c': {w}.c + {cost}, 'a': {w}.a || '{letter}'}}"

    def moved(w: str, state: str) -> str:
        kept, rerole = f"initial = '{state}'", NEVER if state == "s" else REROLE
        return f"{{'c': {w}.c + CASE WHEN must_go THEN {NEVER} WHEN {kept} THEN late ELSE late + {rerole} END, 'a': {w}.a || CASE WHEN {kept} THEN 'K' ELSE 'R' END}}"

    u = "least(w2, " + ", ".join(way(w, INSERT, "I") for w in ("w0", "w1", "w3")) + ")"
    v = f"least(w3, {way('u', INSERT, 'I')})"
    return rf"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))) AS bytes FROM conversations
), faulty AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT)) % 20 AS f FROM keyed, tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) FROM faulty WHERE f <> 0)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged
), flagged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM numbered
), r AS (
  SELECT *, blank OR again AS must_go, CASE WHEN cut AND NOT blank AND NOT again THEN {TRUNCATED} ELSE 0 END AS late FROM flagged
), fold AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS w0, {{'c': CAST({NEVER} AS BIGINT), 'a': ''}} AS w1, {{'c': CAST({NEVER} AS BIGINT), 'a': ''}} AS w2, {{'c': CAST({NEVER} AS BIGINT), 'a': ''}} AS w3 FROM r
  UNION ALL
  SELECT conv_id, n, {way('w0', DELETE, 'D')}, least({way('w1', DELETE, 'D')}, {moved('w0', 's')}), least({way('u', DELETE, 'D')}, {moved('w0', 'u')}, {moved('w1', 'u')}, {moved('v', 'u')}), least({way('v', DELETE, 'D')}, {moved('u', 'a')})
  FROM (SELECT *, {v} AS v FROM (SELECT r.conv_id, r.n, w0, w1, w2, w3, initial, must_go, CAST(late AS BIGINT) AS late, {u} AS u FROM fold JOIN r ON r.conv_id IS NOT DISTINCT FROM fold.conv_id AND r.n = fold.n + 1))
), best AS (
  SELECT conv_id, least(w0, v) AS b FROM (SELECT *, {v} AS v FROM (SELECT *, {u} AS u FROM fold QUALIFY n = max(n) OVER (PARTITION BY conv_id)))
), edits AS (
  SELECT conv_id, j, b.a[j] AS letter, length(replace(left(b.a, j), 'I', '')) AS n, length(replace(left(b.a, j - 1), 'D', '')) AS before FROM (SELECT conv_id, b, unnest(range(1, length(b.a) + 1)) AS j FROM best)
), made AS (
  SELECT e.conv_id, j, letter, before, role, text, max(CASE WHEN letter = 'K' AND before = 0 AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.n = greatest(e.n, 1) WHERE letter <> 'D'
), texts AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (before - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM made GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (late > 0) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP12_SQL = _sql()
