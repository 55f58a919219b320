"""Quotation linking of chat messages, with DataFrame functions only.

A line's quote level is the number of `>` before its text. Lines of one level in a row are a passage; a line of level
0 that ends in `wrote:` right before a quote introduces it and goes with it. Passages and the messages' own text are
cut into sentences, normalised to lower-case words, and hashed, and so is the whole of each. A quoted sentence or passage
links to the first message of its conversation to say it, if that came before. A message replies to the message that most of what it quotes at the lowest
linked level comes from, the latest of several. Replies form threads; the smallest turn of a thread and the depth
follow by pointer doubling, whose rounds are tables in the shared folder.

Sorting by (conv_id, root_turn, turn) gives each conversation in reply order, as a reply comes after what it quotes;
the sort is by ranges of all three, so one large conversation spreads over many tasks. Joins are by (conversation,
sentence) or (conversation, turn) against one row a key.

Defined cases: null and empty texts have no line and an empty clean text. A message with a null conversation or turn
links to nothing and is its own root. Repeated rows of a message share its links. Sentences of fewer than `MIN_WORDS`
words don't link unless they are a whole passage that quotes a whole message. Other columns pass by unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

MIN_WORDS = 2
PREFIX = r"^[ \t]*(?:>[ \t]*)*"
INTRODUCES = r"(?i)\b(wrote|writes|said):[ \t\r]*$"
_MARK, _LEVEL = "\u0001", "\u0002"


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def sentences(text: Column) -> Column:
    """Normalised sentences of at least MIN_WORDS words, and the whole text normalised."""
    plain = F.transform(F.split(text, r"[.!?]+(?:\s+|$)"), _plain)
    whole = F.filter(F.array(_plain(text)), lambda s: s != "")
    return F.array_union(F.filter(plain, lambda s: F.size(F.split(s, " ")) >= MIN_WORDS), whole)


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """__conv, __turn, __role, __own (the message without quotes) and __passages, an array of (level, text)."""
    keys = ["__conv", "__turn", "__role"]
    raw = messages.select(*(F.col(c).alias(k) for c, k in zip((conv, turn, role), keys, strict=True)), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("__lines"))
    level = F.transform("__lines", lambda s: F.length(F.regexp_replace(F.regexp_extract(s, PREFIX, 0), "[^>]", "")))
    # Through a generator, so that the levels are made once a row and not once for each line that looks at them.
    raw = raw.select(*keys, F.inline(F.array(F.struct(F.col("__lines").alias("__l"), level.alias("__v")))))
    here = lambda i: F.get("__v", i)
    # Marks start passages and stand for other lines, so that splitting at them gives the passages.
    begins = lambda i: (i == 0) | (here(i - 1) != here(i))
    head = lambda i: F.when(begins(i), F.concat(F.lit(_MARK), here(i).cast("string"), F.lit(_LEVEL))).otherwise(F.lit(" "))
    bare = lambda s: F.translate(F.regexp_replace(s, PREFIX, ""), _MARK + _LEVEL, "")
    quoted = F.transform("__l", lambda s, i: F.when(here(i) == 0, F.lit(_MARK)).otherwise(F.concat(head(i), bare(s))))
    introduces = lambda s, i: s.rlike(INTRODUCES) & (F.coalesce(here(i + 1), F.lit(0)) > 0)
    own = F.filter("__l", lambda s, i: (here(i) == 0) & ~introduces(s, i))
    passages = F.filter(F.split(F.array_join(quoted, ""), _MARK), lambda p: p.contains(_LEVEL))
    passages = F.transform(passages, lambda p: F.struct(F.substring_index(p, _LEVEL, 1).cast("int").alias("level"), F.substring_index(p, _LEVEL, -1).alias("text")))
    return raw.select(*keys, F.btrim(F.array_join(own, "\n"), F.lit(" \t\r\n")).alias("__own"), passages.alias("__passages"))


def _hashed(df: DataFrame, sentence: str) -> DataFrame:
    return df.withColumns({"__h1": F.xxhash64(sentence), "__h2": F.xxhash64(F.lit(1), sentence)}).drop(sentence)


def replies(messages: DataFrame) -> DataFrame:
    """__conv, __turn and __parent for each message of `parsed` that quotes an earlier one."""
    said = messages.select("__conv", "__turn", F.explode(sentences(F.translate("__own", "\n", " "))).alias("__s"))
    first = _hashed(said, "__s").groupBy("__conv", "__h1", "__h2").agg(F.min("__turn").alias("__parent"))
    passages = messages.select("__conv", "__turn", F.inline("__passages"))
    quoted = _hashed(passages.select("__conv", "__turn", "level", F.explode(sentences(F.col("text"))).alias("__s")), "__s").distinct()
    linked = quoted.join(first, ["__conv", "__h1", "__h2"]).where("__parent < __turn")
    support = linked.groupBy("__conv", "__turn", "level", "__parent").agg(F.count(F.lit(1)).alias("n"))
    best = support.groupBy("__conv", "__turn").agg(F.max(F.struct(-F.col("level"), "n", "__parent")).alias("b"))
    return best.select("__conv", "__turn", F.col("b.__parent").alias("__parent"))


def threads(links: DataFrame, path: str) -> DataFrame:
    """__conv, __turn, __parent, __root and __depth of every linked message. links is a stored table."""
    now = links.select("*", F.col("__parent").alias("__root"), F.lit(1).cast("long").alias("__depth"))
    k = 0
    while True:
        up = now.select(F.col("__conv"), F.col("__turn").alias("__root"), F.col("__root").alias("__higher"), F.col("__depth").alias("__more"))
        joined = now.join(up, ["__conv", "__root"], "left")
        now = stored(
            joined.select("__conv", "__turn", "__parent", F.coalesce("__higher", "__root").alias("__root"), (F.col("__depth") + F.coalesce("__more", F.lit(0))).alias("__depth"), F.col("__higher").isNotNull().alias("__moved")),
            f"{path}/threads-{k}",
        )
        if now.where("__moved").isEmpty():
            return now.drop("__moved")
        now, k = now.drop("__moved"), k + 1


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each message: its conversation, turn, role, __clean (text without quotes), __quotes (passages),
    __levels (deepest level), __parent, __root and __depth; no parent: null, its own turn and 0. In reply order."""
    path = shared_dir(messages.sparkSession)
    own = parsed(messages, conv, turn, role, text)
    tree = threads(stored(replies(own), f"{path}/replies"), path)
    deepest = F.array_max(F.transform("__passages", lambda p: p["level"]))
    out = own.join(tree, ["__conv", "__turn"], "left").select(
        "__conv", "__turn", "__role", F.col("__own").alias("__clean"),
        F.size("__passages").cast("long").alias("__quotes"), F.coalesce(deepest, F.lit(0)).cast("long").alias("__levels"),
        "__parent", F.coalesce("__root", "__turn").alias("__root"), F.coalesce("__depth", F.lit(0)).cast("long").alias("__depth"),
    )
    return out.orderBy("__conv", "__root", "__turn")


def op4_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linked(table(spark, sf_dir, "conversations"))
    names = {"__conv": "conv_id", "__turn": "turn", "__role": "role", "__clean": "clean_text", "__quotes": "n_quotes", "__levels": "quote_levels", "__parent": "parent_turn", "__root": "root_turn", "__depth": "depth"}
    return out.select(*(F.col(c).alias(n) for c, n in names.items()))


#: DuckDB's recursion follows the replies where the operator doubles pointers.
OP4_SQL = r"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, role, i, x, length(regexp_replace(regexp_extract(x, '^[ \t]*(?:>[ \t]*)*'), '[^>]', '', 'g')) AS v
  FROM (SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations)
), n AS (
  SELECT *, coalesce(lag(v) OVER w, -1) AS before, coalesce(lead(v) OVER w, 0) AS after FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)
), own AS (
  SELECT conv_id, turn, any_value(role) AS role, max(v) AS quote_levels, count(*) FILTER (v > 0 AND v <> before) AS n_quotes,
    trim(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (v = 0 AND NOT (regexp_matches(x, '(?i)\b(wrote|writes|said):[ \t\r]*$') AND after > 0)), ''), ' ' || chr(9) || chr(13) || chr(10)) AS clean_text
  FROM n GROUP BY conv_id, turn
), runs AS (
  SELECT *, sum(CASE WHEN v <> before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM n
), passages AS (
  SELECT conv_id, turn, v AS level, string_agg(regexp_replace(x, '^[ \t]*(?:>[ \t]*)*', ''), ' ' ORDER BY i) AS p FROM runs WHERE v > 0 GROUP BY conv_id, turn, run, v
), said AS (
  SELECT conv_id, s, min(turn) AS parent FROM (
    SELECT conv_id, turn, trim(regexp_replace(s, '[^\p{L}\p{N}]+', ' ', 'g')) AS s, 2 AS least
    FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(replace(clean_text, chr(10), ' ')), '[.!?]+(?:\s+|$)')) AS s FROM own)
    UNION ALL
    SELECT conv_id, turn, trim(regexp_replace(lower(clean_text), '[^\p{L}\p{N}]+', ' ', 'g')), 1 FROM own
  ) WHERE s <> '' AND len(string_split(s, ' ')) >= least GROUP BY conv_id, s
), quoted AS (
  SELECT DISTINCT conv_id, turn, level, s FROM (
    SELECT conv_id, turn, level, trim(regexp_replace(s, '[^\p{L}\p{N}]+', ' ', 'g')) AS s, 2 AS least
    FROM (SELECT conv_id, turn, level, unnest(regexp_split_to_array(lower(p), '[.!?]+(?:\s+|$)')) AS s FROM passages)
    UNION ALL
    SELECT conv_id, turn, level, trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')), 1 FROM passages
  ) WHERE s <> '' AND len(string_split(s, ' ')) >= least
), best AS (
  SELECT conv_id, turn, parent FROM (SELECT conv_id, turn, level, parent, count(*) AS n FROM quoted JOIN said USING (conv_id, s) WHERE parent < turn GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, parent DESC) = 1
), up AS (
  SELECT conv_id, turn, parent, parent AS root, CAST(1 AS BIGINT) AS depth FROM best
  UNION ALL
  SELECT up.conv_id, up.turn, up.parent, best.parent, up.depth + 1 FROM up JOIN best ON best.conv_id = up.conv_id AND best.turn = up.root
), tree AS (
  SELECT conv_id, turn, parent, min(root) AS root, max(depth) AS depth FROM up GROUP BY conv_id, turn, parent
)
SELECT conv_id, turn, role, clean_text, CAST(n_quotes AS BIGINT) AS n_quotes, CAST(quote_levels AS BIGINT) AS quote_levels, parent AS parent_turn, coalesce(root, turn) AS root_turn, coalesce(depth, 0) AS depth
FROM own LEFT JOIN tree USING (conv_id, turn)
"""
