"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned spans.  Each span becomes one
window: the leading system turn is retained, turns of the span before are repeated up to a history
budget, then follow the turns of the span.  Only assistant turns of the span itself are targets;
a repeated one is masked, so every assistant text is under the loss once.

Template: `<|start|>role<|sep|>text<|end|>`.  Inside roles and texts a backslash is doubled and one
is put behind the first character of each control string (of this template and of the common
`[INST]`, `<s>` ones), so no control string of a text survives and unescaping is exact.

A span never exceeds the budget unless a single turn does: starts are cut by cells of half the
room, and a turn longer than a cell stands alone.  Turns are dealt out by conversation and window; each turn is
emitted at most twice and the system turn once per window.  Whole conversations meet only where a
digest of a whole conversation is asked for (the query), never in the operator.

Defined cases: null text or role is empty; order is by turn, then role, then text (null turns
first); repeated rows are turns of their own; a conversation of a system turn alone gives one
window; an empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.functions.plan import computed_once
from riskloom.llm.shared import table

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
CONTROL = r"([<\[])(\||/?s>|/?INST\])"
CHARS_PER_TOKEN, TURN_TOKENS = 4, 6
BUDGET, HISTORY, LEAST_CELL = 1024, 192, 64
SYSTEM, REPEATED, OWN = 0, 1, 2


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = conv.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    length = F.length("head") + F.length("body")
    df = (
        turns.withColumn("at", F.row_number().over(conv))
        .withColumn("head", F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP)))
        .withColumn("body", escaped(F.col("text")))
        .withColumn("tokens", F.ceil(length / CHARS_PER_TOKEN) + TURN_TOKENS)
        .withColumn("system", (F.col("at") == 1) & (F.col("role") == "system"))
        .withColumn("own", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
        .withColumn("begins", F.coalesce(F.sum("own").over(before), F.lit(0)))
    )
    retained = F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(every)
    room = F.greatest(F.lit(LEAST_CELL), F.floor((budget - history - retained) / 2))
    df = df.withColumn("cell_size", room)
    df = df.withColumn("cell", F.floor(F.col("begins") / F.col("cell_size")))
    df = df.withColumn("long", F.col("own") > F.col("cell_size"))
    last = lambda name: F.lag(name).over(conv)
    opens = ~F.col("system") & (
        F.coalesce(last("system"), F.lit(True)) | (F.col("cell") != last("cell"))
        | F.col("long") | last("long")
    )
    return df.withColumn(
        "span", F.greatest(F.sum(opens.cast("int")).over(conv) - 1, F.lit(0))
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, n_context (leading turns that are not new), loss_spans, tokens."""
    turns = conversations.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    df = _spans(turns, budget, history)
    df = df.withColumn("final", F.max("span").over(Window.partitionBy("conv_id"))).withColumn(
        "ends", F.max(F.col("begins") + F.col("own")).over(Window.partitionBy("conv_id", "span"))
    )
    entry = lambda window, kind: F.struct(window.alias("window"), F.lit(kind).alias("kind"))
    in_all = F.transform(
        F.sequence(F.lit(0), F.col("final")),
        lambda k: F.struct(k.alias("window"), F.when(k == 0, OWN).otherwise(SYSTEM).alias("kind")),
    )
    own = F.array(entry(F.col("span"), OWN))
    twice = F.array(entry(F.col("span"), OWN), entry(F.col("span") + 1, REPEATED))
    repeats = (F.col("span") < F.col("final")) & (F.col("ends") - F.col("begins") <= history)
    placed = df.select(
        "conv_id", "at", "role", "head", "body", "tokens",
        F.inline(F.when(F.col("system"), in_all).when(repeats, twice).otherwise(own)),
    )
    order = Window.partitionBy("conv_id", "window").orderBy("at")
    piece = F.concat("head", "body", F.lit(END))
    behind = F.sum(F.length(piece)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("starts", F.coalesce(behind, F.lit(0)) + F.length("head"))
    target = (F.col("kind") == OWN) & (F.col("role") == "assistant")
    loss = F.when(target, F.struct(F.col("starts").alias("start"), F.length("body").alias("length")))
    parts = placed.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("at", piece.alias("piece"), loss.alias("loss")))).alias("parts"),
        F.count(F.when(F.col("kind") != OWN, 1)).alias("n_context"),
        F.sum("tokens").alias("tokens"),
    )
    return parts.select(
        "conv_id", "window",
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
        "n_context",
        F.filter(F.transform("parts", lambda p: p["loss"]), lambda s: s.isNotNull()).alias("loss_spans"),
        "tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and targets of each window as texts, read from the formatted text and its mask."""
    pieces = F.split("formatted", r"<\|end\|>")
    new = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))
    one = computed_once(
        formatted.select("conv_id", "window", "formatted", "n_context", "loss_spans"), new=new
    )

    def turn(piece: Column) -> Column:
        two = F.split(F.substr(piece, F.lit(len(START) + 1)), r"<\|sep\|>")
        return F.concat(unescaped(two[0]), F.lit("\n"), unescaped(two[1]), F.lit("\n"))

    cut = lambda s: unescaped(F.substr("formatted", s["start"].cast("int") + 1, s["length"]))
    return one.select(
        "conv_id", "window", F.size("new").cast("long").alias("n"),
        F.array_join(F.transform("new", turn), "").alias("turns"),
        F.array_join(F.transform("loss_spans", cut), "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(
        "SELECT -1L AS conv_id, * FROM VALUES (0L, 'user', '{0}'), (1L, 'assistant', '{0}') AS t(turn, role, text)".format(PROBE)
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = read_back(windows(rows.unionByName(probe)))
    whole = back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"),
    )
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', 'PROBE'), (-1, 1, 'assistant', 'PROBE'))
), e AS (
  SELECT *, row_number() OVER c AS pos,
    16 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g')) AS head,
    length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g')) AS body
  FROM t WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), k AS (
  SELECT *, CAST(ceil((head + body) / 4) AS BIGINT) + 6 AS tokens, pos = 1 AND role = 'system' AS sys FROM e
), b AS (
  SELECT *, CASE WHEN sys THEN 0 ELSE tokens END AS own,
    coalesce(sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins,
    greatest(64, floor((1024 - 192 - max(CASE WHEN sys THEN tokens ELSE 0 END)
      OVER (PARTITION BY conv_id)) / 2)) AS cell_size
  FROM k
), o AS (
  SELECT *, floor(begins / cell_size) AS cell, own > cell_size AS long FROM b
), s AS (
  SELECT *, NOT sys AND (coalesce(lag(sys) OVER w, true) OR cell <> lag(cell) OVER w OR long OR lag(long) OVER w) AS opens
  FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), p AS (
  SELECT *, greatest(sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY pos) - 1, 0) AS span FROM s
), f AS (
  SELECT *, max(span) OVER (PARTITION BY conv_id) AS final,
    max(begins + own) OVER (PARTITION BY conv_id, span) AS ends FROM p
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum((head + body + 7) * CASE WHEN sys THEN final + 1
    WHEN span < final AND ends - begins <= 192 THEN 2 ELSE 1 END)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
""".replace("PROBE", PROBE)
