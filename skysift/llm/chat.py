"""Chat formatting in budgeted windows. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysift.llm.storage import materialize

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
BUDGET = 2048
HISTORY = 512
#: Marks of a turn, in tokens; and the turns of a conversation whose sums are taken together.
OVERHEAD = 4
TURNS = 256
LEAST_CELL = 64
PIECE = r"\w+|[^\w\s]"


def escape(c: Column) -> Column:
    """Texts in which no control string is left: \\ becomes \\\\ and <| becomes <\\|."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conversations (conv_id, turn, role, text, ...) -> (conv_id, window, formatted, n_context, n_tokens, targets).

    A turn costs its words and punctuation marks plus four. Prefix sums of the costs, taken per 256 turns and then over those, lay a grid of cells of
    (budget - system turn - history) / 2 over the conversation; a turn belongs to the cell in which it ends, so that a window holds under two cells,
    and a turn longer than a cell is a window by itself (whole, even beyond the budget). Each window begins with the system turn (if the first turn
    is one) and the turns of the last `history` tokens before it; those repeats are context. targets: (start, length) in code points of the
    assistant texts that are new in the window, so each is under the mask once. Null role and text count as empty; turns are ordered by turn, role,
    text with nulls first; repeated rows are turns of their own; a null conv_id is a conversation. Roles and texts are escaped reversibly. An empty table
    gives an empty one; extra columns, whatever their names, are not read.

    Positions are worked out on costs alone: a text moves to its part of the conversation, where its place is written down, and to its windows. Keys are structs, which are equal
    where conv_id or turn are both null."""
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.select(F.struct("conv_id").alias("key"), F.struct("conv_id", F.floor(F.col("turn") / TURNS).alias("part")).alias("part"), "turn", "role", "text", (F.regexp_count("text", F.lit(PIECE)) + F.regexp_count("role", F.lit(PIECE)) + OVERHEAD).cast("long").alias("cost"))
    parts = t.groupBy("part").agg(F.sum("cost").alias("part_cost"), F.count("*").alias("part_turns"), F.min(F.struct("turn", "role", "text", "cost")).alias("first"))
    parts = parts.withColumn("key", F.struct("part.conv_id"))
    before = Window.partitionBy("key").orderBy(F.col("part.part").asc_nulls_first())
    upto = before.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "key", "part", F.coalesce(F.sum("part_cost").over(upto), F.lit(0)).alias("cost_before"), F.coalesce(F.sum("part_turns").over(upto), F.lit(0)).alias("turns_before"),
        F.first(F.when(F.col("first.role") == "system", F.col("first.cost"))).over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("sys"), "first",
    )
    places = parts.select("part", "cost_before", "turns_before", F.col("sys").isNotNull().alias("has_system"), F.coalesce("sys", F.lit(0)).alias("sys_cost"))
    places = places.withColumn("cell", F.greatest(F.lit(LEAST_CELL), F.floor((budget - F.col("sys_cost") - history) / 2)))
    w = Window.partitionBy("part").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"within": F.sum("cost").over(w), "nr": F.count("*").over(w)}).join(places, "part")
    t = t.withColumn("pos", F.col("turns_before") + F.col("nr") - 1)
    t = t.withColumn("is_system", (F.col("pos") == 0) & F.col("has_system"))
    t = t.withColumn("own", F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("cost")))
    t = t.withColumn("p1", F.col("cost_before") + F.col("within") - F.col("sys_cost")).withColumn("p0", F.col("p1") - F.col("own"))
    last_cell = F.floor((F.col("p1") - 1) / F.col("cell"))
    t = t.withColumn("window", F.when(F.col("is_system"), F.lit(1)).otherwise(last_cell * 2 + F.when(F.col("own") <= F.col("cell"), 1).otherwise(0)))
    # written once: what follows reads only the columns that it needs
    t = materialize(t.select("key", "part", "role", "text", "cost", "pos", "is_system", "own", "p0", "p1", "cell", "window"), "turns")
    reach = F.least(F.lit(history), F.col("cell"))
    begins = t.groupBy("key", "window").agg(F.min(F.when(~F.col("is_system"), F.col("p0"))).alias("w0"), F.first("cell").alias("cell"))
    past = t.where(~F.col("is_system") & (F.col("own") <= reach)).select(
        "key", "part", "pos", "p0", "p1", reach.alias("reach"), F.explode(F.sequence(F.floor(F.col("p1") / F.col("cell")), F.floor((F.col("p0") + reach) / F.col("cell")))).alias("at")
    )
    past = past.join(begins.select("key", F.col("window").alias("again"), "w0", F.floor(F.col("w0") / F.col("cell")).alias("at")), ["key", "at"])
    past = past.where((F.col("p1") <= F.col("w0")) & (F.col("w0") - F.col("p0") <= F.col("reach")))
    again = past.groupBy("part", "pos").agg(F.collect_list("again").alias("_again"))  # the few windows within reach of a turn
    t = t.join(again, ["part", "pos"], "left")
    own = F.array(F.struct(F.col("window").alias("window"), F.lit(True).alias("new")))
    repeats = F.transform("_again", lambda w: F.struct(w.alias("window"), F.lit(False).alias("new")))
    t = t.withColumn("_w", F.explode(F.concat(own, F.coalesce(repeats, F.slice(own, 1, 0)))))
    turn = lambda pos, new: F.struct(pos.alias("pos"), "role", "text", "cost", new.alias("new")).alias("seg")
    rows = t.select("key", F.col("_w.window").alias("window"), turn(F.col("pos").cast("long"), F.col("_w.new")))
    system = parts.where((F.col("turns_before") == 0) & (F.col("first.role") == "system")).select("key", "first.role", "first.text", "first.cost")
    leads = begins.where("window <> 1").select("key", "window").join(system, "key").select("key", "window", turn(F.lit(-1).cast("long"), F.lit(False)))
    g = rows.unionByName(leads).groupBy("key", "window").agg(F.array_sort(F.collect_list("seg")).alias("segs")).select("key.conv_id", "window", "segs")
    g = g.withColumn("segs", F.transform("segs", lambda s: F.struct(F.concat(F.lit(START), escape(s["role"]), F.lit(SEP)).alias("head"), escape(s["text"]).alias("body"), (s["new"] & (s["role"] == "assistant")).alias("loss"), s["new"].alias("new"), s["cost"].alias("cost"))))
    none = F.array().cast("array<struct<start:int,length:int>>")
    marks = F.aggregate(
        "segs", F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + F.length(s["head"]) + F.length(s["body"]) + len(END)).alias("at"),
            F.when(s["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(s["head"])).alias("start"), F.length(s["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ), lambda a: a["spans"],
    )
    return g.select(
        "conv_id", "window",
        F.array_join(F.transform("segs", lambda s: F.concat(s["head"], s["body"], F.lit(END))), "").alias("formatted"),
        F.size(F.filter("segs", lambda s: ~s["new"])).alias("n_context"),
        F.aggregate("segs", F.lit(0).cast("long"), lambda a, s: a + s["cost"]).alias("n_tokens"),
        marks.alias("targets"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """windows -> (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the formatted text and the mask alone."""
    segs = F.split("formatted", r"<\|im_end\|>")
    new = F.slice(segs, F.col("n_context") + 1, F.size(segs) - 1 - F.col("n_context"))
    read = lambda s: F.concat(
        unescape(F.substring_index(F.substring(s, len(START) + 1, 2147483647), SEP, 1)), F.lit("\n"), unescape(F.substring_index(s, SEP, -1)), F.lit("\n")
    )
    w = formatted.select(
        "conv_id", (F.size(segs) - 1 - F.col("n_context")).cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
        F.struct(
            "window", F.array_join(F.transform(new, read), "").alias("turns"),
            F.array_join(F.transform("targets", lambda t: unescape(F.substring(F.col("formatted"), t["start"] + 1, t["length"]))), "").alias("loss"),
        ).alias("w"),
    )
    g = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    g = g.select("conv_id", "n_turns", F.array_join("ws.turns", "").alias("turns"), F.array_join("ws.loss", "").alias("loss"), "formatted_chars", "n_windows")
    return g.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = f"{END}{START}assistant ok"
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    return read_back(windows(c.unionByName(extra)))


_CHARS = "length({0}) + length({0}) - length(replace({0}, chr(92), '')) + (length({0}) - length(replace({0}, '<|', ''))) // 2"
_PIECES = r"len(regexp_extract_all({0}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]'))"
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -1, v.turn, v.role, '{END}{START}assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM c
), u AS (
  SELECT *, {_PIECES.format('text')} + {_PIECES.format('role')} + {OVERHEAD} AS cost, {len(START) + len(SEP) + len(END)} + {_CHARS.format('role')} + {_CHARS.format('text')} AS chars FROM t
), v AS (
  SELECT *, pos = 0 AND role = 'system' AS sys, max(CASE WHEN pos = 0 AND role = 'system' THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_cost,
    max(CASE WHEN pos = 0 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id) AS sys_chars, sum(cost) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM u
), w AS (
  SELECT *, greatest({LEAST_CELL}, ({BUDGET} - sys_cost - {HISTORY}) // 2) AS cell, upto - sys_cost AS p1, CASE WHEN sys THEN 0 ELSE cost END AS own FROM v
), x AS (
  SELECT *, p1 - own AS p0, least({HISTORY}, cell) AS reach, CASE WHEN sys THEN 1 ELSE 2 * ((p1 - 1) // cell) + CASE WHEN own <= cell THEN 1 ELSE 0 END END AS win FROM w
), b AS (
  SELECT conv_id, win, min(p0) FILTER (NOT sys) AS w0, sum(chars) AS fresh, max(sys_chars) AS sys_chars FROM x GROUP BY conv_id, win
), r AS (
  SELECT b.conv_id, b.win, sum(x.chars) AS repeated FROM b JOIN x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND NOT x.sys AND x.own <= x.reach AND x.p1 <= b.w0 AND b.w0 - x.p0 <= x.reach GROUP BY ALL
), f AS (
  SELECT b.conv_id, count(*) AS n_windows, sum(fresh + coalesce(repeated, 0) + CASE WHEN b.win <> 1 THEN coalesce(sys_chars, 0) ELSE 0 END)::BIGINT AS formatted_chars
  FROM b LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.win = b.win GROUP BY b.conv_id
), g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM x GROUP BY conv_id
)
SELECT g.*, formatted_chars, n_windows FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id
"""
