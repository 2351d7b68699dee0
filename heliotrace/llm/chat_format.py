"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation many times, each time one turn longer. Every turn's prefix has a
rolling hash: the exclusive-or of two 64-bit hashes of (position, role, text) over the turns so
far. A conversation whose whole hash is a proper prefix of a longer one, or equals that of a
conversation with a smaller id, is a snapshot. Prefixes are pre-aggregated by hash before they
meet, so a first turn shared by a third of all conversations is one row for each task. An
anti-join removes the snapshots, and the maximal conversations are rendered.

Defined results: turns are ordered by turn, then role and text (nulls first), so repeated turns
have a fixed order; a null role renders as ``user`` and a null text as the empty text; a row with a
null conversation id is a conversation of its own that is never removed, so such rows meet in no
task; an empty table gives an
empty table; other columns are not read, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def plain_turns(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Turns of conversations with an id, numbered."""
    own = plain_turns(turns).where("conv_id is not null")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return own.select("conv_id", "role", "text", F.row_number().over(w).alias("position"))


def prefix_hashes(numbered: DataFrame) -> DataFrame:
    """(conv_id, position, h1, h2, n): the rolling hashes of each prefix and the conversation's length."""
    hashed = numbered.select("conv_id", "position", F.xxhash64("position", "role", "text").alias("a"), F.xxhash64(F.lit("second"), "position", "role", "text").alias("b"))
    w = Window.partitionBy("conv_id").orderBy("position")
    so_far, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id")
    return hashed.select("conv_id", "position", F.expr("bit_xor(a)").over(so_far).alias("h1"), F.expr("bit_xor(b)").over(so_far).alias("h2"), F.count("*").over(whole).alias("n"))


def snapshots(numbered: DataFrame) -> DataFrame:
    """Ids of conversations that are a prefix of a longer one, or a later copy of an equal one."""
    prefixes = prefix_hashes(numbered)
    met = prefixes.groupBy("position", "h1", "h2").agg(F.max("n").alias("longest"), F.min(F.when(F.col("position") == F.col("n"), F.col("conv_id"))).alias("first_id"))
    whole = prefixes.where("position = n").select("conv_id", "position", "h1", "h2")
    return whole.join(met, ["position", "h1", "h2"]).where("longest > position or conv_id <> first_id").select("conv_id")


def _line(start: str, end: str) -> Column:
    return F.concat(F.lit(start), "role", F.lit("\n"), "text", F.lit(end), F.lit("\n"))


def render(numbered: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """(conv_id, n_turns, text): one row for each conversation."""
    lines = numbered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", _line(start, end).alias("line")))).alias("lines"))
    return lines.select("conv_id", F.size("lines").cast("long").alias("n_turns"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))


def format_chats(turns: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """Maximal conversations, rendered."""
    numbered = numbered_turns(turns)
    single = plain_turns(turns).where("conv_id is null").select("conv_id", F.lit(1).cast("long").alias("n_turns"), _line(start, end).alias("text"))
    return render(numbered.join(snapshots(numbered), "conv_id", "left_anti"), start, end).unionByName(single)


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS position FROM conversations),
p AS (SELECT conv_id, position, count(*) OVER (PARTITION BY conv_id) AS n,
             list(role || chr(31) || text) OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM t),
m AS (SELECT prefix, max(n) AS longest, min(CASE WHEN position = n THEN conv_id END) AS first_id FROM p GROUP BY prefix),
s AS (SELECT p.conv_id FROM p JOIN m USING (prefix) WHERE p.position = p.n AND (m.longest > p.position OR p.conv_id <> m.first_id))
SELECT conv_id, count(*) AS n_turns, string_agg('{START}' || role || chr(10) || text || '{END}' || chr(10), '' ORDER BY position) AS text
FROM t WHERE conv_id IS NOT NULL AND conv_id NOT IN (SELECT conv_id FROM s WHERE conv_id IS NOT NULL) GROUP BY conv_id
UNION ALL SELECT conv_id, 1, '{START}' || role || chr(10) || text || '{END}' || chr(10) FROM t WHERE conv_id IS NULL
"""
