"""Chat formatting by perspective rotation: each participant in turn speaks as the assistant.

For every participant of a conversation the whole dialogue is rendered once: that speaker's turns as
``assistant``, those of others as ``user`` with their name, system turns unchanged.  A rendering is a run
of segments, one row each, with their place in it in characters; only what the chosen speaker says and
its end mark are to be trained on.

Nothing that is said can look like a mark: of ``<|im_`` in texts and names a space parts the first two signs from the rest,
and white space within names becomes one space each, so no turn or name opens another turn.

Everything is joins, groupings and windows.  Turns are put in order once for each conversation; what differs between
its renderings are lengths of heads alone, so places are running sums over rows without texts, in two levels, over stretches of
turns and inside a stretch, so that a very long conversation isn't one task's work.  Texts join at the end.

Turns are ordered by number (null first), then speaker, then text; repeated rows are repeated turns.  A
null speaker is called ``unknown``, a null text is empty, a null conversation is one conversation.  Where
only system turns exist nobody can be rotated in and there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stored, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, UNKNOWN = "system", "unknown"
#: How marks begin, and what stands for that where it is said.
MARK, PLAIN = "<|im_", "<| im_"
#: Turn numbers in a stretch.
STRETCH = 1024


def rotations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Segments of all renderings.

    conv_id, perspective, position (from 0), turn, speaker, role, name (of users), segment, train,
    start and stop (characters of the rendering), train_start and train_stop (an empty span at start where not trained).
    """
    ready(turns.sparkSession)
    plain = lambda c: F.replace(c, F.lit(MARK), F.lit(PLAIN))
    said = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        plain(F.regexp_replace(F.coalesce(F.col(speaker), F.lit(UNKNOWN)), r"[\t\n\x0B\f\r]", " ")).alias("speaker"),
        plain(F.coalesce(F.col(text), F.lit(""))).alias("said"),
    ).withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    order = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "speaker", "said")
    said = stored(said.withColumn("inside", F.row_number().over(order) - 1), "turns")
    light = said.select("conv_id", "stretch", "inside", "turn", "speaker", F.length("said").alias("length"))
    views = light.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    rows = light.join(views, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv").withColumns({"train": own, "role": F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")})
    rows = rows.withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit(OPEN), "role", F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("\n"))
    rows = rows.withColumn("opens", F.length(head)).withColumn("size", (F.col("opens") + F.col("length") + len(CLOSE)).cast("long"))

    key = ["conv_id", "perspective"]
    totals = rows.groupBy(*key, "stretch").agg(F.sum("size").alias("chars"), F.count("*").alias("many"))
    earlier = Window.partitionBy(*key).orderBy(F.col("stretch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*(F.col(c).alias(f"_{c}") for c in (*key, "stretch")), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars"), F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("many"))
    sofar = Window.partitionBy(*key, "stretch").orderBy("inside").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("before", F.sum("size").over(sofar) - F.col("size"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*key, "stretch")]
    placed = inner.join(base, same[0] & same[1] & same[2]).select(
        *key, "stretch", "inside", (F.col("many") + F.col("inside")).alias("position"), "turn", "speaker", "role", "name", "train", (F.col("chars") + F.col("before")).alias("start"), "opens", "size",
    )
    texts = said.select(F.col("conv_id").alias("_conv_id"), F.col("stretch").alias("_stretch"), F.col("inside").alias("_inside"), "said")
    whole = placed.join(texts, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & F.col("stretch").eqNullSafe(F.col("_stretch")) & (F.col("inside") == F.col("_inside")))
    return whole.select(
        "conv_id", "perspective", "position", "turn", "speaker", "role", "name", F.concat(head, "said", F.lit(CLOSE)).alias("segment"), "train", "start",
        (F.col("start") + F.col("size")).alias("stop"),
        F.when(F.col("train"), F.col("start") + F.col("opens")).otherwise(F.col("start")).alias("train_start"),
        F.when(F.col("train"), F.col("start") + F.col("size") - 1).otherwise(F.col("start")).alias("train_stop"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """Whole renderings with their trained spans, for conversations that fit one value."""
    listed = F.sort_array(F.collect_list(F.struct("position", "segment", "train_start", "train_stop")))
    joined = segments.groupBy("conv_id", "perspective").agg(listed.alias("s"))
    spans = F.transform(F.filter("s", lambda x: x["train_stop"] > x["train_start"]), lambda x: F.struct(x["train_start"].alias("start"), x["train_stop"].alias("stop")))
    return joined.select("conv_id", "perspective", F.array_join("s.segment", "").alias("text"), spans.alias("spans"))


def op3_chat(spark, sf_dir):
    return rotations(table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH said AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, replace(regexp_replace(coalesce(role, 'unknown'), '[\\t\\n\\x0B\\f\\r]', ' ', 'g'), '<|im_', '<| im_') AS speaker,
         replace(coalesce(text, ''), '<|im_', '<| im_') AS said
  FROM conversations),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
named AS (
  SELECT s.*, v.perspective, s.speaker = v.perspective AS train,
         CASE WHEN s.speaker = v.perspective THEN 'assistant' WHEN s.speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM said s JOIN views v ON s.conv_id IS NOT DISTINCT FROM v.conv_id),
cut AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
         '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head
  FROM named),
full_rows AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS segment FROM cut),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position,
         CAST(sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(segment) AS start
  FROM full_rows WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said))
SELECT conv_id, perspective, position, turn, speaker, role, name, segment, train, start,
       start + length(segment) AS stop,
       CASE WHEN train THEN start + length(head) ELSE start END AS train_start,
       CASE WHEN train THEN start + length(segment) - 1 ELSE start END AS train_stop
FROM placed
"""
