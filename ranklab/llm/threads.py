"""Operator 7: quotation linking and reply-ordered conversations, all in DataFrame operations.

1. Each line's quote level is the number of ``>`` markers that it starts with. Consecutive quoted lines of one level are a
   passage. A message's own text is its lines of level 0, without attribution lines ("... wrote:") right before a quote.
2. Passages and own texts are normalised (markers off, white space to one space, lower case) and hashed: a passage as a whole and line by
   line, an own text as a whole, by paragraph and by line.
3. Every quoted hash takes the *latest earlier* message of its conversation with that hash. This is an as-of lookup, a running
   maximum over rows range-partitioned by (conversation, hash, turn): no pair of rows is ever built, and a line that is frequent
   in one large conversation spreads over tasks.
4. A message replies to the original that its level-1 quotes match with most characters (the latest of equals). Deeper
   levels give links but no parent.
5. Roots come from pointer doubling over (message -> parent). Threads follow each other in the order of their roots, and
   inside a thread turns rise, so each message stands after the one that it replies to; positions are distributed running counts.

Defined results: a null text is empty; a null turn comes before all others; a null conversation is a conversation of its own;
messages without matched quotes are roots; equal rows are one message that stands once for each copy; an empty table gives an empty result;
only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklab.llm.common import register, table
from ranklab.operators.ordered import range_pieces, with_running_sums
from ranklab.session import cut_lineage

MARKERS = r"^((?:[ \t]{0,3}>)*)"
ATTRIBUTION = r"(?i)(^\s*(on|am|le|el)\b.*|^.*)\b(wrote|schrieb|écrit|escribió)\s*:\s*$"
MIN_CHARS = 1              # every text that is not empty links; votes count characters, so long matches win


def level_of(line) -> F.Column:
    return F.regexp_count(F.regexp_extract(line, MARKERS, 1), F.lit(">"))


def normalised(text) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def messages(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(m, conv, turn, role, copies, lines: [line, level]) of distinct messages; ``m`` identifies the content."""
    m = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                             F.col(role_col).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    m = m.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    text = F.transform(F.split("text", r"\r?\n"), lambda x: F.struct(x.alias("line"), level_of(x).alias("level")))
    return m.select(F.xxhash64("conv_id", F.coalesce("turn", F.lit(-1)), F.col("turn").isNull(), F.coalesce("role", F.lit("")), F.md5("text")).alias("m"),
                    F.xxhash64("conv_id").alias("conv"), "conv_id", "turn", "role", "copies", text.alias("lines"),
                    F.coalesce("turn", F.lit(-(1 << 62))).alias("_turn"))


def own_lines(lines) -> F.Column:
    """The message's own lines: level 0, attribution lines before a quote left out."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(
        x["line"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    return F.transform(kept, lambda x: x["line"])


def quoted_units(msgs: DataFrame) -> DataFrame:
    """(m, conv, _turn, passage, level, chars, hash): passages and, of passages of several lines, their lines."""
    q = msgs.filter(F.exists("lines", lambda x: x["level"] > 0)).select("m", "conv", "_turn", F.posexplode("lines").alias("i", "x"))
    q = q.select("m", "conv", "_turn", "i", "x.level", F.regexp_replace("x.line", MARKERS, "").alias("line"))
    in_message = Window.partitionBy("m").orderBy("i")              # the lines of one text
    q = q.withColumn("new", (F.coalesce(F.lag("level").over(in_message), F.lit(-1)) != F.col("level")).cast("int"))
    q = q.withColumn("passage", F.sum("new").over(in_message)).filter("level > 0")
    p = q.groupBy("m", "conv", "_turn", "passage", "level").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("parts"))
    units = F.when(F.size("parts") > 1, F.concat(F.array(F.array_join("parts", " ")), F.col("parts"))).otherwise(F.col("parts"))
    u = p.select("m", "conv", "_turn", "passage", "level", F.explode(units).alias("unit")).withColumn("unit", normalised(F.col("unit")))
    return u.filter(F.length("unit") >= MIN_CHARS).select("m", "conv", "_turn", "passage", "level", F.length("unit").alias("chars"),
                                                          F.md5("unit").alias("hash"))


def own_units(msgs: DataFrame) -> DataFrame:
    """(m, conv, _turn, hash): own text as a whole, its paragraphs and its lines."""
    o = msgs.select("m", "conv", "_turn", F.array_join(own_lines(F.col("lines")), "\n").alias("own"))
    units = F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", r"\n")))
    u = o.select("m", "conv", "_turn", F.explode(units).alias("unit")).withColumn("unit", normalised(F.col("unit")))
    return u.filter(F.length("unit") >= MIN_CHARS).select("m", "conv", "_turn", F.md5("unit").alias("hash")).distinct()


def latest_before(events: DataFrame) -> DataFrame:
    """Rows of ``events`` (conv, hash, _turn, own, m, ...) that are quotes, with ``origin`` = (_turn, m) of the latest own row of an
    earlier turn: the running maximum over range pieces, and over the pieces' maxima."""
    group, order = ["conv", "hash"], ["_turn", "own", "m"]         # of one turn, quotes stand before own rows
    s = range_pieces(events, group, order)
    mark = F.when(F.col("own") == 1, F.struct(F.col("_turn").alias("turn"), F.col("m").alias("m")))
    inside = Window.partitionBy("_rp", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_mark", mark).withColumn("_in", F.max("_mark").over(inside))
    pieces = s.groupBy("_rp", *group).agg(F.max("_mark").alias("_top"))
    earlier = Window.partitionBy(*group).orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)   # a row a partition
    pieces = pieces.select("_rp", *group, F.max("_top").over(earlier).alias("_before"))
    s = s.filter("own = 0").join(pieces, ["_rp", *group], "left")
    return s.withColumn("origin", F.coalesce("_in", "_before")).drop("_rp", "_mark", "_in", "_before")


def quote_links(msgs: DataFrame) -> DataFrame:
    """(m, passage, level, origin, origin_turn, chars): the original of each quoted passage."""
    q = cut_lineage(quoted_units(msgs))
    o = own_units(msgs).join(q.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    none = F.lit(None).cast("int")
    events = q.withColumn("own", F.lit(0)).unionByName(o.select(
        "m", "conv", "_turn", none.alias("passage"), none.alias("level"), none.alias("chars"), "hash", F.lit(1).alias("own")), allowMissingColumns=True)
    hit = latest_before(events).filter("origin is not null")
    return hit.groupBy("m", "passage", "level", F.col("origin.m").alias("origin"), F.col("origin.turn").alias("origin_turn")) \
        .agg(F.max("chars").alias("chars"))


def roots(parents: DataFrame) -> DataFrame:
    """(m, root) by pointer doubling over (m, parent); rounds grow with the logarithm of the longest reply chain."""
    r = cut_lineage(parents.select("m", F.col("parent").alias("root")))
    while True:
        up = r.select(F.col("m").alias("root"), F.col("root").alias("_up"))
        n = r.join(up, "root", "left").select("m", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved"))
        n = cut_lineage(n)
        moved = n.filter("_moved").limit(1).count()
        r = n.drop("_moved")
        if not moved:
            return r


def reply_ordered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """One row a message: conv_id, turn, role, text (without quotes), n_quotes, n_linked, parent_turn, root_turn, position (from 1
    within the conversation)."""
    msgs = cut_lineage(messages(conversations, conv_col, turn_col, role_col, text_col))
    links = cut_lineage(quote_links(msgs))
    votes = links.filter("level = 1").groupBy("m", "origin", "origin_turn").agg(F.sum("chars").alias("votes"))
    parents = votes.groupBy("m").agg(F.max(F.struct("votes", "origin_turn", "origin")).alias("p")).select("m", F.col("p.origin").alias("parent"))
    tops = roots(parents)
    about = msgs.select("m", "_turn", "turn")
    replies = parents.join(about.select(F.col("m").alias("parent"), F.col("turn").alias("parent_turn")), "parent") \
        .join(tops, "m").join(about.select(F.col("m").alias("root"), F.col("_turn").alias("_root_turn"), F.col("turn").alias("root_turn")), "root")
    quotes = F.size(F.filter("lines", lambda x: x["level"] > 0))
    linked = links.groupBy("m").agg(F.count_distinct("passage").alias("n_linked"))
    # a window over a hash of the text's lines would need no shuffle; the replies are few beside the messages
    a = msgs.join(replies.drop("parent"), "m", "left").join(linked, "m", "left")
    own = F.regexp_replace(F.array_join(own_lines(F.col("lines")), "\n"), r"^\s+|\s+$", "")
    a = a.select("conv", "conv_id", "turn", "role", own.alias("text"), quotes.alias("n_quotes"),
                 F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"),
                 F.coalesce("_root_turn", "_turn").alias("_root_turn"), F.coalesce("root", "m").alias("root"), "_turn", "m", "copies")
    a = a.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumn("_1", F.lit(1))
    order = ["_root_turn", "root", "_turn", "m", "_copy"]
    s = with_running_sums(range_pieces(a, ["conv"], order), ["conv"], order, {"position": "_1"})
    return s.select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "parent_turn", "root_turn", F.col("position").cast("long").alias("position"))


@register("op7_quotation_threads")
def op7_quotation_threads(spark, sf_dir):
    return reply_ordered(table(spark, sf_dir, "conversations"))
