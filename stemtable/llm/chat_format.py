"""Chat formatting: conversations as training texts in windows of a token budget.

A turn becomes ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a
line end.  Control strings inside texts and roles, of this template and of other
common ones, get a backslash behind their first character; a control string that
has backslashes there gets one more, so that removing one restores every text.

Windows are spans of whole turns.  Every turn has a number of tokens, and prefix
sums of them over a conversation place the turns: turns whose last tokens lie in
the same stretch of ``stride`` tokens form a span, and a turn longer than a
stride is a span of its own.  A span then holds less than two strides.  The
stride of a conversation is half of what ``budget`` leaves beside its system turn
and ``history``, so that no window exceeds the budget, unless a single turn or
the system turn does; ``over_budget`` tells.

Every window but the first begins with the conversation's system turn, if its
first turn is one, and with the turns directly before its span that begin within
``history`` tokens of it.  The loss mask covers the texts of the assistant's
turns of the span; repeated turns are context and masked, so every assistant text
is learned once.

Tokens are counted without a vocabulary: runs of at most ``PIECE`` letters or
digits, and every other character but white space, count one, and a turn's marks
``MARKS`` tokens.

Rows of a conversation go by turn, then role and a hash of the text; a null turn is last.  Null
text and null role are empty.  Rows without conversation are one conversation.
Repeated rows are turns of their own.  An empty table gives no windows.  Texts
are whole whatever their length.  Further columns of the rows are left out.

Prefix sums go over range chunks with a carry, so a conversation of any number of
turns is spread; a window is the largest thing in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtable.llm.frames import written
from stemtable.operators.spread import running_total, skew_join

BUDGET = 1024
HISTORY = 128
PIECE = 4
MARKS = 4

# The marks, and what makes "<" or "[" the start of a control string of a common template.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"\||/?s>|/?SYS>>|/?INST\]|/?AVAILABLE_TOOLS\]|/?TOOL_RESULTS\]|TOOL_CALLS\]|start_of_turn>|end_of_turn>|bos>|eos>|unk>|pad>"
TOKEN = rf"[\p{{L}}\p{{N}}]{{1,{PIECE}}}|[^\p{{L}}\p{{N}}\x09-\x0D\x20]"
ESCAPE = rf"([<\[])(\\*)(?={CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)(?={CONTROL})"


def escaped(text: Column) -> Column:
    """A text in which no control string is left."""
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescaped(text: Column) -> Column:
    """The text that was ``escaped``."""
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def role_name(role: Column) -> Column:
    """A role as one line: ``~`` and line ends are marked by ``~``."""
    return escaped(F.replace(F.replace(role, F.lit("~"), F.lit("~~")), F.lit("\n"), F.lit("~n")))


def role_of(name: Column) -> Column:
    """The role that ``role_name`` wrote."""
    parts = F.transform(F.split(unescaped(name), "~~", -1), lambda part: F.replace(part, F.lit("~n"), F.lit("\n")))
    return F.array_join(parts, "~")


def n_tokens(text: Column) -> Column:
    """Runs of at most PIECE letters or digits, and single other characters but white space."""
    marked = F.regexp_replace(text, TOKEN, "x")
    return F.length(F.regexp_replace(marked, "[^x]", "")).cast("long")


def turns(rows: DataFrame) -> DataFrame:
    """``key, conv_id, turn, role, text`` of each row and ``mark``, a hash of its text."""
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("key"),
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("mark", F.md5(F.col("text").cast("binary")))


def spans(listed: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The turns without their texts, placed.

    They have ``ends`` (tokens up to and with the turn), ``tokens``, ``is_system``,
    ``stride``, and ``span``, a key that rises along the conversation.
    """
    order = ["turn", "role", "mark"]
    tokens = n_tokens(F.col("text")) + n_tokens(F.col("role")) + MARKS
    narrow = listed.select("key", *order, tokens.alias("tokens"))
    placed = running_total(narrow, ["key"], order, {"ends": F.col("tokens")})
    placed = placed.withColumn("is_system", (F.col("role") == "system") & (F.col("ends") == F.col("tokens")))
    system = placed.filter("is_system").select("key", F.col("tokens").alias("kept"))
    placed = skew_join(placed, system, ["key"])
    left = F.lit(budget - history) - F.coalesce("kept", F.lit(0))
    placed = placed.withColumn("stride", F.greatest(F.floor(left / 2), F.lit(max(history, 1))).cast("long"))
    stretch = F.floor((F.col("ends") - 1) / F.col("stride")).alias("stretch")
    span = F.struct(stretch, (F.col("tokens") <= F.col("stride")).alias("short"))
    return placed.withColumn("span", span).drop("kept")


def memberships(placed: DataFrame, history: int = HISTORY) -> DataFrame:
    """``key, turn, role, mark``, ``span``, ``kind``, ``ends``, ``tokens``: which turns each window holds.

    ``kind`` is 0 for the system turn again, 1 for history, 2 for the turns of the span.
    """
    begin = F.col("ends") - F.col("tokens")
    body = ["turn", "role", "mark", "ends", "tokens"]
    extent = placed.groupBy("key", "span").agg(F.min(begin).alias("starts"), F.first("stride").alias("stride"))
    # A turn is history of the spans that begin behind it, but no further than ``history`` from its own start.
    slot = F.explode(F.sequence(F.floor(F.col("ends") / F.col("stride")), F.floor(F.col("reach") / F.col("stride"))))
    before = placed.withColumn("reach", begin + history).filter("reach >= ends and not is_system")
    before = before.select("key", *body, "reach", slot.alias("slot"))
    slots = extent.select("key", "span", "starts", F.floor(F.col("starts") / F.col("stride")).alias("slot"))
    repeated = before.join(slots, ["key", "slot"]).filter("starts >= ends and starts <= reach")
    # The first window holds the system turn as its own.
    kept = skew_join(extent.filter("starts > 0"), placed.filter("is_system").select("key", *body), ["key"], "inner")
    out = placed.select("key", "span", F.lit(2).alias("kind"), *body)
    for kind, more in ((1, repeated), (0, kept)):
        out = out.unionByName(more.select("key", "span", F.lit(kind).alias("kind"), *body))
    return out


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window.

    ``conv_id``; ``starts``, the tokens of the conversation before the span, by
    which the windows of a conversation are in order; ``text``; ``tokens``;
    ``over_budget``; ``n_context``, the number of repeated turns in front;
    ``n_new``, that of the others; ``loss``, the spans (start, size) of learned
    text in code points of ``text``.
    """
    listed = turns(rows)
    placed = written(spans(listed, budget, history), "turns")
    # Texts are moved twice: to the windows that want them, and into these.
    place = ["key", "turn", "role", "mark"]
    texts = listed.groupBy(*place).agg(F.first("text").alias("text"), F.first("conv_id").alias("conv_id"))
    members = memberships(placed, history).join(texts, place)
    body = F.struct("ends", "role", "text", "tokens").alias("body")
    grouped = members.groupBy("key", "span").agg(
        F.sort_array(F.collect_list(F.struct("kind", body))).alias("list"),
        F.first("conv_id").alias("conv_id"),
        F.min(F.when(F.col("kind") == 2, F.col("ends") - F.col("tokens"))).alias("starts"),
    )
    marked = F.transform(
        "list",
        lambda m: F.struct(
            m["kind"].alias("kind"),
            F.concat(F.lit(START), role_name(m["body"]["role"]), F.lit("\n")).alias("head"),
            escaped(m["body"]["text"]).alias("text"),
            ((m["kind"] == 2) & (m["body"]["role"] == "assistant")).alias("learned"),
            m["body"]["tokens"].alias("tokens"),
        ),
    )
    tail = F.lit(END + "\n")
    none = F.array().cast("array<struct<start:bigint,size:bigint>>")
    step = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))

    def learned(a: Column, m: Column) -> Column:
        start = (a["at"] + F.length(m["head"])).cast("long").alias("start")
        return F.struct(start, F.length(m["text"]).cast("long").alias("size"))

    masked = F.aggregate(
        "marked",
        step,
        lambda a, m: F.struct(
            (a["at"] + F.length(m["head"]) + F.length(m["text"]) + len(END) + 1).cast("long").alias("at"),
            F.when(m["learned"], F.concat(a["found"], F.array(learned(a, m)))).otherwise(a["found"]).alias("found"),
        ),
    )
    tokens = F.aggregate("marked", F.lit(0).cast("long"), lambda a, m: a + m["tokens"])
    return grouped.withColumn("marked", marked).select(
        "conv_id",
        "starts",
        F.array_join(F.transform("marked", lambda m: F.concat(m["head"], m["text"], tail)), "").alias("text"),
        tokens.alias("tokens"),
        (tokens > budget).alias("over_budget"),
        F.size(F.filter("marked", lambda m: m["kind"] < 2)).alias("n_context"),
        F.size(F.filter("marked", lambda m: m["kind"] == 2)).alias("n_new"),
        masked["found"].alias("loss"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """``conv_id, starts, chars, turns, learned`` of each window, from its text and mask alone:
    its new turns with role and text, and the learned texts joined."""
    # Behind the last end mark there is only an empty piece.
    pieces = F.slice(F.split("text", r"<\|im_end\|>\n", -1), F.col("n_context") + 1, F.col("n_new"))
    parsed = F.transform(
        pieces,
        lambda p: F.struct(
            role_of(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescaped(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text"),
        ),
    )
    learned = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"].cast("int") + 1, s["size"].cast("int"))))
    return made.select(
        "conv_id",
        "starts",
        F.length("text").cast("long").alias("chars"),
        parsed.alias("turns"),
        F.array_join(learned, "").alias("learned"),
    )


def digested(made: DataFrame) -> DataFrame:
    """One row per conversation of what is read back from its windows.

    A digest needs a conversation's text in one place; the windows do not.
    """
    back = read_back(made)
    listed = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    window = F.struct("starts", listed.alias("turns"), "learned")
    grouped = back.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(window)).alias("all"),
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
    )
    every = F.array_join(F.col("all.turns"), "")
    learned = F.array_join(F.col("all.learned"), "")
    return grouped.select(
        "conv_id",
        "n_turns",
        F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
