r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (type, text, uri, units). A visitor flattens them in
order: text is escaped and copied; an image, audio or document part becomes a placeholder
``<image>``, ``<audio>`` or ``<document>``, its attachment reference is recorded with the
placeholder's position, and it counts for as many tokens as it expands to: ``units`` (tiles,
seconds, pages) times the tokens of its kind. Turns are joined to

    <s>ROLE[INST]CONTENT[/INST]</s>

A control string inside a role or text is escaped by one backslash after its first
character (``</s>`` becomes ``<\/s>``), and so is one that is already so escaped (one more
backslash), which makes the escape reversible by taking one backslash away. No control
string can arise across a border of marks and texts.

The loss mask is the list of [start, end) spans, in code points of the formatted string, of
the content of assistant turns. Text, mask and attachments can all be read back from the
output row alone (``read_back``).

Defined cases: a null text or role is empty; an unknown part type is treated as its text;
turns are ordered by turn (null first), then role, then text, so ties and repeated rows are
all kept in a defined order; a null conversation id is a conversation of its own; an empty
table gives an empty result; other columns are ignored. One conversation is one output
string, so its turns meet in one row; all else is computed row by row before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.secret_scan import running_sums

#: Tokens of one unit of an attachment.
EXPANSION = {"image": 576, "audio": 50, "document": 1024}
PARTS = "array<struct<type:string,text:string,uri:string,units:int>>"
TAILS = r"/?s>|/?INST\]|" + "|".join(f"{k}>" for k in EXPANSION)
OPEN, MID, CLOSE = "<s>", "[INST]", "[/INST]</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={TAILS})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\(?={TAILS})", "$1$2")


def text_part(text: Column) -> Column:
    """The content of a turn that has text only."""
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(0).alias("units"))
    return F.array(part).cast(PARTS)


def visit(parts: Column) -> Column:
    """struct<content, attachments: array<struct<kind, uri, at, tokens>>>; ``at`` is the
    placeholder's place in the content, in code points."""

    def attached(p: Column) -> Column:
        return p["type"].isin(*EXPANSION)

    def shown(p: Column) -> Column:
        return F.when(attached(p), F.concat(F.lit("<"), p["type"], F.lit(">"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))

    def tokens(p: Column) -> Column:
        each = F.lit(0)
        for kind, n in EXPANSION.items():
            each = F.when(p["type"] == kind, n).otherwise(each)
        return (each * F.coalesce(p["units"], F.lit(1))).cast("long")

    parts = F.coalesce(parts, F.array().cast(PARTS))
    flat = F.transform(parts, shown)
    place = F.transform(parts, lambda p, i: F.when(attached(p), F.struct(p["type"].alias("kind"), p["uri"].alias("uri"), F.length(F.array_join(F.slice(flat, 1, i), "")).cast("long").alias("at"), tokens(p).alias("tokens"))))
    return F.struct(F.array_join(flat, "").alias("content"), F.filter(place, lambda x: x.isNotNull()).alias("attachments"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """(conv, formatted, loss: array<struct<start, end>>, attachments: array<struct<turn,
    kind, uri, at, tokens>>, attachment_tokens); ``at`` counts in the formatted string."""
    seen = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visit(F.col(parts)).alias("v"))
    row = seen.select("conv", F.struct("turn", "role", F.col("v.content").alias("content"), F.col("v.attachments").alias("attachments")).alias("t"))
    chat = row.groupBy("conv").agg(F.collect_list("t").alias("ts"))
    # In the order of turn, role and text; the text is what was escaped, not its escaped form.
    keyed = F.transform("ts", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), unescape(t["content"]).alias("text"), t.alias("t")))
    chat = chat.select("conv", F.transform(F.array_sort(keyed), lambda k: k["t"]).alias("ts"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID))
    sized = F.transform("ts", lambda t: F.struct(t["turn"].alias("turn"), (t["role"] == "assistant").alias("loss"), F.length(head(t)).cast("long").alias("head"), F.length(t["content"]).cast("long").alias("body"), t["attachments"].alias("attachments"), F.concat(head(t), t["content"], F.lit(CLOSE)).alias("shown")))
    chat = chat.select("conv", sized.alias("ts"))
    # The place where each turn's content begins: what is before it, less what follows it.
    ends = running_sums(F.transform("ts", lambda t: t["head"] + t["body"] + len(CLOSE)))
    chat = chat.withColumn("starts", F.zip_with("ts", ends, lambda t, e: e - t["body"] - len(CLOSE)))
    placed = F.zip_with("ts", "starts", lambda t, s: F.struct(t.alias("t"), s.alias("s")))
    chat = chat.withColumn("placed", placed)
    loss = F.transform(F.filter("placed", lambda x: x["t"]["loss"]), lambda x: F.struct(x["s"].alias("start"), (x["s"] + x["t"]["body"]).alias("end")))
    files = F.flatten(F.transform("placed", lambda x: F.transform(x["t"]["attachments"], lambda a: F.struct(x["t"]["turn"].alias("turn"), a["kind"].alias("kind"), a["uri"].alias("uri"), (x["s"] + a["at"]).alias("at"), a["tokens"].alias("tokens")))))
    out = chat.select(F.col("conv").alias(conv), F.array_join(F.transform("ts", lambda t: t["shown"]), "").alias("formatted"), loss.alias("loss"), files.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns: array<struct<role, text>>, loss_texts: array<string>, formatted_chars):
    from the formatted string and the mask alone; placeholders stay as they are shown."""
    inner = F.filter(F.split("formatted", r"\[/INST\]</s>", -1), lambda x: x != "")
    turns = F.transform(inner, lambda x: F.struct(unescape(F.regexp_replace(F.regexp_extract(x, r"(?s)^<s>(.*?)\[INST\]", 1), "^$", "")).alias("role"), unescape(F.regexp_replace(x, r"(?s)^<s>.*?\[INST\]", "")).alias("text")))
    texts = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select(conv, turns.alias("turns"), texts.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts hold control strings."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table.unionByName(more).withColumn("parts", text_part(F.col("text")))
    back = read_back(format_chats(turns))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP3_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)({TAILS})', '\1\2\\\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)({TAILS})', '\1\2\\\3', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(n) + count(*) * {len(OPEN) + len(MID) + len(CLOSE)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
