"""Chat formatting that is checked by reading it back.

Grammar of a formatted conversation (turns one after another, nothing between):

    user       [INST] text [/INST]
    assistant  <s> text </s>
    any other  [SYS] role NEWLINE text [/SYS]

Control strings inside texts are always escaped: one gets a backslash behind its first character, and one that already has
backslashes there gets one more, so the parser (which always takes one away) returns the source exactly. A conversation is
rendered so and parsed again by READ. Where the parsed turns differ from the source, which an odd role can cause, its roles are
escaped too; what then still differs stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

_NAMES = r"(/?(?:s>|INST\]|SYS\]))"
ESCAPE = (rf"([<\[])(\\*){_NAMES}", r"$1$2\\$3")
UNESCAPE = (rf"([<\[])(\\*)\\{_NAMES}", r"$1$2$3")
READ = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|\[SYS\] [^\n]*\n.*? \[/SYS\]"
TURN = "array<struct<role:string,text:string>>"


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, *ESCAPE)


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, *UNESCAPE)


def _role_out(r: Column, escaped: bool) -> Column:
    return F.replace(F.replace(_escape(r), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")) if escaped else r


def _role_in(r: Column) -> Column:
    return _unescape(F.replace(F.replace(r, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def render(turns: Column, roles: bool) -> Column:
    """Texts escaped, and with `roles` the roles too."""

    def one(t: Column) -> Column:
        text = _escape(t["text"])
        return (
            F.when(t["role"] == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
            .when(t["role"] == "assistant", F.concat(F.lit("<s> "), text, F.lit(" </s>")))
            .otherwise(F.concat(F.lit("[SYS] "), _role_out(t["role"], roles), F.lit("\n"), text, F.lit(" [/SYS]")))
        )

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped; raw is each turn as it stands in the string."""

    def one(x: Column) -> Column:
        role = F.when(x.startswith("[INST]"), "user").when(x.startswith("<s>"), "assistant").otherwise(_role_in(F.substring_index(F.substr(x, F.lit(7)), "\n", 1)))
        body = F.when(x.startswith("[INST]"), F.substr(x, F.lit(8), F.length(x) - 15)).when(x.startswith("<s>"), F.substr(x, F.lit(5), F.length(x) - 9)).otherwise(F.substr(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - 7))
        return F.struct(role.alias("role"), _unescape(body).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(READ), F.lit(0)), one)


def format_chats(df: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (the source), escaped (whether any control string or role is).

    One row per conv_id (null is a conversation of its own); turns in order of turn, then role, then text, nulls first, so
    ties and repeated rows have one order. Null texts and roles count as empty; texts may be of any length. An empty table gives an
    empty result. Extra columns are ignored, whatever their names. A conversation is one string, so it is gathered in one
    task; the text of other conversations never is.
    """
    some = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(some)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    grouped = df.groupBy("conv_id").agg(turns.cast(TURN).alias("turns")).withColumn("plain", render(F.col("turns"), False))
    held = (parse(F.col("plain")) == F.col("turns")) & (F.length(F.array_join(F.regexp_extract_all("plain", F.lit(READ), F.lit(0)), "")) == F.length("plain"))
    checked = grouped.withColumn("held", held).withColumn("formatted", F.when(F.col("held"), F.col("plain")).otherwise(render(F.col("turns"), True)))
    return checked.select("conv_id", "formatted", "turns", (~F.col("held") | F.exists("turns", lambda t: _escape(t["text"]) != t["text"])).alias("escaped"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds `read`: the turns parsed from formatted. A conversation that does not come back equal stops the job."""
    out = chats.withColumn("read", parse(F.col("formatted")))
    return out.withColumn("read", F.when(F.col("read") == F.col("turns"), F.col("read")).otherwise(F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast(TURN)))


def loss_spans(formatted: Column) -> Column:
    """Per assistant turn: start (0-based code point) and length of its text in formatted, still escaped."""
    parts = F.regexp_extract_all(formatted, F.lit(READ), F.lit(0))
    ends = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")), lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.when(x.startswith("<s>"), F.concat(a["out"], F.array(F.struct((a["at"] + 4).alias("start"), (F.length(x) - 9).alias("length"))))).otherwise(a["out"]).alias("out")), lambda a: a["out"])
    return ends


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one (-1), digested from what the formatted strings give when read back."""
    real = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = read_back(format_chats(real.unionByName(planted)))
    masked = F.array_join(F.transform(loss_spans(F.col("formatted")), lambda s: _unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    joined = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.withColumn("masked", masked).select(
        "conv_id",
        F.size("read").cast("bigint").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("masked"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\]|SYS\])')) AS n FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE length(role) + 14 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
