"""Chat formatting that is proved by parsing: what is rendered is read back by a grammar, and texts that the grammar would
misread are escaped until it reads what was written. DataFrame functions alone.

    conversation = "<s>" turn*
    turn         = "[INST] " text " [/INST]"                    user
                 | "<<SYS>> " text " <</SYS>>"                  system
                 | "[ROLE=" name "] " text " [/ROLE]"           any other role, its name as in a URL
                 | text "</s>"                                  assistant

A text ends at the first mark that ends its turn, so the grammar has one reading. A mark inside a text is escaped by a
backslash behind its first character; one that has backslashes there already gets one more, and reading takes one from
each, so escaping is reversible for every text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
#: What stands before and behind a text, by its role.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": ("", END)}
OTHER = ("[ROLE=", "] ", " [/ROLE]")
#: The marks as a text may hold them: first character, backslashes, rest.
_TAIL = r"(/?INST\]|/?ROLE[=\]]|/?s>|</?SYS>>)"
ESCAPE, UNESCAPE = rf"([\[<])(\\*){_TAIL}", rf"([\[<])\\(\\*){_TAIL}"
_FIXED = "|".join(rf"{re.escape(a)}.*?{re.escape(b)}" for a, b in MARKS.values() if a)
#: A turn that begins where the one before ended: nothing is searched for.
TURN = rf"(?s)\G(?:{_FIXED}|\[ROLE=[^\]]*\] .*? \[/ROLE\]|.*?{END})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1$2\\$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def _of_role(role: Column, i: int, other: Column | str) -> Column:
    own = F
    for name, marks in MARKS.items():
        own = own.when(role == name, marks[i])
    return own.otherwise(other)


def rendered(role: Column, text: Column) -> Column:
    """The segments of a turn: what precedes its text, the text, what follows; loss is true for the text of an assistant."""
    before = _of_role(role, 0, F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit(OTHER[1])))
    return F.array(F.struct(before.alias("text"), F.lit(False).alias("loss")), F.struct(text.alias("text"), (role == "assistant").alias("loss")), F.struct(_of_role(role, 1, OTHER[2]).alias("text"), F.lit(False).alias("loss")))


def segments(turns: Column, escaped: bool) -> Column:
    """Of turns array<struct<role, text>>: the segments of the conversation, in order."""
    own = F.flatten(F.transform(turns, lambda t: rendered(t["role"], escape(t["text"]) if escaped else t["text"])))
    return F.concat(F.array(F.struct(F.lit(BEGIN).alias("text"), F.lit(False).alias("loss"))), own)


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def parsed(formatted: Column) -> Column:
    """The turns array<struct<role, text>> that the grammar reads; null where it can't read all of the text."""
    rest = F.substring(formatted, len(BEGIN) + 1, 2**31 - 1)
    pieces = F.regexp_extract_all(rest, F.lit(TURN), F.lit(0))

    def turn(p: Column) -> Column:
        named = F.try_url_decode(F.regexp_extract(p, r"^\[ROLE=([^\]]*)\] ", 1))
        closed = lambda a, b: p.startswith(a) & p.endswith(b)
        inner = lambda a, b: F.substr(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(b))
        kind = F.when(closed(*MARKS["user"]), "user").when(closed(*MARKS["system"]), "system").when(p.rlike(r"(?s)^\[ROLE=[^\]]*\] .* \[/ROLE\]$"), "").otherwise("assistant")
        head = F.length(F.regexp_extract(p, r"^\[ROLE=[^\]]*\] ", 0))
        text = F.when(kind == "user", inner(*MARKS["user"])).when(kind == "system", inner(*MARKS["system"])).when(kind == "", F.substr(p, head + 1, F.length(p) - head - len(OTHER[2]))).otherwise(inner("", END))
        return F.struct(F.when(kind == "", named).otherwise(kind).alias("role"), unescape(text).alias("text"))

    return F.when(formatted.startswith(BEGIN) & (F.array_join(pieces, "") == rest), F.transform(pieces, turn))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, own, turns, formatted, segments, escaped, of rows (conv_id, turn, role, text).

    turns are the turns as they were read back from formatted, which is the segments' texts joined; loss marks the segments
    that are learnt from, the texts of assistants. escaped tells whether texts had to be escaped; a conversation that isn't
    read back as it was written even then is an error.

    Null texts and roles are empty, null ids one conversation, null turns first; turns of one number are ordered by role,
    then by text, repeated rows stay; an empty table gives no rows; other columns aren't read, but for own, if there is
    one, which tells apart conversations of one id. A conversation is one value, so it has to fit in 2 GB; nothing larger
    than a conversation meets in a task.
    """
    own = rows["own"] if "own" in rows.columns else F.lit("")
    given = rows.select(rows["conv_id"].alias("conv_id"), own.alias("own"), F.struct(rows["turn"].alias("turn"), F.coalesce(rows["role"], F.lit("")).alias("role"), F.coalesce(rows["text"], F.lit("")).alias("text")).alias("t"))
    talks = given.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list("t")).alias("t"))
    talks = talks.select("conv_id", "own", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = talks.withColumn("segments", segments(F.col("source"), False))
    plain = plain.withColumn("formatted", joined(F.col("segments")))
    plain = plain.withColumn("turns", parsed(F.col("formatted"))).withColumn("escaped", ~F.coalesce(F.col("turns") == F.col("source"), F.lit(False)))
    safe = plain.withColumn("segments", F.when(F.col("escaped"), segments(F.col("source"), True)).otherwise(F.col("segments")))
    safe = safe.withColumn("formatted", F.when(F.col("escaped"), joined(F.col("segments"))).otherwise(F.col("formatted")))
    safe = safe.withColumn("turns", F.when(F.col("escaped"), parsed(F.col("formatted"))).otherwise(F.col("turns")))
    wrong = F.raise_error(F.concat(F.lit("not read back as written: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    checked = F.when(F.coalesce(F.col("turns") == F.col("source"), F.lit(False)), F.col("turns")).otherwise(wrong)
    return safe.select("conv_id", "own", checked.alias("turns"), "formatted", "segments", "escaped")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of format_conversations(): digests of the turns that were read back, and of what the mask marks, unescaped."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    rows = formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


#: What the extra conversation's user and assistant say: marks of the grammar.
ODD = "</s>[INST] ok [/INST]"


def with_odd_one(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, own), own empty, and a conversation -1 that says ODD twice."""
    four = ["conv_id", "turn", "role", "text"]
    odd = rows.sparkSession.range(2).select(F.lit(-1).cast(rows.schema["conv_id"].dataType), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(ODD), F.lit("odd"))
    return rows.select(*(rows[c] for c in four), F.lit("").alias("own")).union(odd)
