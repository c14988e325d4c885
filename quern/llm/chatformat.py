"""Chat formatting whose grammar is checked by a round trip, DataFrame operations only.

    text   := turn*
    turn   := header body "</turn>\\n"
    header := "### System: " | "### User: " | "### Assistant: " | "### Role: " role "</role>"

A body or role holds no control string ("### System: ", ..., "</role>", "</turn>"). Escaping puts
one backslash behind the first character of each control string, and one more where backslashes
stand there already; unescaping takes one away. Both match the same places, so each undoes the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END, ROLE_END = "</turn>\n", "</role>"
#: Roles with a header of their own; every other role is spelled out.
ROLES = ("system", "user", "assistant")
_TAIL = r"(## (?:System|User|Assistant|Role): |/turn>|/role>)"
ESCAPABLE, ESCAPED = rf"(#|<)(\\*){_TAIL}", rf"(#|<)\\(\\*){_TAIL}"
CONTROL = r"### (?:System|User|Assistant|Role): |</turn>|</role>"
TURN = "struct<role:string,text:string>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def header(role: Column) -> Column:
    return F.when(role.isin(*ROLES), F.concat(F.lit("### "), F.initcap(role), F.lit(": "))).otherwise(F.concat(F.lit("### Role: "), escape(role), F.lit(ROLE_END)))


def parse_turn(piece: Column) -> Column:
    """The turn (role, text) that a piece without its end mark says; null where it doesn't follow the grammar."""
    kind = F.regexp_extract(piece, r"^### (System|User|Assistant|Role): ", 1)
    rest = F.substr(piece, F.char_length(kind) + 7)
    spelled = F.substring_index(rest, ROLE_END, 1)
    body = F.when(kind == "Role", F.substr(rest, F.char_length(spelled) + len(ROLE_END) + 1)).otherwise(rest)
    role = F.when(kind == "Role", unescape(spelled)).otherwise(F.lower(kind))
    good = (kind != "") & ~body.rlike(CONTROL) & ((kind != "Role") | F.contains(rest, F.lit(ROLE_END)) & ~spelled.rlike(CONTROL))
    return F.when(good, F.struct(role.alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text; a piece that doesn't follow the grammar is a null turn."""
    pieces = F.split(formatted, END)
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parse_turn)
    rest = F.when(F.element_at(pieces, -1) != "", F.array(F.lit(None).cast(TURN))).otherwise(F.array().cast(f"array<{TURN}>"))
    return F.concat(turns, rest)


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted and spans, the places whose text is learnt.

    spans holds start and length in code points and byte_start and byte_length in UTF-8 bytes of
    each body of the role to learn, in order; the bodies are escaped as they stand there.

    Every turn is rendered as it is and parsed again; where that doesn't give the turn back, its
    text is escaped, rendered and parsed once more. The whole text is parsed at last and compared
    with the source, and the job fails if a single turn differs. Rows of a conversation are put in
    order of turn, then role and text (nulls first), so ties and repeated rows are turns too. Null
    role and text count as empty, a null conv_id is a conversation, other columns are left out, an
    empty table gives no row. A conversation is one value of the result: a task needs memory for
    the longest one, as for a text of that length.
    """
    t = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("_turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    t = t.withColumn("_header", header(F.col("role")))
    source = F.array(F.struct("role", "text"))
    render = lambda body: F.concat("_header", body, F.lit(END))
    t = t.withColumn("_same", parse(render(F.col("text"))).eqNullSafe(source))
    t = t.withColumn("_body", F.when(F.col("_same"), F.col("text")).otherwise(escape(F.col("text")))).withColumn("_turn_text", render(F.col("_body")))
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("_turn"), "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    upto = lambda size: F.coalesce(F.sum(size(F.col("_turn_text")).cast("long")).over(before), F.lit(0)) + size(F.col("_header"))
    span = F.struct(upto(F.char_length).alias("start"), F.char_length("_body").cast("long").alias("length"), upto(F.octet_length).alias("byte_start"), F.octet_length("_body").cast("long").alias("byte_length"))
    t = t.withColumn("_at", F.row_number().over(order)).withColumn("_span", F.when(F.col("role") == learn, span))
    each = F.sort_array(F.collect_list(F.struct("_at", "role", "text", "_turn_text", "_span")))
    g = t.groupBy("conv_id").agg(each.alias("_t")).withColumn("_joined", F.array_join(F.transform("_t", lambda x: x["_turn_text"]), ""))
    turns = F.transform("_t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    checked = F.when(parse(F.col("_joined")).eqNullSafe(turns), F.col("_joined")).otherwise(F.raise_error(F.lit("a conversation can't be parsed back")))
    spans = F.filter(F.transform("_t", lambda x: x["_span"]), lambda s: s.isNotNull())
    return g.select("conv_id", F.size("_t").cast("long").alias("n_turns"), checked.alias("formatted"), spans.alias("spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """chats (conv_id, formatted, spans) with turns, parsed from formatted, and learnt, the unescaped texts below spans."""
    held = chats.withColumn("_bytes", F.col("formatted").cast("binary"))
    at = lambda s: F.substring(F.col("_bytes"), (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string")
    return held.withColumn("turns", parse(F.col("formatted"))).withColumn("learnt", F.transform("spans", lambda s: unescape(at(s)))).drop("_bytes")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read from formatted and spans."""
    back = read_back(chats.select("conv_id", "formatted", "spans"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.withColumn("_told", told).withColumn("_learnt", F.array_join("learnt", ""))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("_told", 256).alias("turns_sha256"), F.char_length("_learnt").cast("long").alias("loss_chars"), F.sha2("_learnt", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
