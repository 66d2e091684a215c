"""Chat formatting with a grammar round trip, in Spark expressions only.

Grammar of a rendered conversation::

    conversation := turn*
    turn         := "<s>[INST]" role "[/INST]" text "</s>"

A turn whose role begins with a backslash is an escaped one. Rounds: every turn is
first rendered as it is; the turns that the parser does not give back unchanged are
escaped; if the whole conversation still differs, all of its turns are escaped, which
the grammar always reads back.

Defined results: null role or text counts as empty; rows that repeat a turn number are
all kept, ordered by turn, role and text (null turn first); a table without rows gives
no conversations. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD_END, TURN_END = "<s>[INST]", "[/INST]", "</s>"
#: Fixed escapes, the escape character itself first.
ESCAPES = [("\\", "\\e"), ("<s>", "\\s"), ("</s>", "\\z"), ("[INST]", "\\i"), ("[/INST]", "\\j")]
#: Rows of one conversation that are put together at once.
CHUNK = 64


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def render(role: Column, text: Column, escaped: Column) -> Column:
    plain = F.concat(F.lit(OPEN), role, F.lit(HEAD_END), text, F.lit(TURN_END))
    safe = F.concat(F.lit(OPEN + "\\"), escape(role), F.lit(HEAD_END), escape(text), F.lit(TURN_END))
    return F.when(escaped, safe).otherwise(plain)


def parse(formatted: Column) -> Column:
    """array<struct<role, text, raw>>: the turns that the grammar reads; raw is the text as rendered.

    A piece that does not begin as a turn does, or has no end of head, is read as a turn
    without role (null), so it never equals a source turn.
    """
    pieces = F.split(formatted, TURN_END)
    pieces = F.when(F.size(pieces) > 1, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<string>"))

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(OPEN) + 1))
        end = F.instr(body, F.lit(HEAD_END))
        ok = F.startswith(piece, F.lit(OPEN)) & (end > 0)
        head = F.substr(body, F.lit(1), end - 1)
        raw = F.substr(body, end + len(HEAD_END))
        marked = F.startswith(head, F.lit("\\"))
        role = F.when(ok, F.when(marked, unescape(F.substr(head, F.lit(2)))).otherwise(head))
        text = F.when(ok, F.when(marked, unescape(raw)).otherwise(raw))
        return F.struct(role.alias("role"), text.alias("text"), raw.alias("raw"))

    return F.transform(pieces, turn)


def _source(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _bare(turns: Column) -> Column:
    return F.transform(turns, lambda t: _source(t["role"], t["text"]))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, formatted, source (array of role, text), identical.

    Rows of a conversation are first joined in chunks of CHUNK turns, so that no task gets
    the rows of a long conversation one by one.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = parse(render(F.col("role"), F.col("text"), F.lit(False)))
    conflict = ~((F.size(alone) == 1) & _bare(alone)[0].eqNullSafe(_source(F.col("role"), F.col("text"))))
    rows = rows.withColumn("escaped", conflict).withColumn("part", F.floor(F.col("turn") / CHUNK))
    part = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "escaped"))).alias("turns"))
    chats = part.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "turns"))), lambda p: p["turns"])).alias("turns"))
    source = F.transform("turns", lambda t: _source(t["role"], t["text"]))
    joined = lambda f: F.array_join(F.transform("turns", f), "")
    chats = chats.select("conv_id", "turns", source.alias("source"), joined(lambda t: render(t["role"], t["text"], t["escaped"])).alias("once"))
    same = _bare(parse(F.col("once"))) == F.col("source")
    chats = chats.withColumn("formatted", F.when(same, F.col("once")).otherwise(joined(lambda t: render(t["role"], t["text"], F.lit(True)))))
    return chats.select("conv_id", "formatted", "source")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns as the parser reads them, identical: whether they are the source's."""
    out = chats.withColumn("turns", parse(F.col("formatted")))
    return out.withColumn("identical", _bare(F.col("turns")) == F.col("source"))


def loss_mask(formatted: Column, role: str = "assistant") -> Column:
    """array<struct<text, loss, escaped>>: the pieces of formatted, in order and without gaps; loss: whether a loss is taken on it."""
    none = F.array().cast("array<struct<text:string,loss:boolean,escaped:boolean>>")
    turns = F.split(formatted, TURN_END)
    turns = F.when(F.size(turns) > 1, F.slice(turns, F.lit(1), F.size(turns) - 1)).otherwise(F.array().cast("array<string>"))

    def pieces(turn: Column) -> Column:
        at = F.instr(turn, F.lit(HEAD_END)) + len(HEAD_END)
        marked = F.startswith(turn, F.lit(OPEN + "\\"))
        name = F.substr(turn, F.lit(len(OPEN) + 1), at - len(HEAD_END) - len(OPEN) - 1)
        taken = F.when(marked, unescape(F.substr(name, F.lit(2)))).otherwise(name) == role
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"), marked.alias("escaped"))
        return F.array(piece(F.substr(turn, F.lit(1), at - 1), F.lit(False)), piece(F.substr(turn, at), taken), piece(F.lit(TURN_END), F.lit(False)))

    return F.coalesce(F.flatten(F.transform(turns, pieces)), none)


def loss_text(mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(F.filter(mask, lambda p: p["loss"]), lambda p: F.when(p["escaped"], unescape(p["text"])).otherwise(p["text"])), "")


#: Pieces whose lengths are added up together.
BLOCK = 256


def loss_spans(chats: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, spans: array of (begin, end) of the pieces under the mask in formatted, in code points from 0.

    Lengths are added up in blocks, so the work of a conversation grows with its turns and not with their square."""
    sized = chats.select("conv_id", loss_mask(F.col("formatted"), role).alias("mask")).withColumn("n", F.transform("mask", lambda p: F.length(p["text"]).cast("long")))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    blocks = F.sequence(F.lit(0), F.floor(F.size("n") / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: total(F.slice("n", b * BLOCK + 1, F.lit(BLOCK))))
    sized = sized.withColumn("blocks", F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))

    def place(p: Column, i: Column) -> Column:
        b = F.floor(i / BLOCK).cast("int")
        begin = F.element_at("blocks", b + 1) + total(F.slice("n", b * BLOCK + 1, i % BLOCK))
        return F.struct(p["loss"].alias("loss"), begin.cast("int").alias("begin"), (begin + F.length(p["text"])).cast("int").alias("end"))

    found = F.filter(F.transform("mask", place), lambda p: p["loss"])
    return sized.select("conv_id", F.transform(found, lambda p: F.struct(p["begin"].alias("begin"), p["end"].alias("end"))).alias("spans"))
