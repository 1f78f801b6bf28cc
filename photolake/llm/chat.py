"""Chat formatting with Spark expressions only.

Turns are collected in segments: rows of one conversation whose turn numbers share a block of ``SEGMENT``. Each
segment sorts its turn structs, merges adjacent turns of the same role and concatenates them; a run of one role
that goes on in the next segment stays one block, as each piece knows its neighbours' roles. So no task gathers
a conversation of any length; the formatted conversation is its pieces in order.

Template: ``<|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n``; ``<|im_sep|>`` stands between merged turns, so
that they can be told apart again. Inside roles and texts ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``,
so no text can hold a control string and the original can be read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
SEGMENT = 256


def _escape(x: str) -> str:
    return f"replace(replace({x}, '&', '&amp;'), '<|', '&lt;|')"


def _unescape(x: str) -> str:
    return f"replace(replace({x}, '&lt;|', '<|'), '&amp;', '&')"


def _escape_role(x: str) -> str:
    return f"replace({_escape(x)}, chr(10), '&nl;')"


def _unescape_role(x: str) -> str:
    return f"replace(replace(replace({x}, '&lt;|', '<|'), '&nl;', chr(10)), '&amp;', '&')"


_MERGE = (
    "aggregate(turns, CAST(array() AS ARRAY<STRUCT<role: STRING, texts: ARRAY<STRING>>>), (acc, t) -> "
    "CASE WHEN try_element_at(acc, -1).role = t.role THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct("
    "'role', t.role, 'texts', concat(try_element_at(acc, -1).texts, array(t.text))))) "
    "ELSE concat(acc, array(named_struct('role', t.role, 'texts', array(t.text)))) END)")
# A piece as a list of strings, each under the loss mask or not.
_PARTS = (
    "flatten(transform(blocks, (b, i) -> concat("
    f"array(named_struct('s', CASE WHEN i = 0 AND goes_on THEN '{SEP}' ELSE concat('{START}', {_escape_role('b.role')}, "
    "chr(10)) END, 'loss', false)), "
    f"flatten(transform(b.texts, (x, k) -> filter(array(named_struct('s', CASE WHEN k > 0 THEN '{SEP}' END, 'loss', "
    f"false), named_struct('s', {_escape('x')}, 'loss', b.role = 'assistant')), y -> y.s IS NOT NULL))), "
    f"filter(array(named_struct('s', CASE WHEN NOT (i = size(blocks) - 1 AND stays_open) THEN '{END[:-1]}' || chr(10) END, "
    "'loss', false)), y -> y.s IS NOT NULL))))")
_SPANS = (
    "aggregate(parts, named_struct('at', 0, 'spans', CAST(array() AS ARRAY<STRUCT<start: INT, length: INT>>)), "
    "(a, p) -> named_struct('at', a.at + length(p.s), 'spans', CASE WHEN p.loss THEN concat(a.spans, "
    "array(named_struct('start', a.at, 'length', length(p.s)))) ELSE a.spans END)).spans")


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> pieces (conv_id, segment, formatted, loss).

    ``loss`` lists the spans (start, length; code points of ``formatted``) of assistant texts. Rows go by turn, ties
    by role and text, a null turn before all others; repeated rows stay repeated turns. A null role is an empty
    role, a null text an empty text. A row without conv_id is a conversation of its own. Further columns are ignored,
    whatever their names. An empty table gives an empty table. Only the rows of one conversation within one block
    of turn numbers meet in a row.
    """
    rows = conversations.selectExpr(
        "conv_id", f"coalesce(CAST(floor(turn / {SEGMENT}) AS BIGINT), -9223372036854775808) AS segment",
        "named_struct('turn', turn, 'role', coalesce(role, ''), 'text', coalesce(text, '')) AS t")
    keyed = (rows.where("conv_id IS NOT NULL").groupBy("conv_id", "segment")
             .agg(F.sort_array(F.collect_list("t")).alias("turns")))
    order = W.partitionBy("conv_id").orderBy("segment")
    first, last = F.expr("turns[0].role"), F.expr("element_at(turns, -1).role")
    keyed = (keyed.withColumn("goes_on", F.coalesce(F.lag(last).over(order) == first, F.lit(False)))
             .withColumn("stays_open", F.coalesce(F.lead(first).over(order) == last, F.lit(False))))
    single = rows.where("conv_id IS NULL").select(
        "conv_id", "segment", F.array("t").alias("turns"), F.lit(False).alias("goes_on"),
        F.lit(False).alias("stays_open"))
    return (keyed.unionByName(single).withColumn("blocks", F.expr(_MERGE)).withColumn("parts", F.expr(_PARTS))
            .selectExpr("conv_id", "segment", "array_join(transform(parts, p -> p.s), '') AS formatted",
                        f"{_SPANS} AS loss"))


def read_back(pieces: DataFrame) -> DataFrame:
    """Pieces -> one row per conversation: formatted, turns (role, text) and the text under the loss mask, unescaped.

    For checks and digests of whole conversations; only here a conversation must fit in a row.
    """
    parts = pieces.selectExpr(
        "conv_id", "segment", "formatted",
        f"array_join(transform(loss, x -> {_unescape('substring(formatted, x.start + 1, x.length)')}), '') AS loss_text")
    part = F.struct("segment", "formatted", "loss_text")
    keyed = (parts.where("conv_id IS NOT NULL").groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(part)).alias("parts")))
    single = parts.where("conv_id IS NULL").select("conv_id", F.array(part).alias("parts"))
    blocks = f"filter(split(formatted, '<\\\\|im_end\\\\|>\\n', -1), b -> b <> '')"
    body = f"substring(b, locate(chr(10), b) + 1)"
    role = f"substring(b, {len(START) + 1}, locate(chr(10), b) - {len(START) + 1})"
    return (keyed.unionByName(single)
            .selectExpr("conv_id", "array_join(transform(parts, p -> p.formatted), '') AS formatted",
                        "array_join(transform(parts, p -> p.loss_text), '') AS loss_text")
            .withColumn("blocks", F.expr(blocks))
            .withColumn("turns", F.expr(
                f"flatten(transform(blocks, b -> transform(split({body}, '<\\\\|im_sep\\\\|>', -1), "
                f"x -> named_struct('role', {_unescape_role(role)}, 'text', {_unescape('x')}))))"))
            .select("conv_id", "formatted", "turns", "loss_text", F.size("blocks").cast("long").alias("n_blocks")))
