"""Secret scan with Spark expressions only.

Base rules find assigned values, access keys and long hexadecimal strings. The method adds strings that look drawn
at random: for every long token with letters and digits the encoding is inferred (the smallest alphabet that holds
it) and three tests ask whether it can be uniform over that alphabet: chi-squared of the symbol counts, runs above and
below the middle of the alphabet, lag-one serial correlation. The least p-value, times three, is the token's p-value.

False discoveries are controlled per encoding and length class, as short tokens say less. p-values of random tokens
are about uniform, those of other tokens pile up near 0; twice the number above 0.5 estimates the random ones,
and a class accepts p > t for the least t where the others are estimated at no more than MAX_FALSE of the accepted.
The counts behind it are an aggregate over all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from photolake.llm.base import BROADCAST_ROWS, nested, text_mark, written

ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
MIN_VALUE = 8
# Runs are maximal, so the least lengths can stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")

# Name, pattern and symbols of each encoding, smallest alphabet first.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/"),
)
LENGTH_CLASSES = (24, 32, 48, 96)
BINS = 200
MAX_FALSE = 0.05
#: Classes with fewer tokens accept p above this.
MIN_CLASS, DEFAULT_LIMIT = 20, 0.01
_CHUNK = 512
#: Characters of secrets in a broadcast.
MAX_CHARS = 32 << 20


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _spans(matches: str, pieces: str, kind: int) -> str:
    """Spans of ``matches`` from the lengths of the ``pieces`` between them; folded in chunks, so it stays linear."""
    empty = "CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, end: INT, s: STRING>>)"
    step = (f"named_struct('at', a.at + length({pieces}[i]) + length({matches}[i]), 'spans', array_append(a.spans, "
            f"named_struct('start', a.at + length({pieces}[i]), 'kind', {kind}, "
            f"'end', a.at + length({pieces}[i]) + length({matches}[i]), 's', {matches}[i])))")
    inner = (f"aggregate(sequence(c, least(c + {_CHUNK - 1}, size({matches}) - 1)), "
             f"named_struct('at', o.at, 'spans', {empty}), (a, i) -> {step})")
    outer = (f"aggregate(sequence(0, size({matches}) - 1, {_CHUNK}), named_struct('at', 0, 'spans', "
             f"CAST(array() AS ARRAY<ARRAY<STRUCT<start: INT, kind: INT, end: INT, s: STRING>>>)), (o, c) -> "
             + _let("r", inner, "named_struct('at', r.at, 'spans', array_append(o.spans, r.spans))") + ").spans")
    return f"CASE WHEN size({matches}) = 0 THEN {empty} ELSE flatten({outer}) END"


def _tail(z: str) -> str:
    """Upper tail of the normal distribution, within 0.0002."""
    return f"1.0D / (1.0D + exp(least(1.5976D * ({z}) + 0.07056D * pow({z}, 3), 700.0D)))"


def _tests(x: str, k: str) -> str:
    """p-value of symbol places ``x`` under uniform draws of ``k`` symbols."""
    n = f"CAST(size({x}) AS DOUBLE)"
    squares = (f"aggregate(transform(array_distinct({x}), u -> size(filter({x}, y -> y = u))), 0.0D, "
               "(a, o) -> a + o * o)")
    chi = f"(({k} / {n}) * {squares} - {n} - ({k} - 1)) / sqrt(2.0D * ({k} - 1) * ({n} - 1) / {n})"
    above = f"CAST(size(filter({x}, y -> 2 * y >= {k})) AS DOUBLE)"
    pairs = f"sequence(0, size({x}) - 2)"
    changes = f"size(filter({pairs}, i -> (2 * {x}[i] >= {k}) <> (2 * {x}[i + 1] >= {k})))"
    both = f"(2.0D * {above} * ({n} - {above}))"
    runs = (f"CASE WHEN {both} <= {n} THEN 9.0D ELSE abs({changes} - {both} / {n}) / "
            f"sqrt({both} * ({both} - {n}) / ({n} * {n} * ({n} - 1))) END")
    mean = f"(aggregate({x}, 0.0D, (a, y) -> a + y) / {n})"
    serial = _let("m", mean, _let(
        "v", f"aggregate({x}, 0.0D, (a, y) -> a + (y - m) * (y - m))",
        f"CASE WHEN v = 0 THEN 9.0D ELSE abs(aggregate({pairs}, 0.0D, (a, i) -> a + ({x}[i] - m) * ({x}[i + 1] - m)) "
        f"/ v * sqrt({n})) END"))
    return (f"least(1.0D, 3.0D * least({_let('z', chi, _tail('z'))}, 2.0D * {_let('z', runs, _tail('z'))}, "
            f"2.0D * {_let('z', serial, _tail('z'))}))")


def _scored(span: str) -> str:
    """(start, kind, end, s) -> with the class and p-value of its characters, padding left out."""
    body = f"rtrim('=', {span}.s)"
    code = "CASE " + " ".join(f"WHEN w RLIKE '{p}' THEN {i}" for i, (_, p, _) in enumerate(ENCODINGS) if p) + \
        f" ELSE {len(ENCODINGS) - 1} END"
    symbols = "CASE e " + " ".join(f"WHEN {i} THEN '{s}'" for i, (_, _, s) in enumerate(ENCODINGS)) + " END"
    places = "transform(filter(split(w, ''), c -> c <> ''), c -> instr(g, c) - 1)"
    length = "CASE " + " ".join(f"WHEN length(w) < {x} THEN {i}" for i, x in enumerate(LENGTH_CLASSES)) + \
        f" ELSE {len(LENGTH_CLASSES)} END"
    return _let("w", body, _let("e", code, _let("g", symbols, _let("x", places, (
        f"named_struct('start', {span}.start, 'kind', {span}.kind, 'end', {span}.end, 's', {span}.s, "
        f"'class', e * {len(LENGTH_CLASSES) + 1} + {length}, 'p', {_tests('x', 'length(g)')})")))))


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and scored tokens; one map over the texts."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN)):
        rows = rows.withColumn(f"m_{name}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("values", F.when(F.size("m_assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))))
    rows = rows.withColumns({f"p_{name}": F.when(F.size(f"m_{name}") > 0, F.split("text", pattern, -1))
                             for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN))})
    rows = rows.select(
        "doc_id", "values", *[F.expr(_spans(f"m_{name}", f"p_{name}", kind)).alias(name)
                              for kind, name in enumerate(("assign", "access", "hex", "token"))])
    mixed = "t.s RLIKE '[0-9]' AND t.s RLIKE '[A-Za-z]'"
    return (rows.withColumn("assign", F.expr(f"filter(assign, (t, i) -> length(values[i]) >= {MIN_VALUE})"))
            .withColumn("base", F.expr("array_sort(concat(assign, access, hex))"))
            .withColumn("tokens", F.expr(f"transform(filter(token, t -> {mixed}), t -> {_scored('t')})"))
            .select("doc_id", "base", "tokens"))


def _limits(found: DataFrame) -> DataFrame:
    """One row: a map from class to the p-value above which its tokens are accepted. At most a few dozen entries."""
    bins = (found.select(F.explode("tokens").alias("t"))
            .groupBy(F.col("t.class").alias("class"), F.expr(f"least(CAST(floor(t.p * {BINS}) AS INT), {BINS - 1})").alias("bin"))
            .agg(F.count("*").alias("n")))
    group = W.partitionBy("class")
    upward = group.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    at = (bins.withColumn("above", F.sum("n").over(upward)).withColumn("total", F.sum("n").over(group))
          .withColumn("random", F.sum(F.expr(f"CASE WHEN bin >= {BINS // 2} THEN 2.0D * n ELSE 0 END")).over(group))
          .withColumn("least_p", F.expr(f"bin / {float(BINS)}D"))
          .withColumn("false_share", F.expr("greatest(above - random * (1 - least_p), 0) / above")))
    limit = at.groupBy("class").agg(F.expr(
        f"CASE WHEN max(total) < {MIN_CLASS} THEN {DEFAULT_LIMIT}D ELSE "
        f"coalesce(min(CASE WHEN false_share <= {MAX_FALSE} THEN least_p END), 1.0D) END").alias("t"))
    return limit.agg(F.map_from_entries(F.collect_list(F.struct("class", "t"))).alias("limits"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> one row per row of ``docs``: doc_id, base and all, arrays of spans (start, kind, end, s).

    Offsets are code points, ends exclusive; ``kind`` is a place in KINDS. Spans are ordered by start, kind and end.
    Accepted random tokens that meet a base span are not repeated. Null and empty texts have no spans; repeated rows
    are scanned one by one; other columns are ignored; an empty table gives an empty table.
    """
    found = written(_found(docs))
    accepted = ("filter(tokens, t -> t.p > coalesce(limits[t.class], 1.0D) AND "
                "NOT exists(base, b -> b.start < t.end AND t.start < b.end))")
    return found.crossJoin(F.broadcast(_limits(found))).selectExpr(  # one row
        "doc_id", "base",
        f"array_sort(concat(base, transform({accepted}, t -> named_struct('start', t.start, 'kind', t.kind, "
        "'end', t.end, 's', t.s)))) AS all")


def joined(spans: str) -> str:
    """SQL: kind:start:end of each span, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every found secret replaced by ``mark`` and n_chars, if there, counted again; all rows stay."""
    own = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), text_mark().alias("mark")).alias("doc_id"), "text")
    found = written(scan(own).where("size(all) > 0").dropDuplicates(["doc_id"]).selectExpr(
        "doc_id.id AS found_id", "doc_id.mark AS found_mark", "array_distinct(transform(all, x -> x.s)) AS secrets"))
    n, chars = found.agg(F.count("*"), F.sum(F.expr("aggregate(secrets, 0L, (a, x) -> a + length(x))"))).first()
    if n <= BROADCAST_ROWS and (chars or 0) <= MAX_CHARS:
        found = F.broadcast(found)
    # Longer ones first, so that none is left in part.
    ordered = ("array_sort(secrets, (a, b) -> CASE WHEN length(a) <> length(b) THEN length(b) - length(a) "
               "WHEN a < b THEN -1 WHEN a = b THEN 0 ELSE 1 END)")
    text = f"CASE WHEN secrets IS NULL THEN row.text ELSE aggregate({ordered}, row.text, (t, s) -> replace(t, s, '{mark}')) END"
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark"))
    joined = nested(docs).join(found, same, "left").withColumn("new_text", F.expr(text))
    columns = []
    for c in docs.columns:
        column = F.col(f"row.`{c}`")
        if c == "text":
            column = F.col("new_text")
        elif c == "n_chars":
            column = F.when(F.col("secrets").isNull(), column).otherwise(F.length("new_text").cast(docs.schema[c].dataType))
        columns.append(column.alias(c))
    return joined.select(*columns)
