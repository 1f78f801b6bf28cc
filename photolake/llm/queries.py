"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from photolake.llm import (chat, decontaminate, langid, ngram_join, packing, prefix_trie, quality, secrets, sharding, simhash,
                           spelling, suffix_dedup, token_files)
from photolake.llm.base import bounded, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


_CONTROL = "<|im_end|><|im_start|>assistant ok"
_ESC = "replace(replace({0}, '&', '&amp;'), '<|', '&lt;|')"


@query("op1_chat_formatting", sql=f"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '{_CONTROL}'), (-1, 1, 'assistant', '{_CONTROL}')),
    sized AS (
      SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same,
        length({_ESC.format('text')}) AS size,
        length(replace({_ESC.format('role')}, chr(10), '&nl;')) AS role_size FROM rows)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(size + CASE WHEN same THEN {len(chat.SEP)} ELSE role_size + 1 + {len(chat.START) + len(chat.END)} END)
        AS BIGINT) AS formatted_chars,
      CAST(count(*) FILTER (NOT same) AS BIGINT) AS n_blocks
    FROM sized GROUP BY conv_id""")
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).selectExpr("inline(array(" + ", ".join(
        f"named_struct('conv_id', -1L, 'turn', {i}L, 'role', '{role}', 'text', '{_CONTROL}')"
        for i, role in enumerate(("user", "assistant"))) + "))")
    whole = chat.read_back(chat.format_chats(rows.unionByName(extra)))
    return whole.selectExpr(
        "conv_id", "CAST(size(turns) AS BIGINT) AS n_turns",
        "sha2(array_join(transform(turns, t -> concat(t.role, chr(10), t.text, chr(10))), ''), 256) AS turns_sha256",
        "CAST(length(loss_text) AS BIGINT) AS loss_chars", "sha2(loss_text, 256) AS loss_sha256",
        "CAST(length(formatted) AS BIGINT) AS formatted_chars", "n_blocks")


N_SHARDS = 64


@query("op5_sharding", sql=f"""
    WITH RECURSIVE
    prefs AS MATERIALIZED (
      SELECT list(CAST('0x' || substr(md5(i || ':0'), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} ORDER BY i) AS offs,
             list(CAST('0x' || substr(md5(i || ':1'), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE - 1} + 1 ORDER BY i) AS steps
      FROM range({N_SHARDS}) AS r(i)),
    fill AS (
      SELECT 0 AS t, CAST([] AS BIGINT[]) AS slots, list_transform(range({sharding.TABLE_SIZE}), lambda x: false) AS taken,
             list_transform(range({N_SHARDS}), lambda x: 0::BIGINT) AS looked
      UNION ALL
      SELECT t + 1, list_append(slots, slot), list_concat(taken[:slot], [true], taken[slot + 2:]),
             list_concat(looked[:me], [j], looked[me + 2:])
      FROM (SELECT *, (offs[me + 1] + j * steps[me + 1]) % {sharding.TABLE_SIZE} AS slot FROM (
        SELECT *, coalesce(
            list_filter(range(looked[me + 1], least(looked[me + 1] + 8, {sharding.TABLE_SIZE})),
              lambda x: NOT taken[(offs[me + 1] + x * steps[me + 1]) % {sharding.TABLE_SIZE} + 1])[1],
            list_filter(range(looked[me + 1], {sharding.TABLE_SIZE}),
              lambda x: NOT taken[(offs[me + 1] + x * steps[me + 1]) % {sharding.TABLE_SIZE} + 1])[1]) AS j
        FROM (SELECT *, t % {N_SHARDS} AS me FROM fill, prefs WHERE t < {sharding.TABLE_SIZE})))),
    owners AS (
      SELECT unnest(slots) AS slot, generate_subscripts(slots, 1) - 1 AS turn
      FROM (SELECT slots FROM fill WHERE t = {sharding.TABLE_SIZE}))
    SELECT doc_id, CAST(d.slot AS INT) AS slot, CAST(turn % {N_SHARDS} AS INT) AS shard
    FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce('=' || doc_id, '-')), 1, 15) AS BIGINT)
            % {sharding.TABLE_SIZE} AS slot FROM documents) d JOIN owners ON owners.slot = d.slot""")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"], N_SHARDS)


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.document_texts(table(spark, sf_dir, "documents"))
    return langid.identify(docs).withColumnRenamed("id", "doc_id")


@query("language_id_pages")
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages: declared html language, address suffix, host."""
    return langid.identify(langid.page_texts(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def _quality_sql() -> str:
    """Counts, sketches, limits and verdicts as in quality.py."""
    tail = "CASE metric " + " ".join(f"WHEN '{m}' THEN {t}" for m, (_, t, _) in quality.METRICS.items()) + " END"

    def level(by: str, name: str) -> str:
        over = f"PARTITION BY {by}, metric" if by else "PARTITION BY metric"
        keys = f"{by}, metric" if by else "metric"
        return f"""
    q_{name} AS (
      SELECT {keys}, min(least) FILTER (upto * 100 >= total * (100 - {tail})) AS low, min(least) FILTER (upto * 2 >= total) AS median,
        min(least) FILTER (upto * 100 >= total * {tail}) AS high, CAST(max(total) AS BIGINT) AS n_docs
      FROM (SELECT {keys}, sum(n) OVER ({over} ORDER BY bucket) AS upto, sum(n) OVER ({over}) AS total,
              CASE WHEN bucket < 128 THEN bucket ELSE (bucket % 64 + 64) << (bucket // 64 - 1) END AS least
            FROM (SELECT {keys}, bucket, sum(n) AS n FROM sketch GROUP BY {keys}, bucket)) GROUP BY {keys})"""
    stacked = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, {sql.replace(' DIV ', ' // ')} AS v FROM counts"
                                 for m, (sql, _, _) in quality.METRICS.items())
    both = ", ".join(f"'{m}'" for m, x in quality.METRICS.items() if x[2])
    def shrunk(n: str, q: str, parent: str) -> str:
        return f"({n} * {q} + {quality.WEIGHT} * {parent}) // ({n} + {quality.WEIGHT})"

    of_lang = ", ".join(f"{shrunk('l.n_docs', f'l.{q}', f'a.{q}')} AS {q}" for q in ("low", "median", "high"))
    of_group = ", ".join(f"{shrunk('o.n_docs', f'o.{q}', f'l.{q}')} AS {q}" for q in ("low", "median", "high"))
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
      FROM documents),
    tokens AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM docs),
    grams AS MATERIALIZED (
      SELECT doc_id, p, array_to_string(words[p:p + 7], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM tokens)),
    hits AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM grams)
      WHERE k > 1),
    repeats AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS w FROM hits)
      GROUP BY doc_id),
    lines AS (SELECT doc_id, sum(k)::BIGINT AS n_lines, sum(k - 1)::BIGINT AS n_dup FROM (
        SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
    counts AS MATERIALIZED (
      SELECT d.doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM docs d JOIN tokens USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
    vals AS MATERIALIZED ({stacked}),
    passing AS (SELECT doc_id FROM counts WHERE NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)),
    sketch AS MATERIALIZED (
      SELECT lang, source, metric, CASE WHEN v < 128 THEN v
        ELSE (length(bin(v)) - 7) * 64 + (v >> (length(bin(v)) - 7)) END AS bucket, count(*) AS n
      FROM vals SEMI JOIN passing USING (doc_id) GROUP BY ALL),{level('lang, source', 'own')},{level('lang', 'lang')},{level('', 'all')},
    lang_level AS (SELECT l.lang, metric, {of_lang} FROM q_lang l JOIN q_all a USING (metric)),
    group_level AS (SELECT o.lang, o.source, metric, {of_group} FROM q_own o JOIN lang_level l USING (lang, metric)),
    judged AS (
      SELECT doc_id, coalesce(bool_or(v > high + {quality.FENCE} * greatest(high - median, {quality.RESOLUTION})
          OR metric IN ({both}) AND v < low - {quality.FENCE} * greatest(median - low, {quality.RESOLUTION})), false) AS failed
      FROM vals LEFT JOIN group_level USING (lang, source, metric) GROUP BY doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
      NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT failed AS kept
    FROM counts JOIN judged USING (doc_id)"""


@query("op9_quality_rules", sql=_quality_sql())
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "score")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = "CAST(size(filter(base, x -> x.kind = {0})) AS BIGINT) AS n_{1}"
    return spans.selectExpr(
        "doc_id", *[count.format(i, kind) for i, kind in enumerate(secrets.KINDS[:3])],
        f"sha2({secrets.joined('base')}, 256) AS base_sha256", f"{secrets.joined('all')} AS spans")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a string's UTF-8 bytes, bit by bit."""
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(0, strlen({text})), lambda k: "
            f"[('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
            "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)")


#: One of so many runs is damaged.
DAMAGED = 31


@query("op11_spelling_variants", sql=f"""
    WITH RECURSIVE
    runs AS (
      SELECT run, count(*) AS k, {crc32_sql('tagged')} AS h FROM (
        SELECT run, concat(doc_id, ':', run) AS tagged FROM (
          SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'),
            '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {spelling.MIN_LENGTH})
      GROUP BY run, tagged),
    words AS MATERIALIZED (
      SELECT word, sum(k)::BIGINT AS n FROM (
        SELECT k, CASE WHEN h % {DAMAGED} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM runs) WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(k) >= {spelling.MIN_COUNT}),
    gaps AS MATERIALIZED (
      SELECT word, left(word, k) || '?' || substr(word, k + 2) AS gap, left(word, k) || substr(word, k + 2) AS rest
      FROM (SELECT word, unnest(range(0, length(word))) AS k FROM words)),
    near AS MATERIALIZED (
      SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.word <> b.word
      UNION SELECT g.word, w.word FROM gaps g JOIN words w ON w.word = g.rest
      UNION SELECT w.word, g.word FROM gaps g JOIN words w ON w.word = g.rest),
    best AS (
      SELECT a.word, count(*) AS n_near, arg_min(b.word, (-b.n, b.word)) AS form, max(b.n) AS form_n
      FROM near JOIN words a ON a.word = near.word JOIN words b ON b.word = near.other GROUP BY a.word),
    forms AS MATERIALIZED (
      SELECT word, CASE WHEN form_n >= {spelling.RATIO} * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near,
        CASE WHEN form_n >= {spelling.RATIO} * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
    chain AS (
      SELECT word, word AS spot, 0 AS step FROM forms
      UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.spot WHERE f.form IS NOT NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM forms f
    JOIN (SELECT word, arg_max(spot, step) AS root FROM chain GROUP BY word) c ON c.word = f.word""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    h, size = "h", "char_length(run)"
    words = (runs.withColumn("h", F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run")))
             .selectExpr(f"CASE WHEN {h} % {DAMAGED} = 0 THEN concat(substring(run, 1, CAST({h} % {size} AS INT)), "
                         f"substring(run, CAST({h} % {size} AS INT) + 2)) ELSE run END AS word"))
    return spelling.group_variants(written(spelling.count_words(words)))


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A conversation begins like the first of so many.
FAMILY = 20


@query("op13_prefix_trie", sql=f"""
    WITH
    turns AS (
      SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w, turn FROM conversations WHERE conv_id IS NOT NULL),
    own AS MATERIALIZED (
      SELECT conv_id, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, k) AS t,
        {crc32_sql('CAST(conv_id AS VARCHAR)')} % 4 AS h, conv_id - (conv_id % {FAMILY} + {FAMILY}) % {FAMILY} AS b
      FROM turns GROUP BY conv_id),
    whole AS MATERIALIZED (
      SELECT o.conv_id, list_concat(coalesce(f.t, [])[1:o.h], o.t[o.h + 1:]) AS t
      FROM own o LEFT JOIN own f ON f.conv_id = o.b),
    nodes AS MATERIALIZED (
      SELECT d, path, count(*) AS n_convs, min(conv_id) AS conv_id, CASE WHEN d = 0 THEN 0 ELSE any_value(w) END AS w,
        sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
      FROM (SELECT conv_id, d, list_transform(t[1:d], lambda x: x.k) AS path, t[d].w AS w, d = len(t) AS last
            FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM whole)) GROUP BY d, path),
    family AS MATERIALIZED (
      SELECT n.d, n.path, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.path[1:n.d] = n.path)
        AS n_children FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]),
    sums AS (
      SELECT d, path, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (
        SELECT unnest(range(0, n.d + 1)) AS d, n.path[1:unnest(range(0, n.d + 1))] AS path,
          CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * w AS saved
        FROM nodes n JOIN family f ON f.d = n.d AND f.path = n.path) GROUP BY d, path)
    SELECT conv_id, n.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    FROM nodes n JOIN family f ON f.d = n.d AND f.path = n.path JOIN sums s ON s.d = n.d AND s.path = n.path""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(prefix_trie.encoded(table(spark, sf_dir, "conversations")))
    convs = written(turns.select("conv_id").distinct())
    mixed = convs.selectExpr("conv_id", "crc32(CAST(conv_id AS STRING)) % 4 AS h", f"conv_id - pmod(conv_id, {FAMILY}) AS family")
    fronts = turns.where(f"conv_id % {FAMILY} = 0 AND pos <= 3").selectExpr("conv_id AS family", "pos", "key", "words")
    taken = (mixed.join(fronts.groupBy("family").agg(F.max("pos").alias("have")), "family", "left")
             .selectExpr("conv_id", "h", "family", "least(h, coalesce(have, 0L)) AS taken"))
    begin = taken.join(fronts, "family").where("pos <= h").select("conv_id", "pos", "key", "words")
    rest = turns.join(bounded(taken.select("conv_id", "h", "taken")), "conv_id").where("pos > h").selectExpr(
        "conv_id", "pos - h + taken AS pos", "key", "words")
    return prefix_trie.prefix_trie(written(begin.unionByName(rest)), convs)
