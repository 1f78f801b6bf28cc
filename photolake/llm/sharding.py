"""Shard placement by a permutation-filled lookup table.

Every shard prefers the slots of a table of prime size in its own order, a permutation given by an offset and a
step. Shards take turns; in a turn a shard claims the first slot of its order that is still free. All slots get
filled, shards own equally many (one more or less), and a change of the number of shards moves few slots.
A key is placed by hashing it to a slot: one lookup in a broadcast table of fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A prime; about 128 slots for each of 64 shards.
TABLE_SIZE = 8191
#: The lookup table is broadcast, so its size has a bound: 16 bytes a slot.
MAX_TABLE_SIZE = 65_537
#: Slots looked at in one step; a shard that finds none of them free goes on to the next step, then to all others.
STEPS = tuple(1 << k for k in range(3, 14))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def _digest(text: str) -> str:
    """A 60-bit number from the MD5 of an SQL string expression."""
    return f"CAST(conv(substr(md5({text}), 1, 15), 16, 10) AS BIGINT)"


def lookup_table(spark: SparkSession, n_shards: int, table_size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard), one row per slot, filled by one fold over the turns.

    The slots' owners lie in blocks of about sqrt(table_size), so a claim copies two short arrays instead of the table, and a
    turn looks for a free slot step by step along the shard's order: about table_size * ln(table_size) looks in all.
    """
    if not 1 <= n_shards <= table_size <= MAX_TABLE_SIZE or not _is_prime(table_size):
        raise ValueError(f"need 1 <= n_shards <= table_size <= {MAX_TABLE_SIZE}, table_size prime")
    m = table_size
    block = int(m ** 0.5) + 1
    n_blocks = -(-m // block)
    me = f"CAST(t % {n_shards} AS INT)"

    def look(begin: int, stop: int) -> str:
        """The first free place of the shard's order between ``begin`` and ``stop`` places on, or null. Places count up from the
        offset in steps; a place's slot is its remainder."""
        first, last = f"(s.looked[{me}] + {begin} * steps[{me}])", f"(offs[{me}] + {m - 1} * steps[{me}])"
        places = f"sequence({first}, least(s.looked[{me}] + {stop - 1} * steps[{me}], {last}), steps[{me}])"
        free = f"s.owner[x % {m} DIV {block}][x % {m} % {block}] = -1"
        return f"CASE WHEN {first} <= {last} THEN get(filter({places}, x -> {free}), 0) END"

    def put(array: str, place: str, value: str, size: int) -> str:
        return f"concat(slice({array}, 1, {place}), array({value}), slice({array}, {place} + 2, {size}))"

    at, inside = f"CAST(x % {m} DIV {block} AS INT)", f"CAST(x % {m} % {block} AS INT)"
    claimed = put("a.owner", at, put(f"a.owner[{at}]", inside, me, block), n_blocks)
    bounds = [0, *STEPS, m]
    looks = ", ".join(look(a, b) for a, b in zip(bounds, bounds[1:]) if a < m)
    # The inner aggregate only names the claimed place: a transform would copy the table at each turn.
    fold = (f"aggregate(sequence(0L, {m - 1}L), named_struct('owner', array_repeat(array_repeat(-1, {block}), {n_blocks}), "
            f"'looked', offs), (s, t) -> aggregate(array(coalesce({looks})), s, (a, x) -> "
            f"named_struct('owner', {claimed}, 'looked', {put('a.looked', me, 'x', n_shards)}))).owner")
    return (spark.range(1)
            .selectExpr(f"transform(sequence(id, id + {n_shards - 1}), i -> {_digest('concat(i, chr(58), 0)')} % {m}) AS offs",
                        f"transform(sequence(id, id + {n_shards - 1}), i -> {_digest('concat(i, chr(58), 1)')} % {m - 1} + 1) AS steps")
            .selectExpr(f"posexplode(slice(flatten({fold}), 1, {m})) AS (slot, shard)"))


def place(df: DataFrame, key: Sequence[str], n_shards: int = 64, table_size: int = TABLE_SIZE) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row; one map over ``df``, no shuffle.

    The key columns are hashed as strings, null as one value of its own, so null keys, repeated rows and empty
    texts are placed like any others: equal keys get equal shards. Choose a key with many values (an id): a hot
    key is one shard's by definition. Columns of ``df`` named slot or shard are replaced, all others carried along whatever
    their names are. An empty table gives an empty table; keys of any length are hashed whole.
    """
    parts = ", ".join(f"coalesce(concat('=', CAST(`{c}` AS STRING)), '-')" for c in key)
    digest = _digest(f"concat_ws(chr(31), {parts})")
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.expr(f"CAST({digest} % {table_size} AS INT)").alias("at"))
    table = lookup_table(df.sparkSession, n_shards, table_size)
    return rows.join(F.broadcast(table), F.col("at") == F.col("slot")).select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("slot"), F.col("shard"))
