"""Encodings of column chunks and their inverses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalegrid.functions.bits import bit_width, plain_bytes, uleb_length, zigzag
from shalegrid.operators import encodings as E
from shalegrid.operators import payloads as P
from shalegrid.plans.base import CHUNK, declaring, table

QUERIES, ORACLES, query = declaring()
_RG = f"event_id // {CHUNK} AS rg, event_id AS pos"


def _events(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    return E.chunked(table(spark, sf_dir, "events"), "event_id", F.expr(value) if isinstance(value, str) else value, CHUNK)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.chunked(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_name"), CHUNK)


@query(f"SELECT o_orderkey // {CHUNK} AS rg, CAST(8 * count(o_custkey) AS BIGINT) AS keys, CAST(8 * count(o_totalprice) AS BIGINT) AS prices, CAST(sum(4 + strlen(o_orderpriority)) AS BIGINT) AS priorities, CAST(sum(4 + strlen(o_orderstatus)) AS BIGINT) AS statuses FROM orders GROUP BY 1")
def enc_plain_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    names = {"o_custkey": "keys", "o_totalprice": "prices", "o_orderpriority": "priorities", "o_orderstatus": "statuses"}
    return orders.groupBy(F.expr(f"o_orderkey div {CHUNK}").alias("rg")).agg(*(F.sum(plain_bytes(F.col(c), orders.schema[c].dataType.simpleString())).alias(n) for c, n in names.items()))


@query(f"SELECT event_id // {CHUNK} AS rg, (event_id % {CHUNK}) // 8 AS byte, CAST(sum(CASE WHEN value > 50 THEN 1 << CAST((event_id % {CHUNK}) % 8 AS INTEGER) ELSE 0 END) AS BIGINT) AS packed, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def enc_bool_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.boolean_bytes(_events(spark, sf_dir, "value > 50"))


@query(f"SELECT event_id // {CHUNK} AS rg, event_id % {CHUNK} AS i, value > 50 AS value FROM events")
def dec_bool_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.booleans(E.boolean_bytes(_events(spark, sf_dir, "value > 50")))


_DICT = f"SELECT rg, CAST(row_number() OVER (PARTITION BY rg ORDER BY first) - 1 AS BIGINT) AS index, value FROM (SELECT event_id // {CHUNK} AS rg, event_type AS value, min(event_id) AS first FROM events GROUP BY 1, 2)"


@query(_DICT)
def enc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dictionary(_events(spark, sf_dir, "event_type"))


@query(f"SELECT event_id // {CHUNK} AS rg, event_id AS pos, index FROM events JOIN ({_DICT}) d ON event_id // {CHUNK} = d.rg AND event_type = d.value")
def enc_dictionary_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _events(spark, sf_dir, "event_type")
    return E.dictionary_indices(df, E.dictionary(df))


@query(f"SELECT {_RG}, event_type AS value FROM events")
def dec_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _events(spark, sf_dir, "event_type")
    entries = E.dictionary(df)
    return E.dictionary_values(E.dictionary_indices(df, entries), entries)


_WIDTH = "CASE WHEN n = 1 THEN 0 ELSE length(bin(n - 1)) END"


@query(f"SELECT rg, n AS entries, CAST({_WIDTH} AS BIGINT) AS width FROM (SELECT event_id // {CHUNK} AS rg, CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events GROUP BY 1)")
def enc_dict_bitwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dictionary_sizes(_events(spark, sf_dir, "cast(user_id as string)")).select("rg", "entries", "width")


_ISLANDS = """SELECT rg, min(pos) AS start, CAST(count(*) AS BIGINT) AS n, value FROM (SELECT *, row_number() OVER (PARTITION BY rg ORDER BY pos) - row_number() OVER (PARTITION BY rg, value ORDER BY pos) AS k
FROM (SELECT {rg}, {value} AS value FROM events)) GROUP BY rg, value, k"""
_LONG = "CASE WHEN event_id % 100 < 40 THEN CAST(1 AS BIGINT) WHEN event_id % 100 < 43 THEN 0 WHEN event_id % 100 < 60 THEN 2 ELSE event_id % 3 END"


@query(_ISLANDS.format(rg=_RG, value="event_type"))
def enc_rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.runs(_events(spark, sf_dir, "event_type"))


@query(f"""SELECT rg, min(start) AS start, CAST(sum(n) AS BIGINT) AS n, rle, CASE WHEN rle THEN min(value) END AS value FROM (SELECT *, n >= 8 AS rle, sum(CASE WHEN n >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY rg ORDER BY start) AS a
FROM ({_ISLANDS.format(rg=_RG, value=_LONG)})) GROUP BY rg, a, rle""")
def enc_rle_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hybrid(_events(spark, sf_dir, _LONG))


@query(f"SELECT {_RG}, {_LONG} AS value FROM events")
def dec_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.unrun(E.runs(_events(spark, sf_dir, _LONG)))


@query("SELECT l_linenumber AS x, CAST(CASE WHEN l_linenumber = 0 THEN 0 ELSE length(bin(l_linenumber)) END AS BIGINT) AS width, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def enc_bit_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("x")).agg(F.count("*").alias("n")).select("x", bit_width(F.col("x")).alias("width"), "n")


_DELTAS = f"SELECT {_RG}, event_id % {CHUNK} AS i, user_id, user_id - lag(user_id) OVER (PARTITION BY event_id // {CHUNK} ORDER BY event_id) AS delta FROM events"


@query(f"SELECT rg, pos, i, CASE WHEN i = 0 THEN user_id END AS first, delta FROM ({_DELTAS})")
def enc_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.deltas(_events(spark, sf_dir, "user_id"))


@query(f"""WITH d AS (SELECT rg, (i - 1) // 128 AS block, ((i - 1) % 128) // 32 AS miniblock, delta FROM ({_DELTAS}) WHERE i > 0),
b AS (SELECT rg, block, CASE WHEN count(*) < 128 THEN least(min(delta), 0) ELSE min(delta) END AS least FROM d GROUP BY 1, 2),
m AS (SELECT rg, block, miniblock, CASE WHEN count(*) < 32 THEN greatest(max(delta), 0) ELSE max(delta) END AS most FROM d GROUP BY 1, 2, 3)
SELECT rg, block, miniblock, least, CAST(CASE WHEN most = least THEN 0 ELSE length(bin(most - least)) END AS BIGINT) AS width FROM m JOIN b USING (rg, block)""")
def enc_delta_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.delta_blocks(_events(spark, sf_dir, "user_id"))


@query(f"SELECT {_RG}, user_id AS value FROM events")
def dec_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.undelta(E.deltas(_events(spark, sf_dir, "user_id")))


_ZIGZAG = "CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END"


@query(f"SELECT rg, pos, CAST({_ZIGZAG} AS BIGINT) AS z FROM ({_DELTAS}) WHERE i > 0")
def enc_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.deltas(_events(spark, sf_dir, "user_id")).where("i > 0").select("rg", "pos", zigzag(F.col("delta")).alias("z"))


@query(f"SELECT rg, CAST(sum(CASE WHEN z = 0 THEN 1 ELSE (length(bin(z)) + 6) // 7 END) AS BIGINT) AS bytes FROM (SELECT rg, CAST({_ZIGZAG} AS BIGINT) AS z FROM ({_DELTAS}) WHERE i > 0) GROUP BY 1")
def enc_uleb_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.deltas(_events(spark, sf_dir, "user_id")).where("i > 0").groupBy("rg").agg(F.sum(uleb_length(zigzag(F.col("delta")))).alias("bytes"))


_NAMES = f"c_custkey // {CHUNK} AS rg, c_custkey AS pos"


@query(f"SELECT {_NAMES}, CAST(strlen(c_name) AS BIGINT) AS length, CAST(coalesce(sum(strlen(c_name)) OVER (PARTITION BY c_custkey // {CHUNK} ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM customer")
def enc_delta_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.lengths(_names(spark, sf_dir))


@query(f"SELECT {_NAMES}, c_name AS value FROM customer")
def dec_delta_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _names(spark, sf_dir)
    return E.unjoined(E.lengths(df), E.joined(df))


@query(f"""SELECT rg, pos, prefix, upper(hex(encode(substr(c, CAST(prefix AS INTEGER) + 1)))) AS suffix FROM (SELECT *, CAST(CASE WHEN q IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(c), length(q)) + 1), lambda i: c[1:i] = q[1:i])) END AS BIGINT) AS prefix
FROM (SELECT {_NAMES}, c_name AS c, lag(c_name) OVER (PARTITION BY c_custkey // {CHUNK} ORDER BY c_custkey) AS q FROM customer))""")
def enc_delta_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.prefixes(_names(spark, sf_dir))


@query(f"SELECT {_NAMES}, c_name AS value FROM customer")
def dec_delta_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.unprefixed(E.prefixes(_names(spark, sf_dir)))


def _uleb(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 1 ELSE (length(bin({x})) + 6) // 7 END)"


def _hybrid_bytes(values: str) -> str:
    """SQL for (rg, w, n, bytes) of the hybrid payload of (rg, pos, value, w): a walk over the runs of each chunk."""
    flush = "(CASE WHEN {p} = 0 THEN 0 ELSE " + _uleb("((({p}) + 7) // 8 * 2 + 1)") + " + (({p}) + 7) // 8 * r.w END)"
    fill = "(8 - pending % 8) % 8"
    return f"""WITH RECURSIVE v AS ({values}), islands AS (SELECT *, row_number() OVER (PARTITION BY rg ORDER BY pos) - row_number() OVER (PARTITION BY rg, value ORDER BY pos) AS island FROM v),
r AS (SELECT rg, w, CAST(count(*) AS BIGINT) AS n, row_number() OVER (PARTITION BY rg ORDER BY min(pos)) AS k FROM islands GROUP BY rg, w, value, island),
walk AS (SELECT rg, w, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pending, CAST(0 AS BIGINT) AS bytes FROM r WHERE k = 1
UNION ALL SELECT r.rg, r.w, r.k, CASE WHEN n >= 8 AND n - {fill} >= 8 THEN 0 ELSE pending + n END,
CASE WHEN n >= 8 AND n - {fill} >= 8 THEN bytes + {flush.format(p=f"(pending + {fill})")} + {_uleb(f"((n - {fill}) * 2)")} + (r.w + 7) // 8 ELSE bytes END
FROM walk JOIN r ON r.rg = walk.rg AND r.k = walk.k + 1)
SELECT rg, w, CAST(sum(n) AS BIGINT) AS n, CAST(max(bytes) AS BIGINT) AS bytes FROM (SELECT walk.rg, walk.w, r.n, CASE WHEN walk.k = (SELECT max(k) FROM r r2 WHERE r2.rg = walk.rg) THEN bytes + {flush.format(p="pending")} ELSE 0 END AS bytes FROM walk JOIN r ON r.rg = walk.rg AND r.k = walk.k) GROUP BY rg, w"""


_INDICES = f"SELECT event_id // {CHUNK} AS rg, event_id AS pos, index AS value, (SELECT CASE WHEN max(index) = 0 THEN 0 ELSE length(bin(max(index))) END FROM ({_DICT}) d2 WHERE d2.rg = event_id // {CHUNK}) AS w FROM events JOIN ({_DICT}) d ON event_id // {CHUNK} = d.rg AND event_type = d.value"


@query(f"SELECT rg, dict_bytes, CAST(1 + bytes AS BIGINT) AS index_bytes FROM ({_hybrid_bytes(_INDICES)}) JOIN (SELECT rg, CAST(sum(4 + strlen(value)) AS BIGINT) AS dict_bytes FROM ({_DICT}) GROUP BY 1) USING (rg)")
def enc_dict_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the dictionary and of the index payload that is made: a byte for the width, then the hybrid."""
    df = _events(spark, sf_dir, "event_type")
    indices = E.dictionary_indices(df, E.dictionary(df)).withColumnRenamed("index", "value")
    made = P.encoded(indices, "hybrid").select("rg", F.octet_length("payload").cast("long").alias("index_bytes"))
    return E.dictionary_sizes(df).join(made, "rg").select("rg", "dict_bytes", "index_bytes")


@query(f"SELECT rg, n, CAST(1 + bytes AS BIGINT) AS bytes FROM ({_hybrid_bytes(f'SELECT {_RG}, {_LONG} AS value, 2 AS w FROM events')})")
def enc_rle_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.encoded(_events(spark, sf_dir, _LONG), "hybrid").select("rg", "n", F.octet_length("payload").cast("long").alias("bytes"))


def _back(spark: SparkSession, sf_dir: str, value: str, kind: str) -> DataFrame:
    return P.decoded(P.encoded(_events(spark, sf_dir, value), kind), kind)


_AT = f"event_id // {CHUNK} AS rg, event_id % {CHUNK} AS i"


@query(f"SELECT {_AT}, {_LONG} AS value FROM events")
def dec_rle_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, _LONG, "hybrid")


@query(f"SELECT {_AT}, CAST(CASE WHEN event_id % 100 < 40 THEN 1 ELSE event_id % 4 END AS BIGINT) AS value FROM events")
def dec_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels behind their length, as in pages of version 1."""
    return _back(spark, sf_dir, "case when event_id % 100 < 40 then 1L else event_id % 4 end", "levels")


@query(f"SELECT {_AT}, user_id AS value FROM events")
def dec_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "user_id", "bits")


@query(f"SELECT rg, CAST(count(*) AS BIGINT) AS n, CAST(1 + {_WIDTH.replace('n - 1', 'max(value)').replace('n = 1', 'max(value) = 0')} * ((count(*) + 7) // 8) AS BIGINT) AS bytes FROM (SELECT {_RG}, user_id AS value FROM events) GROUP BY 1")
def enc_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.encoded(_events(spark, sf_dir, "user_id"), "bits").select("rg", "n", F.octet_length("payload").cast("long").alias("bytes"))


_DELTA_SIZES = f"""WITH d AS (SELECT rg, (i - 1) // 128 AS block, ((i - 1) % 128) // 32 AS miniblock, delta FROM ({_DELTAS}) WHERE i > 0),
b AS (SELECT rg, block, CASE WHEN count(*) < 128 THEN least(min(delta), 0) ELSE min(delta) END AS least FROM d GROUP BY 1, 2),
m AS (SELECT rg, block, miniblock, CASE WHEN count(*) < 32 THEN greatest(max(delta), 0) ELSE max(delta) END AS most FROM d GROUP BY 1, 2, 3),
parts AS (SELECT rg, sum(4 * CASE WHEN most = least THEN 0 ELSE length(bin(most - least)) END) AS x FROM m JOIN b USING (rg, block) GROUP BY 1),
heads AS (SELECT rg, sum(4 + {_uleb("CASE WHEN least >= 0 THEN 2 * least ELSE -2 * least - 1 END")}) AS x FROM b GROUP BY 1),
firsts AS (SELECT rg, CAST(count(*) AS BIGINT) AS n, 3 + {_uleb("count(*)")} + {_uleb("CASE WHEN min_by(user_id, pos) >= 0 THEN 2 * min_by(user_id, pos) ELSE -2 * min_by(user_id, pos) - 1 END")} AS x FROM ({_DELTAS}) GROUP BY 1)
SELECT rg, n, CAST(firsts.x + coalesce(heads.x, 0) + coalesce(parts.x, 0) AS BIGINT) AS bytes FROM firsts LEFT JOIN heads USING (rg) LEFT JOIN parts USING (rg)"""


@query(_DELTA_SIZES)
def enc_delta_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.encoded(_events(spark, sf_dir, "user_id"), "delta").select("rg", "n", F.octet_length("payload").cast("long").alias("bytes"))


@query(f"SELECT {_AT}, user_id AS value FROM events")
def dec_delta_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "user_id", "delta")


@query(f"SELECT {_AT}, user_id AS value FROM events")
def dec_plain_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "user_id", "plain")


@query(f"SELECT {_AT}, CASE WHEN event_id % 7 <> 0 THEN user_id END AS value FROM events")
def dec_page_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_values(P.pages(_events(spark, sf_dir, "case when event_id % 7 <> 0 then user_id end")))


@query(f"SELECT {_AT}, CASE WHEN event_id % 7 <> 0 THEN user_id END AS value FROM events")
def dec_page_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_values(P.pages(_events(spark, sf_dir, "case when event_id % 7 <> 0 then user_id end"), 2))
