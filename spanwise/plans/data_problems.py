"""Queries of the general data-processing operators (nested records, coverage, drift) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.operators.coverage import coverage, to_ms
from spanwise.operators.drift import consistent_table, file_fields, line_maps, line_members, schema_changes
from spanwise.operators.nested import flat_table, nested_nodes, record_table, unparsed
from spanwise.session import table

ARRAYS = ("entries", "heatmap", "chapters", "marks", "links")


def _nodes(spark: SparkSession, d: str, *arrays: str) -> DataFrame:
    return nested_nodes(table(spark, d, "info_json"), "record_id", "body", arrays)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, *ARRAYS).select("record_id", "child_path", "parent_path")


#: Columns of the record's own table and of the table of each array.
RECORD = {"id": "string", "title": "string", "channel": "string", "duration": "double", "language": "string", "is_live": "boolean", "channel_follower_count": "bigint"}
TABLES = {
    "heatmap": {"start_time": "double", "end_time": "double", "value": "double"},
    "chapters": {"start_time": "double", "end_time": "double", "title": "string"},
    "marks": {"at_time": "double", "label": "string"},
    "links": {"url": "string", "note": "string"},
}


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return record_table(nested_nodes(table(spark, d, "info_json"), "record_id", "body", (), record=True), "record_id", RECORD)


def _table(array: str):  # noqa: ANN202
    def query(spark: SparkSession, d: str) -> DataFrame:
        return flat_table(_nodes(spark, d, array), "record_id", array, TABLES[array])

    return query


def p3_unparsed(spark: SparkSession, d: str) -> DataFrame:
    return unparsed(table(spark, d, "info_json"), "record_id", "body")


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, kind, key: table(spark, d, name).select(F.lit(kind).alias("entity_kind"), F.col(key).cast("string").alias("entity_id"), to_ms(F.col("start_sec")).alias("start_ms"), to_ms(F.col("end_sec")).alias("end_ms"))
    return one("caption_cues", "cues", "caption_id").unionByName(one("chapters", "chapters", "video_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return coverage(_intervals(spark, d))


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    ms = F.col("end_ms") - F.col("start_ms")
    per = coverage(_intervals(spark, d)).groupBy("entity_kind", "entity_id")
    return per.agg(*[F.sum(F.when(F.col("piece") == p, v).otherwise(0)).cast("long").alias(f"{n}_{p}") for p in ("period", "gap") for n, v in (("n", F.lit(1)), ("ms", ms))])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "video_drops"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return consistent_table(table(spark, d, "video_drops"))


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    return file_fields(line_members(line_maps(table(spark, d, "video_drops")))).select("feed", "file_name", "member", "type")


QUERIES = {f"p3_{a}": _table(a) for a in TABLES} | {f.__name__: f for f in (p3_found, p3_records, p3_unparsed, p4_found, p4_totals, p5_found, p5_table, p5_fields)}

_TREE = "WITH t AS (SELECT r.record_id, j.type, j.atom, j.id AS nid, j.parent AS pid, j.key AS k, replace(substr(j.fullkey, 3), '\"', '') AS path, replace(j.path, '\"', '') AS holder, j.value FROM (SELECT record_id, body FROM info_json WHERE body IS NOT NULL AND body <> '' AND json_valid(body)) r, json_tree(r.body) j)"
_ELEMENTS = _TREE + ", e AS (SELECT record_id, nid, path AS child_path, regexp_extract(holder, '([A-Za-z_]+)$', 1) AS arr, CASE WHEN contains(substr(holder, 3), '.') THEN regexp_replace(substr(holder, 3), '[.][A-Za-z_]+$', '') ELSE '$' END AS parent_path, CAST(k AS INTEGER) AS ordinal, value FROM t WHERE type = 'OBJECT' AND regexp_matches(holder, '[.](entries|heatmap|chapters|marks|links)$') AND ends_with(path, ']'))"


def _columns(value: str, columns: dict[str, str]) -> str:
    scalar = f"CASE WHEN json_type({value}, '$.{{0}}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string({value}, '$.{{0}}') END"
    return ", ".join(f"TRY_CAST({scalar.format(c)} AS {'VARCHAR' if t == 'string' else t}) AS {c}" for c, t in columns.items())


_PIECES = """WITH i AS (
  SELECT 'cues' AS entity_kind, CAST(caption_id AS VARCHAR) AS entity_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e FROM caption_cues WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL
  UNION ALL SELECT 'chapters', video_id, CAST(round(start_sec * 1000) AS BIGINT), CAST(round(end_sec * 1000) AS BIGINT) FROM chapters WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL),
ok AS (SELECT * FROM i WHERE s >= 0 AND e > s),
m AS (SELECT *, max(e) OVER (PARTITION BY entity_kind, entity_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY entity_kind, entity_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM m),
p AS (SELECT entity_kind, entity_id, min(s) AS start_ms, max(e) AS end_ms FROM g GROUP BY entity_kind, entity_id, grp),
l AS (SELECT *, lag(end_ms) OVER (PARTITION BY entity_kind, entity_id ORDER BY start_ms) AS prior FROM p),
pieces AS (SELECT entity_kind, entity_id, 'period' AS piece, start_ms, end_ms FROM l
  UNION ALL SELECT entity_kind, entity_id, 'gap', prior, start_ms FROM l WHERE prior IS NOT NULL)"""

_FIELDS = """WITH lines AS (SELECT feed, file_seq, file_name, body FROM video_drops WHERE body IS NOT NULL AND body <> '' AND json_valid(body) AND json_type(body) = 'OBJECT'),
m AS (SELECT feed, file_seq, file_name, j.key AS member, CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type FROM lines, json_each(lines.body) j),
n AS (SELECT feed, file_seq, file_name, count(*) AS lines FROM lines GROUP BY ALL),
c AS (SELECT feed, file_seq, file_name, member, type, count(*) AS n FROM m GROUP BY ALL),
h AS (SELECT feed, file_seq, file_name, member, sum(n) AS held FROM c GROUP BY ALL),
b AS (SELECT feed, file_seq, file_name, member, type, row_number() OVER (PARTITION BY feed, file_seq, file_name, member ORDER BY CASE WHEN type = 'null' THEN 0 ELSE n END DESC, type) AS r FROM c)
SELECT b.feed, b.file_name, b.member, b.type FROM b JOIN h USING (feed, file_seq, file_name, member) JOIN n USING (feed, file_seq, file_name) WHERE r = 1 AND held * 2 >= lines"""

ORACLES = {
    "p3_found": f"{_ELEMENTS} SELECT record_id, child_path, parent_path FROM e",
    "p3_records": f"SELECT record_id, {_columns('body', RECORD)} FROM info_json WHERE body IS NOT NULL AND body <> '' AND json_valid(body)",
    "p3_unparsed": "SELECT record_id FROM info_json WHERE body IS NULL OR body = '' OR NOT json_valid(body)",
    "p4_found": f"{_PIECES} SELECT * FROM pieces",
    "p4_totals": f"{_PIECES} SELECT entity_kind, entity_id, CAST(sum(CASE WHEN piece = 'period' THEN 1 ELSE 0 END) AS BIGINT) AS n_period, CAST(sum(CASE WHEN piece = 'period' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS ms_period, CAST(sum(CASE WHEN piece = 'gap' THEN 1 ELSE 0 END) AS BIGINT) AS n_gap, CAST(sum(CASE WHEN piece = 'gap' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS ms_gap FROM pieces GROUP BY 1, 2",
    "p5_fields": _FIELDS,
}
ORACLES |= {f"p3_{a}": f"{_ELEMENTS} SELECT record_id, child_path, parent_path, ordinal, {_columns('value', c)} FROM e WHERE arr = '{a}'" for a, c in TABLES.items()}
