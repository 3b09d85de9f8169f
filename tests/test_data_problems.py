"""Nested records, coverage and drift, against brute force and on odd input."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from spanwise.operators.coverage import coverage, disjoint, merge_all, merge_two, to_ms
from spanwise.operators.drift import FIELD_NAMES, consistent_table, file_fields, line_maps, line_members, schema_changes
from spanwise.operators.nested import elements, flat_table, nested_nodes, record_table, unparsed
from spanwise.session import materialize

ARRAYS = ("entries", "heatmap", "chapters", "marks", "links")


def brute_nodes(value, path="$", name="", found=None):
    """Recursive restatement: elements of named arrays that are objects."""
    found = [] if found is None else found
    if isinstance(value, dict):
        for k, x in value.items():
            at = k if path == "$" else f"{path}.{k}"
            if isinstance(x, list):
                brute_list(x, at, path, k, found)
            else:
                brute_nodes(x, at, k, found)
    elif isinstance(value, list):
        brute_list(value, "" if path == "$" else path, "$", "", found)
    return found


def brute_list(xs, at, holder, name, found):
    for i, x in enumerate(xs):
        own = f"{at}[{i}]"
        if isinstance(x, dict) and name in ARRAYS:
            found.append((own, holder))
        if isinstance(x, list):
            brute_list(x, own, holder, "", found)
        else:
            brute_nodes(x, own, "", found)


def random_value(rnd, depth=0):
    r = rnd.random()
    if depth > 4 or r < 0.25:
        return rnd.choice([1, 2.5, "x", None, True, ""])
    if r < 0.6:
        return {rnd.choice(["a", "chapters", "marks", "heatmap", "meta"]): random_value(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [random_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def test_nested_against_recursion(spark):
    rnd = random.Random(5)
    bodies = [json.dumps({"chapters": [random_value(rnd), {"marks": [random_value(rnd)]}], "k": random_value(rnd)}) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(bodies)), "record_id long, body string")
    got = {tuple(r) for r in nested_nodes(df, "record_id", "body", ARRAYS).select("record_id", "child_path", "parent_path").collect()}
    assert got == {(i, *x) for i, b in enumerate(bodies) for x in brute_nodes(json.loads(b))}


def test_nested_odd_input(spark):
    rows = [(1, None), (2, ""), (3, "{"), (4, '{"a": NaN}'), (5, '[{"chapters": [{"title": "t"}]}]'), (6, "[" * 5000), (7, '{"chapters": [1, {"title": null, "start_time": "2"}]}'), (7, '{"chapters": [1, {"title": null, "start_time": "2"}]}'), (None, '{"links": [{}]}'), (8, "3")]
    df = spark.createDataFrame(rows, "record_id long, body string").withColumn("members", F.lit("clash")).withColumn("child_path", F.lit("clash"))
    nodes = nested_nodes(df, "record_id", "body")
    paths = [(r["record_id"], r["child_path"], r["parent_path"], r["kind"]) for r in nodes.collect()]
    assert (5, "[0].chapters[0]", "[0]", "object") in paths and (None, "links[0]", "$", "object") in paths
    assert paths.count((7, "chapters[1]", "$", "object")) == 2 and (7, "chapters[0]", "$", "scalar") in paths and (8, "$", "", "scalar") in paths
    assert sorted(r[0] for r in unparsed(df, "record_id", "body").collect()) == [1, 2, 3, 4, 6]
    flat = flat_table(nodes, "record_id", "chapters", {"start_time": "double", "title": "string"}).filter("record_id = 7").collect()
    assert [(r["ordinal"], r["start_time"], r["title"]) for r in flat] == [(1, 2.0, None)] * 2
    assert record_table(nodes, "record_id", {"x": "int"}).filter("record_id = 7").count() == 2
    assert nested_nodes(df.filter("false"), "record_id", "body").collect() == []


def test_nested_at_any_depth(spark):
    """As deep as 100,000 levels, of objects, arrays and both, with repeated names and half surrogates."""
    n = 100_000
    deep = ['{"a":' * n + '{"chapters":[{"title":"x"}]}' + "}" * n, "[" * n + '{"chapters":[{}]}' + "]" * n, '{"chapters":[' * n + "]}" * n]
    assert [len(elements(b, lambda array, kind: array == "chapters" and kind == "object" and b is not deep[2])) for b in deep] == [1, 1, 0]
    assert elements("[" * n + "]" * (n - 1), lambda *_: False) is None
    again = '{"chapters":[{"t":1},{"marks":[{}]}],"a":{"b":1,"c":[{}]},"chapters":[{"t":2}],"a":{"d":"\\ud800"}}'
    got = {(r[2], tuple(r[6])) for r in elements(again)}
    assert got == {("chapters[0]", (("t", "2"),)), ("$", (("a.d", "\ufffd"),))}


def test_nested_grammar():
    rnd = random.Random(3)
    texts = [json.dumps(random_value(rnd), indent=rnd.choice([None, 1])) for _ in range(300)]
    for t in list(texts):
        at = rnd.randrange(len(t))
        texts += [t[:at] + rnd.choice('{}[],:"0.-e\\ tn\x01') + t[at + rnd.randrange(2) :], t + rnd.choice([" ", "\n", "x", "]", ","])]
    texts += ["01", "-", "1.", "1e", ".5", "tru", '"\\x"', '"a\tb"', "\ufeff{}", "NaN", "[1,]", '{"a":1,}', "{1:2}", "[,1]", "", " ", "null", "-0.0e+1", '{"":[]}']

    def no(x):
        raise ValueError

    for t in texts:
        try:
            json.loads(t, parse_constant=no)
            ok = True
        except ValueError:
            ok = False
        assert (elements(t) is not None) == ok, t


def brute_pieces(rows):
    out, by = set(), {}
    for k, i, s, e in rows:
        if None not in (k, i, s, e) and s >= 0 and e > s:
            by.setdefault((k, i), []).append((s, e))
    for (k, i), v in by.items():
        m = []
        for s, e in sorted(v):
            if m and s <= m[-1][1]:
                m[-1][1] = max(m[-1][1], e)
            else:
                m.append([s, e])
        out |= {(k, i, "period", s, e) for s, e in m} | {(k, i, "gap", a[1], b[0]) for a, b in zip(m, m[1:], strict=False)}
    return out


def test_coverage_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [("k", rnd.choice("abcdé"), s := rnd.randrange(-50, 9000), s + rnd.choice([-5, 0, 1, 5, 50, 900])) for _ in range(400)]
    rows += [("k", "hot", s := rnd.randrange(0, 50_000), s + rnd.randrange(1, 40)) for _ in range(2000)]
    rows += [("k", "huge", 5, 9_000_000_000_000_000), (None, "a", 1, 2), ("k", None, 1, 2), ("k", "a", None, 2), ("k", "a", 1, None)]
    df = spark.createDataFrame(rows + rows[:50], "entity_kind string, entity_id string, start_ms long, end_ms long").repartition(5)
    want = brute_pieces(rows)
    for block in (100, 600_000):
        got = [tuple(r) for r in coverage(df, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert coverage(df.filter("false")).collect() == []


def test_merge_is_associative():
    import numpy as np

    rnd = np.random.default_rng(0)
    start = rnd.integers(0, 3000, 500)
    end = start + rnd.integers(1, 20, 500)
    order = np.argsort(start, kind="stable")
    whole = disjoint(start[order], end[order])
    parts = [disjoint(np.sort(start[i]), end[i][np.argsort(start[i], kind="stable")]) for i in (slice(0, 200), slice(200, 201), slice(201, 201), slice(201, 500))]
    for one in (merge_all(parts), merge_all(parts[::-1]), merge_two(merge_two(parts[3], parts[0]), merge_two(parts[2], parts[1]))):
        assert all((x == y).all() for x, y in zip(whole, one, strict=True))


def test_one_entity_of_a_million_intervals(spark):
    """Nested, overlapping and parted intervals of one hot entity, over many tasks and levels."""
    n = 1_000_000
    df = spark.range(0, n, 1, 40).select(F.lit("k").alias("entity_kind"), F.lit("hot").alias("entity_id"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + F.when(F.col("id") % 1000 == 999, 5).otherwise(15)).alias("end_ms"))
    out = coverage(df, fan_in=2)
    assert out.groupBy("piece").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms")).orderBy("piece").collect() == [("gap", 999, 999 * 5), ("period", 1000, n * 10 - 999 * 5 - 5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("starts" not in line and "ends#" not in line.split("Window", 1)[1].split("windowspec")[0] for line in plan.splitlines() if "Window [" in line)


def test_to_ms(spark):
    df = spark.createDataFrame([(1.0005,), (None,), (float("nan"),), (float("inf"),), (-0.0001,)], "x double")
    assert [r[0] for r in df.select(to_ms(F.col("x"))).collect()] == [1001, None, None, None, 0]


def drops(spark, files):
    rows = [(i, feed, name, seq, n, body) for i, (feed, name, seq, n, body) in enumerate((f, name, seq, n, b) for f, name, seq, bodies in files for n, b in enumerate(bodies))]
    return spark.createDataFrame(rows, "record_id long, feed string, file_name string, file_seq int, line_no int, body string")


def line(**members):
    return json.dumps(members)


def test_schema_changes(spark):
    ids = [f"v{i}" for i in range(12)]
    live = [i % 4 == 0 for i in range(12)]
    lang = ["en", "hi", "de", "ur"] * 3
    url = [f"https://x/@{i}" for i in range(12)]
    a = [line(id=i, is_live=b, language=g, channel_url=u, age=18) for i, b, g, u in zip(ids, live, lang, url, strict=True)] + ["{", None, "", "[1]"]
    b = [line(id=i, isLive=str(b).lower(), original_language=[g], channel_url={"url": u, "handle": "h"}, kind="short") for i, b, g, u in zip(ids, live, lang, url, strict=True)]
    c = [line(id=i, isLive=str(b).lower(), original_language=[g], channel_url={"url": u, "handle": "h"}, kind=None) for i, b, g, u in zip(ids, live, lang, url, strict=True)]
    df = drops(spark, [("f", "b.json", 2, b), ("f", "a.json", 1, a), ("f", "c.json", 3, c), ("g", "other.json", 1, a), (None, "no.json", 1, a)])
    got = {tuple(r) for r in schema_changes(df).collect()}
    assert got == {
        ("b.json", "removed", "age", ""), ("b.json", "added", "", "kind"), ("b.json", "renamed", "is_live", "isLive"), ("b.json", "retyped", "is_live", "isLive"),
        ("b.json", "renamed", "language", "original_language"), ("b.json", "retyped", "language", "original_language"), ("b.json", "retyped", "channel_url", "channel_url"),
    }
    fields = {(r["member"], r["type"]) for r in file_fields(line_members(line_maps(df))).filter("file_name = 'a.json'").collect()}
    assert fields == {("id", "string"), ("is_live", "boolean"), ("language", "string"), ("channel_url", "string"), ("age", "number")}
    assert schema_changes(df.filter("false")).collect() == []


#: Seeds with more names than those of the format.
MORE_NAMES = FIELD_NAMES | {"is_live": (["is_live", "isLive"], "boolean"), "language": (["language", "lang"], "string"), "channel_url": (["channel_url", "channel_link"], "string")}


def test_consistent_table(spark):
    df = drops(spark, [("f", "a", 1, [line(id="1", isLive="true", lang=["en"], channel_url={"url": "u", "handle": "h"}, duration="12.5", x=1), line(id="2", duration="abc", is_live=1), "{", None])])
    rows = {r["record_id"]: r for r in consistent_table(df, MORE_NAMES).collect()}
    assert (rows[0]["is_live"], rows[0]["language"], rows[0]["channel_url"], rows[0]["duration_sec"], rows[0]["rest"]) == (True, "en", "u", 12.5, {"x": "1"})
    assert rows[1]["failed_casts"] == ["duration_sec"] and rows[1]["is_live"] is True and rows[1]["duration_sec"] is None
    assert not rows[2]["parsed"] and not rows[3]["parsed"] and rows[3]["failed_casts"] == []


def test_consistent_table_follows_renames(spark):
    """Names that no list has: forward, chained, over a file that leaves the field out, backward, and
    as another feed's renames explain them."""
    ids = [f"v{i}" for i in range(12)]
    lang = ["en", "hi", "de", "ur"] * 3
    live = [i % 4 == 0 for i in range(12)]
    url = [f"https://x/@{i}" for i in range(12)]
    file = lambda g, b, u: [line(**{"id": i, **({g: [x]} if g else {}), b: y, u: z}) for i, x, y, z in zip(ids, lang, live, url, strict=True)]
    forward = [("f", "1", 1, file("language", "is_live", "channel_url")), ("f", "2", 2, file("idioma", "en_vivo", "it's ?\"here\"")), ("f", "3", 3, file("sprache", "en_vivo", "channel_url"))]
    forward += [("f", "4", 4, file(None, "en_vivo", "channel_url")), ("f", "5", 5, file("sprache", "on_air", "channel_url"))]
    backward = [("g", "6", 1, file("tongue", "is_live", "home")), ("g", "7", 2, file("lang", "is_live", "channel_link")), (None, "8", 1, file("idioma", "is_live", "channel_url"))]
    by = {}
    for r in consistent_table(drops(spark, forward + backward), MORE_NAMES).collect():
        by.setdefault(r["file_name"], []).append(r)
    for name, rows in by.items():
        rows.sort(key=lambda r: r["line_no"])
        assert [r["language"] for r in rows] == (lang if name != "4" else [None] * 12), name
        assert [r["is_live"] for r in rows] == live and [r["channel_url"] for r in rows] == url, name
        assert all(r["failed_casts"] == [] and r["rest"] == {} for r in rows), name
    assert sorted(by) == list("12345678")


def test_names_spelled_otherwise(spark):
    """A feed that never renames a member: its words are those of a seed, or it stays in the rest."""
    df = drops(spark, [("f", "a", 1, [line(id=1, channelUrl="u", isLive=True, someLink="x"), line(id=2, channelUrl="v")])])
    rows = sorted(map(tuple, consistent_table(df).select("id", "channel_url", "is_live", "rest").collect()))
    assert rows == [("1", "u", True, {"someLink": "x"}), ("2", "v", None, {})]


def test_fields_are_told_apart_by_feed(spark):
    """One file name in two feeds; an empty object counts as a line."""
    df = drops(spark, [("f", "a", 1, [line(id=1, x=1)]), ("g", "a", 1, [line(id=1, y="1"), "{}", "{}"]), ("f", "b", 2, [line(id=1, x="1")]), ("g", "b", 2, [line(id=1, y=1)])])
    fields = {(r["feed"], r["file_name"], r["member"], r["type"]) for r in file_fields(line_members(line_maps(df))).collect()}
    assert fields == {("f", "a", "id", "number"), ("f", "a", "x", "number"), ("f", "b", "id", "number"), ("f", "b", "x", "string"), ("g", "b", "id", "number"), ("g", "b", "y", "number")}
    assert {tuple(r) for r in schema_changes(df).collect()} == {("b", "retyped", "x", "x"), ("b", "added", "", "id"), ("b", "added", "", "y")}


def test_materialize_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.array(F.col("id")))
    assert sorted(map(tuple, ((r["id"], tuple(r["x"])) for r in materialize(df).collect()))) == [(i, (i,)) for i in range(10)]


def test_p3_found_is_of_the_pass_with_triples(spark, tmp_path, monkeypatch):
    from spanwise.plans import data_problems

    seen = []
    monkeypatch.setattr(data_problems, "nested_nodes", lambda *a: seen.append(nested_nodes(*a)) or seen[-1])
    spark.createDataFrame([(1, '{"links": [{"url": "u"}]}')], "record_id long, body string").write.parquet(str(tmp_path / "info_json.parquet"))
    assert [tuple(r) for r in data_problems.p3_found(spark, str(tmp_path)).collect()] == [(1, "links[0]", "$")]
    assert seen[0].collect()[0]["members"]
