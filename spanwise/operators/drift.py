"""Files whose fields drift: one consistent table, and a report of every change.

Lines are loaded once as maps of member to value with its raw JSON type. Statistics per file and
member (how many lines hold it, with which type) are plain counts, pre-aggregated before the
shuffle. Successive files of a feed are compared on those counts; which added member carries the
information of a removed one is decided by the values both give for the same record. The table
projects typed columns from the maps, each file's members being those its renames lead to.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from spanwise.session import materialize

#: A member is a rename if the values agree on this share of the records that both files hold,
#: and better than chance by MIN_LIFT (agreement over chance, 1 being perfect).
MIN_AGREE = 0.8
MIN_LIFT = 0.6
#: Without that many common records with a value, the names' words decide, then the values' overlap.
MIN_COMMON = 3
MIN_OVERLAP = 0.6

_TYPES = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def json_type(value: Column) -> Column:
    """JSON type (string, number, boolean, array, object, null) of a VARIANT."""
    kind = F.schema_of_variant(value)
    case = F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    for k, v in _TYPES.items():
        case = case.when(kind == k, v)
    return case.otherwise("number")


#: What a file is known by. Files of one name in two feeds, or under two numbers, are different files.
FILE = ["feed", "file_seq", "file_name"]


def line_maps(drops: DataFrame, key_member: str = "id") -> DataFrame:
    """(feed, file_seq, file_name, record_id, line_no, entity, members): every line, kept for several uses.

    ``members`` maps each member to its ``type`` (:func:`json_type`) and ``raw``, the value's JSON
    text without the quotes of a string; it is null for a line that is null, empty, not JSON or no
    object. ``entity`` is the value of the member that names the record. The lines are parsed once
    and kept in the session's shared folder.
    """
    other = [c for c in ("record_id", "line_no") if c in drops.columns]
    rows = drops.select(*FILE, *other, "body", F.try_parse_json("body").alias("v"))
    body = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("body"))
    rows = rows.select(*FILE, *other, F.from_json(body, T.MapType(T.StringType(), T.VariantType())).alias("values"))
    raw = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    members = F.transform_values("values", lambda _, v: F.struct(F.coalesce(json_type(v), F.lit("null")).alias("type"), raw(v).alias("raw")))
    return materialize(rows.select(*FILE, *other, members.alias("members"))).withColumn("entity", F.try_element_at("members", F.lit(key_member))["raw"])


def line_members(lines: DataFrame) -> DataFrame:
    """(feed, file_seq, file_name, entity, member, type, raw, first) of the members of :func:`line_maps`.

    ``first`` marks one row of every line that parses; an empty object has one row without a member.
    """
    rows = lines.filter("members IS NOT NULL").select(*FILE, "entity", F.posexplode_outer(F.map_entries("members")).alias("pos", "m"))
    return rows.select(*FILE, "entity", F.col("m.key").alias("member"), "m.value.type", "m.value.raw", (F.coalesce("pos", F.lit(0)) == 0).alias("first"))


def longest_scalar(raw: Column) -> Column:
    """The longest scalar in a list or object given as JSON text (ties: last by text); null if it has none."""
    scalars = F.regexp_extract_all(F.regexp_replace(raw, r'"[^"]*":', ""), F.lit(r'"([^"]*)"|([^",\[\]{}]+)'), F.lit(0))
    return F.array_max(F.transform(scalars, lambda x: F.struct(F.length(x).alias("n"), F.translate(x, '"', "").alias("x"))))["x"]


def with_comparable(values: DataFrame) -> DataFrame:
    """Adds ``val``: the value ``raw`` of JSON type ``type`` in one form whatever type carries it.

    A list or object stands for the longest scalar in it, a number for its shortest text, a boolean
    for 0 or 1. ``raw`` of lists and objects is compact JSON with sorted members. Each step is a
    column of its own, so that no expression is evaluated twice.
    """
    longest = longest_scalar(F.col("raw"))
    one = values.withColumn("val", F.lower(F.trim(F.when(F.col("type").isin("array", "object"), F.coalesce(longest, F.col("raw"))).otherwise(F.col("raw")))))
    one = one.withColumn("val", F.when(F.col("val") == "true", "1").when(F.col("val") == "false", "0").otherwise(F.col("val")))
    return one.withColumn("val", F.coalesce(F.col("val").try_cast("double").cast("string"), F.col("val")))


def file_fields(members: DataFrame) -> DataFrame:
    """(feed, file_seq, file_name, member, type): the fields that belong to each file.

    A field belongs to a file if at least half of its parsable lines hold the member, null included;
    a line counts as often as it was delivered. Its type is that of most non-null values (``null`` if
    there are none; ties: first by name).
    """
    counts = members.groupBy(*FILE, "member", "type").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("long")).alias("lines"))
    best = F.max(F.struct(F.when(F.col("type") != "null", F.col("n")).otherwise(0).alias("n"), F.negative(F.ascii("type")).alias("order"), F.col("type").alias("type")))
    per = counts.groupBy(*FILE, "member").agg(F.sum("n").alias("held"), best.alias("best"), F.sum("lines").alias("lines"))
    # one short row per file and member
    per = per.withColumn("lines", F.sum("lines").over(W.Window.partitionBy(*FILE)))
    return per.filter("member IS NOT NULL AND held * 2 >= lines").select(*FILE, "member", F.col("best.type").alias("type"))


def successions(drops: DataFrame) -> DataFrame:
    """(file, old): each file, as a struct, and the file before it by ``file_seq``.

    Files without a parsable line count as files. Names that share one ``file_seq`` follow each
    other by name.
    """
    files = drops.filter("feed IS NOT NULL AND file_seq IS NOT NULL AND file_name IS NOT NULL").groupBy(*FILE).agg(F.lit(1).alias("one"))
    w = W.Window.partitionBy("feed").orderBy("file_seq", "file_name")
    return files.select(F.struct(*FILE).alias("file"), F.lag(F.struct(*FILE)).over(w).alias("old")).filter("old IS NOT NULL")


def _words(name: Column) -> Column:
    """Lower-case words of a member's name; camelCase, underscores and dots part words."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")), r"[_.\s-]+"), lambda x: x != "")


def _spelled(name: str) -> str:
    """:func:`_words` of a name that is at hand, joined."""
    return "_".join(w for w in re.split(r"[_.\s-]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if w)


def _scores(grid: DataFrame, members: DataFrame) -> DataFrame:
    """Scores of each removed member against each added one of the same file.

    ``grid`` (file, old, old_name, new_name) is as short as the files' changed fields are few; only
    those members' values are moved. All figures of a pair come from one contingency pass: values by
    record, then by value, then by pair.
    """
    pair = ["file", "old_name", "new_name"]
    values = members.filter("type != 'null' AND entity IS NOT NULL").select(F.struct(*FILE).alias("at"), "member", "entity", "raw", "type")
    # the pairs a member of a file takes part in, whichever side it is on
    sides = grid.select(*pair, F.explode(F.array(F.struct(F.col("old").alias("at"), F.col("old_name").alias("member"), F.lit(True).alias("is_old")), F.struct(F.col("file").alias("at"), F.col("new_name").alias("member"), F.lit(False).alias("is_old")))).alias("s"))
    rows = with_comparable(values.join(sides.select(*pair, "s.*"), ["at", "member"]))
    # a record that repeats within a file keeps its smallest value
    per = rows.groupBy(*pair, "entity").agg(F.min(F.when(F.col("is_old"), F.col("val"))).alias("ov"), F.min(F.when(~F.col("is_old"), F.col("val"))).alias("nv"))
    both = F.when(F.col("ov").isNotNull() & F.col("nv").isNotNull(), 1).otherwise(0)
    same = F.when(F.col("ov") == F.col("nv"), 1).otherwise(0)
    cell = lambda v, r, c, e, o, n: F.struct(v.alias("val"), r.alias("r"), c.alias("c"), e.alias("e"), F.lit(o).alias("o"), F.lit(n).alias("n"))
    zero = F.lit(0)
    by_value = per.select(*pair, F.explode(F.array(cell(F.col("ov"), both, zero, same, 1, 0), cell(F.col("nv"), zero, both, zero, 0, 1))).alias("x")).filter("x.val IS NOT NULL")
    by_value = by_value.groupBy(*pair, "x.val").agg(*[F.sum(f"x.{k}").alias(k) for k in "rce"], *[F.max(f"x.{k}").alias(k) for k in "on"])
    stats = by_value.groupBy(*pair).agg(F.sum("r").alias("n"), F.sum("e").alias("same"), F.sum(F.col("r") * F.col("c")).alias("product"), F.sum(F.col("o") * F.col("n")).alias("shared"), F.count("*").alias("values"))

    n = F.coalesce(F.col("n"), zero)
    agree = F.when(n > 0, F.col("same") / n)
    by_chance = F.when(n > 0, F.col("product") / (n * n))
    lift = F.when(by_chance < 1, (agree - by_chance) / (1 - by_chance))
    old_words, new_words = _words(F.col("old_name")), _words(F.col("new_name"))
    words = F.size(F.array_intersect(old_words, new_words)) / F.greatest(F.lit(1), F.least(F.size(old_words), F.size(new_words)))
    overlap = F.coalesce(F.try_divide("shared", "values"), F.lit(0.0))
    scored = grid.join(stats, pair, "left").select(*pair, n.alias("n"), agree.alias("agree"), lift.alias("lift"), words.alias("words"), overlap.alias("overlap"))
    proven = (F.col("n") >= MIN_COMMON) & (F.col("agree") >= MIN_AGREE) & (F.col("lift") >= MIN_LIFT)
    # common records whose values never vary prove nothing either way, nor do too few of them
    undecided = (F.col("n") < MIN_COMMON) | (F.col("lift").isNull() & (F.col("agree") >= MIN_AGREE))
    likely = undecided & ((F.col("words") >= 0.5) | (F.col("overlap") >= MIN_OVERLAP))
    score = F.when(proven, 2 + F.col("lift")).when(likely, F.col("words") / 2 + F.col("overlap") / 2)
    return scored.select(*pair, score.alias("score")).filter("score IS NOT NULL")


def schema_changes(drops: DataFrame, key_member: str = "id") -> DataFrame:
    """(file_name, change, old_name, new_name) of every file against the feed's file before it.

    ``added`` has an empty old name, ``removed`` an empty new name, ``renamed`` and ``retyped`` fill
    both; a field renamed and retyped at once gives both rows. A feed's first file gives none. A
    field whose values are all null in one of the files is not retyped. Rows with a null feed, file
    or sequence are left out, as are lines that do not parse. An empty table gives no rows.

    The fields that differ between two files, and the renames among them, are two short tables
    (rows per file and field) kept in the session's shared folder.
    """
    diff, removed, added, renamed = _differences(drops, line_members(line_maps(drops, key_member)))
    row = lambda df, change, a, b: df.select("file.file_name", F.lit(change).alias("change"), a.alias("old_name"), b.alias("new_name"))
    empty, same, differs = F.lit(""), F.col("member"), "old_type != new_type AND old_type != 'null' AND new_type != 'null'"
    out = row(removed.join(renamed, ["file", "old_name"], "left_anti"), "removed", F.col("old_name"), empty)
    out = out.unionByName(row(added.join(renamed, ["file", "new_name"], "left_anti"), "added", empty, F.col("new_name")))
    out = out.unionByName(row(renamed, "renamed", F.col("old_name"), F.col("new_name")))
    out = out.unionByName(row(renamed.filter(differs), "retyped", F.col("old_name"), F.col("new_name")))
    return out.unionByName(row(diff.filter(differs), "retyped", same, same))


def _differences(drops: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Fields that differ between successive files; of these the removed, the added and the renamed ones."""
    fields = file_fields(members).select(F.struct(*FILE).alias("at"), "member", "type")
    # one join: a file's fields are the new ones of its own step and the old ones of the next
    steps = successions(drops)
    sides = steps.select("file", "old", F.explode(F.array(F.struct(F.col("file").alias("at"), F.lit(True).alias("is_new")), F.struct(F.col("old").alias("at"), F.lit(False).alias("is_new")))).alias("s")).select("file", "old", "s.*")
    side = lambda new: F.max(F.when(F.col("is_new") == new, F.col("type")))
    diff = sides.join(fields, "at").groupBy("file", "old", "member").agg(side(False).alias("old_type"), side(True).alias("new_type"))
    diff = materialize(diff.filter("NOT (old_type <=> new_type)"))

    removed = diff.filter("new_type IS NULL").select("file", "old", F.col("member").alias("old_name"), "old_type")
    added = diff.filter("old_type IS NULL").select("file", F.col("member").alias("new_name"), "new_type")
    grid = removed.join(added, "file").drop("old_type", "new_type")
    # one-to-one: keep the pairs that are the best of both their members
    best = lambda name: F.row_number().over(W.Window.partitionBy("file", name).orderBy(F.desc("score"), "old_name", "new_name"))
    scored = _scores(grid, members).withColumn("r", best("old_name")).withColumn("s", best("new_name")).filter("r = 1 AND s = 1")
    renamed = materialize(scored.select("file", "old_name", "new_name").join(removed.drop("old"), ["file", "old_name"]).join(added, ["file", "new_name"]))
    return diff, removed, added, renamed


#: Fields of the consistent table: the names that the Info JSON format gives each, and its type.
#: Whatever else a feed calls them is found by its renames.
FIELD_NAMES = {
    "id": (["id"], "string"),
    "title": (["title"], "string"),
    "channel_url": (["uploader_url", "channel_url"], "string"),
    "duration_sec": (["duration"], "double"),
    "follower_count": (["channel_follower_count"], "bigint"),
    "is_live": (["is_live"], "boolean"),
    "language": (["language", "original_language"], "string"),
}


def _chained(files: list[list[tuple[str, str]]], seed: dict[str, tuple[str, int]]) -> list[dict[str, tuple[str, int]]]:
    """What each (member, name before) of a feed's successive files carries: a field and its seed's rank.

    A seed name carries its own field. Others take that of the name they had before or have later;
    a name keeps its meaning over files that leave it out, until a rename gives it another.
    """
    found = [{m: seed[m] for m, _ in file if m in seed} for file in files]
    while True:
        before = sum(map(len, found))
        known: dict[str, tuple[str, int] | None] = {}
        for file, own in zip(files, found, strict=True):
            now = {m: own.get(m) or known.get(was) for m, was in file}
            for m, was in file:
                if m != was:
                    known.pop(was, None)
            known.update({m: f for (m, was), f in zip(file, now.values(), strict=True) if f or m != was})
            own.update({m: f for m, f in now.items() if f})
        known = {}
        for file, own in zip(reversed(files), reversed(found), strict=True):
            own.update({m: f for m, _ in file if m not in own and (f := known.get(m))})
            for m, was in file:
                if m != was:
                    known.pop(m, None)
            known.update({was: own.get(m) for m, was in file if m in own or m != was})
        if sum(map(len, found)) == before:
            return found


def field_members(drops: DataFrame, lines: DataFrame, fields: dict[str, tuple[list[str], str]] | None = None) -> DataFrame:
    """(feed, file_seq, file_name, field, rank, member): members that carry a field, under a name which
    is no seed, in the lines of a file.

    The fields of a file are chained along the feed by the renames that ``schema_changes`` reports;
    ``rank`` is the place of the seed name that the chain leads to. A feed's rows, one per file and
    field, are chained in one task. A name that the feed's own renames do not explain, but that has the
    words of a seed (such as in camel case), means that seed; any other means what it means in most
    files of other feeds (ties: first by name). Both have a ``rank`` after all seeds.
    """
    seed = {m: (name, rank) for name, (members, _) in reversed((fields or FIELD_NAMES).items()) for rank, m in reversed(list(enumerate(members)))}
    members = line_members(lines)
    renamed = _differences(drops, members)[3].select("file.*", F.col("new_name").alias("member"), F.col("old_name").alias("was"))
    held = file_fields(members).filter("feed IS NOT NULL AND file_seq IS NOT NULL AND file_name IS NOT NULL")
    rows = held.join(renamed, [*FILE, "member"], "left").select(*FILE, "member", F.coalesce("was", "member").alias("was"))
    schema = T.StructType([*(rows.schema[c] for c in FILE), T.StructField("field", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("member", T.StringType())])

    def one_feed(group: pa.Table) -> pa.Table:
        files: dict[tuple[int, str], list[tuple[str, str]]] = {}
        for r in group.sort_by([("file_seq", "ascending"), ("file_name", "ascending"), ("member", "ascending")]).to_pylist():
            files.setdefault((r["file_seq"], r["file_name"]), []).append((r["member"], r["was"]))
        feed = group["feed"][0].as_py()
        out = [(feed, *file, *f, m) for file, own in zip(files, _chained(list(files.values()), seed), strict=True) for m, f in own.items() if m not in seed]
        kinds = [group["feed"].type, group["file_seq"].type, group["file_name"].type, pa.string(), pa.int32(), pa.string()]
        return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=schema.fieldNames())

    per_file = materialize(rows.groupBy("feed").applyInArrow(one_feed, schema))
    votes = per_file.groupBy("member", "field").agg(F.count("*").alias("n"))
    meant = votes.groupBy("member").agg(F.max_by("field", F.struct("n", F.negative(F.ascii("field")).alias("order"), "field")).alias("field"))
    names = members.filter("member IS NOT NULL").select(*FILE, "member").distinct().filter(~F.col("member").isin(*seed))
    by_words = F.create_map(*[F.lit(x) for pair in {_spelled(m): field for m, (field, _) in seed.items()}.items() for x in pair])
    alike = names.select(*FILE, F.try_element_at(by_words, F.array_join(_words(F.col("member")), "_")).alias("field"), F.lit(len(seed)).alias("rank"), "member").filter("field IS NOT NULL")
    others = names.join(meant, "member").select(*FILE, "field", F.lit(len(seed) + 1).alias("rank"), "member")
    both = per_file.unionByName(alike).unionByName(others).groupBy(*FILE, "member").agg(F.min(F.struct("rank", "field")).alias("f"))
    return both.select(*FILE, "f.field", "f.rank", "member")


def consistent_table(drops: DataFrame, fields: dict[str, tuple[list[str], str]] | None = None, key_member: str = "id") -> DataFrame:
    """Every line under one schema, with what could not be cast.

    Columns: record_id, feed, file_name, file_seq, line_no, parsed, one column per field,
    ``failed_casts`` (fields whose value could not take the column's type) and ``rest`` (members of
    no field, as a map). A field is read from its seed names, then from the members that the file's
    own renames lead to, then from those that other feeds' renames do; the first non-null wins. A
    list or object gives the longest scalar in it, and 0 and 1 are booleans too. A line that does not
    parse keeps its row with ``parsed`` false and nulls.
    """
    fields = fields or FIELD_NAMES
    lines = line_maps(drops, key_member)
    found = field_members(drops, lines, fields).groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("rank", "member", "field"))).alias("found"))
    found = found.select(*[F.col(c).alias(f"found_{c}") for c in FILE], "found")
    rows = lines.join(found, [F.col(c).eqNullSafe(F.col(f"found_{c}")) for c in FILE], "left")

    def names(field: str) -> Column:
        more = F.transform(F.filter("found", lambda x: x["field"] == field), lambda x: x["member"])
        return F.concat(F.array(*map(F.lit, fields[field][0])), F.coalesce(more, F.array().cast("array<string>")))

    rows = rows.withColumns({f"_{n}": names(n) for n in fields})
    first = lambda ms: F.get(F.filter(F.transform(ms, lambda m: F.try_element_at("members", m)), lambda x: x["raw"].isNotNull() & (x["type"] != "null")), 0)
    rows = rows.withColumns({f"v_{n}": first(F.col(f"_{n}")) for n in fields})
    shown = {n: F.when(F.col(f"v_{n}.type").isin("array", "object"), F.coalesce(longest_scalar(F.col(f"v_{n}.raw")), F.col(f"v_{n}.raw"))).otherwise(F.col(f"v_{n}.raw")) for n in fields}
    rows = rows.withColumns({f"v_{n}": x for n, x in shown.items()})
    typed = {n: F.col(f"v_{n}").try_cast(t) for n, (_, t) in fields.items()}
    failed = F.filter(F.array(*[F.when(F.col(f"v_{n}").isNotNull() & typed[n].isNull(), F.lit(n)) for n in fields]), lambda x: x.isNotNull())
    used = F.flatten(F.array(*[F.col(f"_{n}") for n in fields]))
    rest = F.transform_values(F.map_filter("members", lambda k, _: ~F.array_contains(used, k)), lambda _, x: F.when(x["type"] != "null", x["raw"]))
    return rows.select("record_id", "feed", "file_name", "file_seq", "line_no", F.col("members").isNotNull().alias("parsed"), *[c.alias(n) for n, c in typed.items()], failed.alias("failed_casts"), rest.alias("rest"))
