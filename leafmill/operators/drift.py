"""Records whose fields drift from file to file: catalogue of lifespans, change log, aliases and one consistent table.

A *field row* is one top-level field of one record of one file. The catalogue holds, for each stream (the producer), field
and set of types, the islands of files it lives in without a gap; the change log is read off where islands start and end.
A *life* is a field's presence without a gap, whatever its types; renames tie the lives of a stream to lineages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.runtime import materialize

#: most columns a table can be laid out with; more are an error, never cut
MOST_FIELDS = 5000

# nested values keep the order of their keys only outside variants
_NESTED = r":\s*[{\[]"


def _parsed(raw: DataFrame) -> DataFrame:
    """JSON objects only. In brackets a line is parsed whole: text behind the object spoils it."""
    boxed = raw.withColumn("__v", F.expr("try_parse_json(concat('[', record, ']'))"))
    boxed = boxed.withColumn("__o", F.expr("try_variant_get(__v, '$[0]', 'variant')")).where(
        F.col("record").rlike(r"^[ \t\r\n]*\{") & F.expr("__o is not null and try_variant_get(__v, '$[1]', 'variant') is null")
    )
    return boxed.withColumn("__text", F.when(F.col("record").rlike(_NESTED), F.from_json("record", "map<string,string>"))).drop("__v")


def _kind(schema: Column, text: Column) -> Column:
    return (
        F.when(schema == "VOID", F.lit(None))
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when((schema == "BIGINT") | text.rlike("^-?[0-9]{19,}$"), "integer")
        .otherwise("number")
    )


def field_rows(raw: DataFrame) -> DataFrame:
    """(stream_id, file_seq, line_no, rec_uid, field, kind, text), one row per top-level field.

    raw: stream_id, file_seq, line_no, rec_uid, record. Lines that are null, empty or no JSON object give no row;
    a JSON null gives a row with null kind and text. Numbers are written plainly: 1.50 as 1.5, 1e2 as 100.0, 200.0 as itself.
    Other columns of `raw` are ignored.
    """
    spark = raw.sparkSession
    p = _parsed(raw.select("stream_id", "file_seq", "line_no", "rec_uid", "record"))
    wide = p.lateralJoin(spark.tvf.variant_explode(F.col("__o").outer()))
    schema = F.expr("schema_of_variant(value)")
    plain = F.expr("to_json(value)")
    whole = schema.startswith("DECIMAL") & plain.rlike("^-?[0-9]{1,18}$")  # written with a point
    own = F.when(schema == "STRING", F.expr("try_variant_get(value, '$', 'string')")).when(whole, F.concat(plain, F.lit(".0"))).otherwise(plain)
    text = F.when(schema != "VOID", F.coalesce(F.when(schema.startswith("OBJECT") | schema.startswith("ARRAY"), F.element_at("__text", F.col("key"))), own))
    return wide.select("stream_id", "file_seq", "line_no", "rec_uid", F.col("key").alias("field"), _kind(schema, text).alias("kind"), text.alias("text"))


def file_order(raw: DataFrame) -> DataFrame:
    """(stream_id, file_seq, ord, n_files): the files of each stream, counted from 1 without gaps."""
    files = raw.select("stream_id", "file_seq").distinct()
    w = Window.partitionBy("stream_id")
    return files.select("stream_id", "file_seq", F.row_number().over(w.orderBy("file_seq")).alias("ord"), F.count("*").over(w).alias("n_files"))


def lifespans(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(stream_id, field, kinds, life, island, first_ord, last_ord, n_files): the catalogue.

    An island is a run of successive files in which a field has one set of non-null types; a life is a run in which it is there.
    Both are counted from 1 by stream and field. Rows are first counted by file, so that no field's rows are gathered.
    """
    here = rows.groupBy("stream_id", "file_seq", "field").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).join(files, ["stream_id", "file_seq"])
    w = Window.partitionBy("stream_id", "field").orderBy("ord")
    starts = F.coalesce(F.lag("ord").over(w), F.lit(-1)) != F.col("ord") - 1
    marked = here.withColumn("starts", starts).withColumn("turns", F.col("starts") | (F.lag("kinds").over(w) != F.col("kinds")))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("life", F.sum(F.col("starts").cast("int")).over(so_far)).withColumn("island", F.sum(F.col("turns").cast("int")).over(so_far))
    return marked.groupBy("stream_id", "field", "life", "island", "n_files").agg(F.first("kinds").alias("kinds"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


def _steps(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(starts, endings, turns) of a catalogue: (stream_id, ord, field, life, kinds), at the file where the field is first (no longer) there, or of other types."""
    w = Window.partitionBy("stream_id", "field").orderBy("first_ord")
    wide = spans.withColumns({"before": F.lag("last_ord").over(w), "old": F.lag("kinds").over(w), "after": F.lead("first_ord").over(w)})
    starts = wide.where("first_ord > 1 and (before is null or before < first_ord - 1)").select("stream_id", F.col("first_ord").alias("ord"), "field", "life", "kinds")
    endings = wide.where("last_ord < n_files and (after is null or after > last_ord + 1)").select("stream_id", (F.col("last_ord") + 1).alias("ord"), "field", "life", "kinds")
    turns = wide.where("before = first_ord - 1 and size(old) > 0 and size(kinds) > 0").select("stream_id", F.col("first_ord").alias("ord"), "field", "life", "kinds")
    return starts, endings, turns


def renames(rows: DataFrame, files: DataFrame, spans: DataFrame) -> DataFrame:
    """(stream_id, ord, old, new, old_life, new_life, old_kinds, new_kinds): endings and starts at one file that show the same values.

    A pair counts if some record (rec_uid) that stands in both files has the old field non-null, and in all such the new one
    has the same text. Records with a null rec_uid are no evidence. If several pairs fit, each is here.
    """
    starts, endings, _ = _steps(spans)
    come = starts.select("stream_id", "ord", F.col("field").alias("new"), F.col("life").alias("new_life"), F.col("kinds").alias("new_kinds"))
    gone = endings.select("stream_id", "ord", F.col("field").alias("old"), F.col("life").alias("old_life"), F.col("kinds").alias("old_kinds"))
    both = gone.select("stream_id", "ord").intersect(come.select("stream_id", "ord"))
    numbered = rows.where("rec_uid is not null").join(files.drop("n_files"), ["stream_id", "file_seq"])
    key = ["stream_id", "ord", "rec_uid"]
    wanted = gone.join(both, ["stream_id", "ord"], "left_semi").select("stream_id", "ord", "old")
    before = numbered.where("text is not null").withColumn("ord", F.col("ord") + 1).withColumnRenamed("field", "old")
    old_values = before.join(wanted, ["stream_id", "ord", "old"]).select(*key, "old", F.col("text").alias("old_text")).distinct()
    in_both = old_values.join(numbered.select(*key), key, "left_semi")
    wanted = come.join(both, ["stream_id", "ord"], "left_semi").select("stream_id", "ord", "new")
    new_values = numbered.withColumnRenamed("field", "new").join(wanted, ["stream_id", "ord", "new"]).where("text is not null").select(*key, "new", F.col("text").alias("new_text")).distinct()
    needed = in_both.groupBy("stream_id", "ord", "old").agg(F.count("*").alias("needed"))
    equal = in_both.join(new_values, key).where("old_text = new_text").groupBy("stream_id", "ord", "old", "new").agg(F.count("*").alias("equal"))
    fit = equal.join(needed, ["stream_id", "ord", "old"]).where("equal = needed").select("stream_id", "ord", "old", "new")
    return fit.join(gone, ["stream_id", "ord", "old"]).join(come, ["stream_id", "ord", "new"])


def _read(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = materialize(field_rows(raw), "fields")
    files = materialize(file_order(raw), "files")
    spans = materialize(lifespans(rows, files), "spans")
    return rows, files, spans, materialize(renames(rows, files, spans), "renamed")


def schema_changes(raw: DataFrame) -> DataFrame:
    """(stream_id, file_seq, change_kind, field, new_field): each file against the one before in its stream.

    `renamed` as in `renames`; other starts and endings are `added` and `removed`. `type_changed` compares the sets of JSON
    kinds over non-null values. Empty input gives no row.
    """
    _, files, spans, renamed = _read(raw)
    starts, endings, turns = _steps(spans)
    none = F.lit("")
    differ = "size(old_kinds) > 0 and size(new_kinds) > 0 and old_kinds != new_kinds"
    old, new = (renamed.select("stream_id", "ord", F.col(c).alias("field")) for c in ("old", "new"))
    parts = [
        renamed.select("stream_id", "ord", F.lit("renamed").alias("change_kind"), F.col("old").alias("field"), F.col("new").alias("new_field")),
        endings.join(old, ["stream_id", "ord", "field"], "left_anti").select("stream_id", "ord", F.lit("removed"), "field", none),
        starts.join(new, ["stream_id", "ord", "field"], "left_anti").select("stream_id", "ord", F.lit("added"), "field", none),
        turns.select("stream_id", "ord", F.lit("type_changed"), "field", none),
        renamed.where(differ).select("stream_id", "ord", F.lit("type_changed"), "new", none),
    ]
    log = parts[0]
    for p in parts[1:]:
        log = log.union(p)
    return log.join(files.drop("n_files"), ["stream_id", "ord"]).select("stream_id", "file_seq", "change_kind", "field", "new_field").distinct()


def catalogue(raw: DataFrame) -> DataFrame:
    """(stream_id, field, kinds, first_seq, last_seq): where each field lives with which types, by file numbers."""
    rows = field_rows(raw)
    files = materialize(file_order(raw), "files")
    spans = lifespans(rows, files)
    first, last = (files.select("stream_id", F.col("ord").alias(f"{n}_ord"), F.col("file_seq").alias(f"{n}_seq")) for n in ("first", "last"))
    return spans.join(first, ["stream_id", "first_ord"]).join(last, ["stream_id", "last_ord"]).select("stream_id", "field", F.array_join("kinds", " ").alias("kinds"), "first_seq", "last_seq")


def _jumped(back: DataFrame, key: list[str], to: list[str], longest: int) -> DataFrame:
    """The end of every chain of links key -> to, by pointer jumping; chains have no circle and at most `longest` links."""
    step = back.select(*(F.col(k).alias(t) for k, t in zip(key, to)), *(F.col(t).alias(f"__{t}") for t in to))
    for _ in range(max(longest, 1).bit_length()):
        back = materialize(back.join(step, to, "left").select(*key, *(F.coalesce(f"__{t}", t).alias(t) for t in to)), "jump")
        step = back.select(*(F.col(k).alias(t) for k, t in zip(key, to)), *(F.col(t).alias(f"__{t}") for t in to))
    return back


def alias_table(spans: DataFrame, renamed: DataFrame) -> DataFrame:
    """(stream_id, field, life, first_ord, last_ord, name): the column each life of a field belongs to.

    Within a stream a life that a rename started goes on with the life it came from (of several pairs the alphabetically first
    old, then new name), so a chain ends at its oldest name, however long it is, and a name given back and forth is followed life
    by life. Between streams, a lineage is called like the name its own was most often renamed from (ties: alphabet), if that
    is the older one (by first file, then alphabet): chains of names cannot circle. Where two lineages of a stream would
    live in one column at once, each keeps its own oldest name; where even that is shared, the later one is numbered
    (`name__2`). So no record has two values for one column.
    """
    lives = materialize(spans.groupBy("stream_id", "field", "life").agg(F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord")), "lives")
    by_new = Window.partitionBy("stream_id", "new", "new_life").orderBy("old")
    by_old = Window.partitionBy("stream_id", "old", "old_life").orderBy("new")
    links = renamed.withColumn("r", F.row_number().over(by_new)).where("r = 1").withColumn("r", F.row_number().over(by_old)).where("r = 1")
    links = links.select("stream_id", F.col("new").alias("field"), F.col("new_life").alias("life"), F.col("old").alias("root"), F.col("old_life").alias("root_life"))
    longest = lives.agg(F.max("last_ord")).first()[0] or 1
    back = _jumped(links.withColumn("root_stream", F.col("stream_id")), ["stream_id", "field", "life"], ["root_stream", "root", "root_life"], longest).drop("root_stream")
    whole = lives.join(back, ["stream_id", "field", "life"], "left").withColumns({"root": F.coalesce("root", "field"), "root_life": F.coalesce("root_life", "life")})
    lineages = whole.groupBy("stream_id", "root", "root_life").agg(F.min("first_ord").alias("a"), F.max("last_ord").alias("z"))

    age = lives.groupBy("field").agg(F.min("first_ord").alias("age"))
    pairs = renamed.groupBy("old", "new").agg(F.count("*").alias("n"))
    pairs = pairs.join(age.select(F.col("field").alias("old"), F.col("age").alias("old_age")), "old").join(age.select(F.col("field").alias("new"), F.col("age").alias("new_age")), "new")
    w = Window.partitionBy("new").orderBy(F.desc("n"), "old")
    older = pairs.where("old_age < new_age or (old_age = new_age and old < new)").withColumn("r", F.row_number().over(w)).where("r = 1")
    older = older.select(F.col("new").alias("root"), F.col("old").alias("name"))
    names = _jumped(older, ["root"], ["name"], older.count())
    named = materialize(lineages.join(names, "root", "left").withColumn("name", F.coalesce("name", "root")), "named")

    def clash(df: DataFrame, column: str) -> DataFrame:
        # sorted by start, a lineage meets an earlier or later one if the furthest end before it, or the next start behind it, lies inside
        w = Window.partitionBy("stream_id", column).orderBy("a", "z", "root", "root_life")
        far = F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("meets", F.coalesce(far >= F.col("a"), F.lit(False)) | F.coalesce(F.lead("a").over(w) <= F.col("z"), F.lit(False))).withColumn("nth", F.row_number().over(w))

    own = clash(named, "name").withColumn("name", F.when(F.col("meets"), F.col("root")).otherwise(F.col("name"))).drop("meets", "nth")
    number = F.when(F.col("meets") & (F.col("nth") > 1), F.concat_ws("__", "name", F.col("nth").cast("string"))).otherwise(F.col("name"))
    last = clash(own, "name").withColumn("name", number).drop("meets", "nth")
    last = clash(last, "name").withColumn("name", number)  # a field may be called like a numbered one
    return whole.join(last.select("stream_id", "root", "root_life", "name"), ["stream_id", "root", "root_life"]).select("stream_id", "field", "life", "first_ord", "last_ord", "name")


def _cells(raw: DataFrame) -> DataFrame:
    rows, files, spans, renamed = _read(raw)
    alias = materialize(alias_table(spans, renamed), "alias")
    numbered = rows.join(files.drop("n_files"), ["stream_id", "file_seq"])
    return numbered.join(alias, ["stream_id", "field"]).where("ord between first_ord and last_ord").select("stream_id", "file_seq", "line_no", "rec_uid", "field", "name", "kind", "text")


def aliases(raw: DataFrame) -> DataFrame:
    """(stream_id, field, first_seq, last_seq, name): `alias_table` by file numbers."""
    _, files, spans, renamed = _read(raw)
    first, last = (files.select("stream_id", F.col("ord").alias(f"{n}_ord"), F.col("file_seq").alias(f"{n}_seq")) for n in ("first", "last"))
    return alias_table(spans, renamed).join(first, ["stream_id", "first_ord"]).join(last, ["stream_id", "last_ord"]).select("stream_id", "field", "first_seq", "last_seq", "name")


def cells(raw: DataFrame) -> DataFrame:
    """(stream_id, file_seq, line_no, name, text): the consistent table in long form, without its casts; nulls give no cell."""
    return _cells(raw).where("text is not null").select("stream_id", "file_seq", "line_no", "name", "text")


def consistent_table(raw: DataFrame) -> DataFrame:
    """One row per JSON object with one column per lineage of fields, named as in `alias_table`.

    A column's type: `bigint`, `double`, `boolean` where all its kinds allow, else `string`; values are brought to it by
    try_cast from their text. Of repeated objects all are kept. The columns follow the names in the data; one that is taken,
    case aside, is numbered.
    """
    rows = materialize(_cells(raw), "cells")
    kinds = {}
    for name, found in rows.groupBy("name").agg(F.collect_set("kind")).limit(MOST_FIELDS + 1).toLocalIterator():
        kinds[name] = set(found)
    if len(kinds) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} columns")
    entry = F.when(F.col("text").isNotNull(), F.struct("name", "text"))
    entries = rows.groupBy("stream_id", "file_seq", "line_no").agg(F.first("rec_uid", True).alias("rec_uid"), F.map_from_entries(F.collect_list(entry)).alias("m"))
    taken, columns = {"stream_id", "file_seq", "line_no", "rec_uid"}, []
    for name, found in sorted(kinds.items()):
        kind = "string" if not found else "bigint" if found <= {"integer"} else "double" if found <= {"integer", "number"} else "boolean" if found == {"boolean"} else "string"
        free, k = name, 1
        while free.lower() in taken:
            k += 1
            free = f"{name}_in_record" if k == 2 and name in ("stream_id", "file_seq", "line_no", "rec_uid") else f"{name}__{k}"
        taken.add(free.lower())
        columns.append(F.expr(f"try_cast(m[{_sql(name)}] as {kind})").alias(free))
    return entries.select("stream_id", "file_seq", "line_no", "rec_uid", *columns)


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
