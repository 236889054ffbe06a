"""The entity registry: lookup join, grading of names, search, pivot, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grades from strong to weak (fixed values).
GRADES = ("exact", "hull", "name", "generic", "stale")
LEAST_LETTERS = 4


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]+"), lambda t: t != "")


def hull_numbers(hull: Column) -> Column:
    """The runs of digits of a hull code, also without leading zeros."""
    runs = F.regexp_extract_all(F.coalesce(hull, F.lit("")), F.lit(r"(\d+)"))
    return F.filter(F.array_union(runs, F.transform(runs, lambda r: F.regexp_replace(r, "^0+", ""))), lambda t: t != "")


def grade(broadcast: Column, expected: Column, name: Column, hull: Column, cot_type: Column, *, generic: tuple[str, ...] = (), markers: tuple[str, ...] = (), military_cot: str | None = None) -> Column:
    """How well a broadcast name fits a registry entry; one of ``GRADES``.

    ``exact``: the expected name.  ``hull``: a token is one of the hull's numbers.
    ``name``: the distinctive tokens, of four letters together at least, are all in the
    entry's name.  ``generic``: no distinctive token, but a marker, and a military entry.
    """
    live = F.upper(F.trim(F.coalesce(broadcast, F.lit(""))))
    own = tokens(live)
    wanted = F.upper(F.trim(F.coalesce(expected, F.lit(""))))
    strings = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    distinctive = F.filter(own, lambda t: ~F.array_contains(strings(generic), t)) if generic else own
    letters = F.aggregate(distinctive, F.lit(0), lambda n, t: n + F.length(t))
    named = (letters >= LEAST_LETTERS) & (F.size(F.array_except(distinctive, tokens(name))) == 0)
    military = hull.isNotNull()
    if military_cot:
        military = military | F.coalesce(cot_type.rlike(military_cot), F.lit(False))
    return (
        F.when(live == "", "stale")
        .when((wanted != "") & (wanted == live), "exact")
        .when(hull.isNotNull() & F.arrays_overlap(own, hull_numbers(hull)), "hull")
        .when((F.size(distinctive) > 0) & named, "name")
        .when(F.size(distinctive) > 0, "stale")
        .when(F.arrays_overlap(own, strings(markers)) & military, "generic")
        .otherwise("stale")
    )


def link(reports: DataFrame, identifiers: DataFrame, entities: DataFrame, *, row: str, key: str, name: str, **options) -> DataFrame:
    """Each report with its entity: the strongest grade over its identifiers, ties to the smaller id.

    ``reports`` hold an identifier ``key`` ("scheme:value") and a broadcast ``name``;
    ``identifiers`` are (key, entity_id, expected_name), ``entities`` (entity_id,
    entity_name, hull, cot_type).  An equi-join: Spark broadcasts the registry while its
    statistics say that it is small and shuffles it beyond that.  Reports without a match stay.
    """
    entries = identifiers.withColumnRenamed("key", "_key").join(entities, "entity_id")
    met = reports.join(entries, F.col(key) == F.col("_key"), "left")
    graded = met.withColumn("grade", F.when(F.col("entity_id").isNotNull(), grade(F.col(name), F.col("expected_name"), F.col("entity_name"), F.col("hull"), F.col("cot_type"), **options)))
    order = F.array_position(F.array(*map(F.lit, GRADES)), F.col("grade"))
    best = F.row_number().over(Window.partitionBy(row).orderBy(F.asc_nulls_last(order), "entity_id"))
    return graded.withColumn("_best", best).where("_best = 1").drop("_best", "_key")


def search(entities: DataFrame, identifiers: DataFrame, needle: str, *, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of entities whose name, id or any identifier holds ``needle``, in either case, with the total."""
    text = needle.lower()
    by_id = identifiers.where(F.lower("value").contains(text)).select("entity_id").distinct().withColumn("_hit", F.lit(True))
    found = entities.join(by_id, "entity_id", "left").where(F.col("_hit").isNotNull() | F.lower("entity_name").contains(text) | F.lower(F.col("entity_id").cast("string")).contains(text)).drop("_hit")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("entity_name", "entity_id").offset(offset).limit(limit).join(total)


def sheet(entities: DataFrame, identifiers: DataFrame, schemes: list[str]) -> DataFrame:
    """One row for each entity, identifiers of a scheme in one column, joined by "; "."""
    wide = identifiers.groupBy("entity_id").pivot("scheme", schemes).agg(F.array_join(F.array_sort(F.collect_set("value")), "; "))
    return entities.join(wide.select("entity_id", *(F.nullif(F.col(f"`{s}`"), F.lit("")).alias(f"id:{s}") for s in schemes)), "entity_id", "left")


def unsheet(wide: DataFrame, schemes: list[str]) -> DataFrame:
    """The identifiers of a sheet: rows (entity_id, scheme, value)."""
    stack = F.explode(F.array(*(F.struct(F.lit(s).alias("scheme"), F.col(f"`id:{s}`").alias("all")) for s in schemes)))
    each = wide.select("entity_id", stack.alias("i")).select("entity_id", "i.scheme", F.explode(F.split("i.all", "; *")).alias("value"))
    return each.where("trim(value) <> ''").withColumn("value", F.trim("value"))


def first_holder(identifiers: DataFrame, order: str) -> DataFrame:
    """Of several entities that claim an identifier the first, with the number of claims."""
    by = Window.partitionBy("scheme", "value")
    return identifiers.withColumn("_n", F.row_number().over(by.orderBy(order, "entity_id"))).withColumn("claims", F.count("*").over(by)).where("_n = 1").drop("_n")


def apply_entity(df: DataFrame, links: dict[str, str], corroborated: str) -> DataFrame:
    """Fields of a report from its entity (M12), with what they replace in ``overrides``.

    ``links``: field of the report -> column of the entity, both in ``df``.  Only where
    ``corroborated``; an entity without a value changes nothing.  An override is kept where
    the feed reported another value: (field, reported, entity), as text, in order of ``links``.
    """
    takes = {f: F.col(corroborated) & F.col(e).isNotNull() for f, e in links.items()}
    text = lambda c: F.col(c).cast("string")
    over = [F.when(takes[f] & (text(f) != text(e)), F.struct(F.lit(f).alias("field"), text(f).alias("reported"), text(e).alias("entity"))) for f, e in links.items()]
    marked = df.withColumn("overrides", F.array_compact(F.array(*over)))
    return marked.withColumns({f: F.when(takes[f], F.col(e)).otherwise(F.col(f)) for f, e in links.items()})


def put_back(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields as the feed reported them, where ``overrides`` says so."""
    kinds = dict(df.dtypes)
    said = lambda f: F.get(F.filter("overrides", lambda o: o["field"] == f), 0)["reported"]
    return df.withColumns({f: F.coalesce(said(f).cast(kinds[f]), F.col(f)) for f in fields})


def reapplied(state: DataFrame, saved: DataFrame, links: dict[str, str], corroborated: str) -> DataFrame:
    """The reports that an edit of entities changes, as they are now.

    ``state``: reports with entity_id and overrides, as ``apply_entity`` left them; ``saved``:
    the entities that were saved.  A delta join: tracks of other entities are not touched.
    What the feed reported is put back first, then the entity applied anew.
    """
    met = state.join(saved, "entity_id").withColumn("_was", F.struct(*links, "overrides"))
    now = apply_entity(put_back(met, list(links)), links, corroborated)
    changed = ~F.col("_was").eqNullSafe(F.struct(*links, "overrides"))
    return now.where(changed).select(*state.columns)


#: Letters of an entity id (fixed values).
_ENTITY_ID = r"^[A-Za-z0-9._:-]{1,64}\z"


def matched_sheet(rows: DataFrame, identifiers: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an imported sheet does to the registry, and its conflicts.

    ``rows``: row, entity_id (null: none given), keys (array of "scheme:value"); ``identifiers``:
    key, entity_id, one holder each; ``entities``: entity_id.  The first table is (row, target,
    known): a row goes to the entity of its id, else to the only holder of its identifiers, else
    to a new one ("new-<row>"); known: that entity exists.  The second is (row, kind, detail): an
    id that is none, identifiers of different entities, an identifier that another entity holds,
    an entity or identifier that an earlier row of the sheet names.  Nothing but joins, grouping
    by row and windows by entity and by identifier.
    """
    own = rows.select("row", F.nullif(F.trim("entity_id"), F.lit("")).alias("given"), F.array_distinct(F.coalesce("keys", F.array().cast("array<string>"))).alias("keys"))
    each = own.select("row", F.explode("keys").alias("key")).join(identifiers.select("key", F.col("entity_id").alias("holder")), "key", "left")
    owners = each.groupBy("row").agg(F.array_sort(F.collect_set("holder")).alias("owners"))
    valid = F.col("given").rlike(_ENTITY_ID)
    seen = own.join(owners, "row", "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))
    found = seen.withColumn("wanted", F.when(F.col("given").isNull(), F.when(F.size("owners") == 1, F.get("owners", 0))).when(valid, F.col("given")))
    known = entities.select(F.col("entity_id").alias("wanted"), F.lit(True).alias("exists"))
    plan = found.join(known, "wanted", "left").withColumns({"target": F.coalesce(F.when(F.col("exists"), F.col("wanted")), "given", F.concat(F.lit("new-"), F.col("row").cast("string"))), "known": F.coalesce("exists", F.lit(False))})

    to = lambda df, kind, detail: df.select("row", F.lit(kind).alias("kind"), detail.alias("detail"))
    held = each.where("holder is not null").join(plan.select("row", "target"), "row").where("holder <> target")
    before = lambda name: F.lag("row").over(Window.partitionBy(name).orderBy("row"))
    again = plan.withColumn("first", before("target")).where("first is not null")
    twice = each.withColumn("first", before("key")).where("first is not null")
    conflicts = (
        to(plan.where(F.col("given").isNotNull() & ~valid), "entity_id", F.col("given"))
        .union(to(plan.where(F.col("given").isNull() & (F.size("owners") > 1)), "different_entities", F.array_join("owners", ",")))
        .union(to(held, "held", F.concat("key", F.lit(" by "), "holder")))
        .union(to(again, "entity_again", F.concat("target", F.lit(" in row "), F.col("first").cast("string"))))
        .union(to(twice, "identifier_again", F.concat("key", F.lit(" in row "), F.col("first").cast("string"))))
    )
    return plan.select("row", "target", "known"), conflicts
