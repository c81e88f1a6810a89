"""Reviewed registries: contracts of rows, differences from what is stored, all-or-nothing plans, backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.plans.diffs import mark_duplicates


def alias_errors(aliases: DataFrame, rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(alias_id, errors): all that is wrong with each alias row, joined by ","; rows without fault are left out.

    aliases: alias_id, target, name, kind, status, canonical. rows: id, decision, canonical. Where the target
    is missing nothing else is looked at; its own faults exclude each other: absent, not approved, other canonical name.
    """
    targets = rows.select(F.col("id").alias("target"), "decision", F.col("canonical").alias("own"), F.lit(True).alias("known"))
    marked = mark_duplicates(aliases.withColumns({c: F.coalesce(c, F.lit("")) for c in ("target", "name")}), {"twice": ["target", "name"]}).join(targets, "target", "left")
    c = F.col
    # The error codes, which reviewers read.
    fault = F.when(c("known").isNull(), "ALIAS_TARGET_ABSENT").when(~c("decision").eqNullSafe(F.lit("APPROVE")), "ALIAS_TARGET_NOT_APPROVE").when(~c("canonical").eqNullSafe(c("own")), "ALIAS_CANONICAL_MISMATCH")
    found = F.when(c("target") == "", F.array(F.lit("ALIAS_TARGET_MISSING"))).otherwise(
        F.array_compact(F.array(
            F.when(c("name") == "", "ALIAS_NAME_BLANK"), F.when(~F.coalesce(c("kind").isin(*kinds), F.lit(False)), "INVALID_ALIAS_KIND"),
            F.when(~c("status").eqNullSafe(F.lit("APPROVED")), "ALIAS_REVIEW_STATUS_NOT_APPROVED"), fault, F.when(c("twice") & (c("name") != ""), "DUPLICATE_ALIAS"),
        ))
    )
    return marked.select("alias_id", F.array_join(found, ",").alias("errors")).filter("errors <> ''")


def registry_diff(wanted: DataFrame, persons: DataFrame, bindings: DataFrame) -> DataFrame:
    """(key, status) of a wanted registry against the stored one: CREATE, UPDATE, NOOP, or a blocker: MISSING_PERSON, BOUND_ELSEWHERE, UNEXPECTED_BINDING.

    wanted: key, person_id (null: to be created), name. persons: person_id, name. bindings: key, person_id.
    """
    now = persons.select("person_id", F.col("name").alias("now"), F.lit(True).alias("there"))
    bound = bindings.select("key", F.col("person_id").alias("bound"), F.lit(True).alias("is_bound"))
    rows = wanted.withColumn("wanted", F.lit(True)).join(bound, "key", "full").join(now, "person_id", "left")
    c = F.col
    status = (
        F.when(c("wanted").isNull(), "UNEXPECTED_BINDING").when(c("person_id").isNotNull() & c("there").isNull(), "MISSING_PERSON")
        .when(c("is_bound") & ~c("bound").eqNullSafe(c("person_id")), "BOUND_ELSEWHERE").when(c("person_id").isNull(), "CREATE").when(c("name") != c("now"), "UPDATE").otherwise("NOOP")
    )
    return rows.select("key", status.alias("status"))


def all_or_none(frozen: DataFrame, present: DataFrame, links: DataFrame, pending: DataFrame) -> DataFrame:
    """(state, found, links, pending) of a plan to delete frozen rows (id, name): ALL_PRESENT, ALL_ABSENT, or BLOCKED where some are left, are linked or are suggested.

    present: id, name, both of which must be as frozen. links: id. pending: name.
    """
    found = frozen.join(present, ["id", "name"], "left_semi").agg(F.count(F.lit(1)).alias("found"))
    changed = present.join(frozen.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("left"))
    linked = links.join(frozen.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("links"))
    asked = pending.join(frozen.select("name"), "name", "left_semi").agg(F.count(F.lit(1)).alias("pending"))
    total = frozen.agg(F.count(F.lit(1)).alias("total"))
    row = found.crossJoin(changed).crossJoin(linked).crossJoin(asked).crossJoin(total)  # one row each
    c = F.col
    state = (
        F.when((c("links") > 0) | (c("pending") > 0), "BLOCKED").when((c("found") == c("total")) & (c("left") == c("total")), "ALL_PRESENT").when(c("left") == 0, "ALL_ABSENT").otherwise("BLOCKED")
    )
    return row.select(state.alias("state"), "found", "links", "pending")


def tag_plan(frozen: DataFrame, tagged: DataFrame, linked: DataFrame) -> DataFrame:
    """(item_id, person_id, status) of a frozen map (tag, person_id) over tagged items (item_id, tag): PLANNED, or PRESENT where the item has the person (item_id, person_id)."""
    wanted = tagged.join(frozen, "tag").select("item_id", "person_id").distinct()
    known = linked.select("item_id", "person_id").distinct().withColumn("known", F.lit(True))
    return wanted.join(known, ["item_id", "person_id"], "left").select("item_id", "person_id", F.when(F.col("known"), "PRESENT").otherwise("PLANNED").alias("status"))


def fingerprint_of(rows: DataFrame) -> DataFrame:
    """(n, fingerprint) of a table: a sum of row hashes, which no order or partitioning changes."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("fingerprint"))


def guarded_insert(stored: DataFrame, new: DataFrame, key: list[str], protected: DataFrame) -> DataFrame:
    """`stored` with the rows of `new` whose key it lacks; refused if a row of `protected` would not be there afterwards as before."""
    after = stored.unionByName(new.dropDuplicates(key).join(stored.select(*key), key, "left_anti").select(*stored.columns))
    kept = after.join(protected.select(*key), key, "left_semi").select(*protected.columns)
    if fingerprint_of(kept).first() != fingerprint_of(protected).first():
        raise ValueError("protected rows would change")
    return after


def geometry_repair(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """(snapshot, state) of a newer reading of stored lines: REFUSED where text or offsets differ, ALREADY_APPLIED where the polygons are the same, else READY_TO_APPLY.

    Both: snapshot, page, position, char_start, char_end, text, polygon.
    """
    keys = ["snapshot", "page", "position"]
    fields = ("char_start", "char_end", "text", "polygon")
    a = stored.select(*keys, *[F.col(c).alias(f"a_{c}") for c in fields], F.lit(True).alias("in_a"))
    b = parsed.select(*keys, *[F.col(c).alias(f"b_{c}") for c in fields], F.lit(True).alias("in_b"))
    both = a.join(b, keys, "full")
    same = lambda c: F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    changed = F.bool_or(F.col("in_a").isNull() | F.col("in_b").isNull() | ~(same("char_start") & same("char_end") & same("text")))
    state = F.when(changed, "REFUSED").when(F.bool_and(same("polygon")), "ALREADY_APPLIED").otherwise("READY_TO_APPLY")
    return both.groupBy("snapshot").agg(state.alias("state"))


def operation_error(raw: Column) -> Column:
    """First thing wrong with one operation in JSON: object, id, op, document_id, unknown_field, missing_field; null for a good one.

    Operations are create_person (local_person_ref, canonical_name), add_alias (person_ref, alias) and link_photo (photo_id, person_ref).
    """
    fields = {"create_person": ("local_person_ref", "canonical_name"), "add_alias": ("person_ref", "alias"), "link_photo": ("photo_id", "person_ref")}
    keys = F.json_object_keys(raw)
    values = F.from_json(raw, "map<string,string>")
    filled = lambda name: F.coalesce(F.try_element_at(values, F.lit(name)).rlike("\\S"), F.lit(False))
    op = F.trim(F.try_element_at(values, F.lit("op")))
    error = F.when(keys.isNull(), "object").when(~filled("id"), "id").when(~F.coalesce(op.isin(*fields), F.lit(False)), "op").when(F.array_contains(keys, "document_id"), "document_id")
    for name, own in fields.items():
        allowed = F.array(*map(F.lit, ("id", "op", *own)))
        missing = F.lit(False)
        for f in own:
            missing = missing | ~filled(f)
        error = error.when((op == name) & (F.size(F.array_except(keys, allowed)) > 0), "unknown_field").when((op == name) & missing, "missing_field")
    return error


def with_engine(rows: DataFrame, **columns: str) -> DataFrame:
    """Columns that all rows get with one value, where they have none."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in columns.items()})


def items_for(documents: DataFrame, shared: list[str]) -> DataFrame:
    """Items for documents (document_id, item_id, …) that have none: the shared columns and both timestamps go over, the id is the document's."""
    return documents.filter("item_id IS NULL").select(F.col("document_id").alias("item_id"), *shared, "created_at", "updated_at")


def translation_bases(results: DataFrame) -> DataFrame:
    """(result_id, based_on) of translations: the revision of the same engine's newest source text of the document. results: result_id, document_id, engine, result_type, revision."""
    sources = results.filter("result_type = 'SOURCE_TEXT'").groupBy("document_id", "engine").agg(F.max_by("revision", "result_id").alias("based_on"))
    return results.filter("result_type = 'HEBREW_TEXT'").join(sources, ["document_id", "engine"], "left").select("result_id", "based_on")
