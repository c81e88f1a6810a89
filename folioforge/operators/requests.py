"""Requests, runs and results: which may go on, which are stale, which are the latest of their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses of upload runs and of requests.
REUSABLE = ("FAILED", "UPLOADED", "RECOGNITION_STARTED")
BLOCKING = ("STARTED", "UPLOADED", "RECOGNITION_STARTED", "SUCCEEDED")
TERMINAL = ("COMPLETED", "PARTIAL", "FAILED")
ABANDONED = "STAFF_ABANDONED"
#: Slugs of type tabs, and the item types that each shows.
TYPE_TABS = {"documents_and_texts": ("DOCUMENT", "TEXT"), "photo": ("PHOTO",), "video": ("VIDEO",)}


def type_tab(raw: Column) -> Column:
    """A type slug in normal form; '', which is all, for what is blank or unknown."""
    clean = F.lower(F.trim(raw))
    return F.when(clean.isin(*TYPE_TABS), clean).otherwise("")


def of_tab(items: DataFrame, slug: str) -> DataFrame:
    """Items of a type tab; a slug that is none shows all."""
    return items.filter(F.col("item_type").isin(*TYPE_TABS[slug])) if slug in TYPE_TABS else items


def positive_ids(raw: Column) -> Column:
    """Positive integers of a comma-separated list, first occurrences in order; anything else is passed over."""
    numbers = F.transform(F.split(raw, ","), lambda x: F.when(F.trim(x).rlike("^\\d{1,18}$"), F.trim(x)).cast("long"))
    return F.array_distinct(F.filter(numbers, lambda x: x > 0))


def year_range(years: Column, years_to: Column) -> Column:
    """(low, high) of the last of each list of raw years; null without a good first year. A bad or earlier second one counts as the first."""
    year = lambda x: F.when(F.element_at(x, -1).rlike("^[0-9]{1,4}$") & (F.element_at(x, -1).cast("int") > 0), F.element_at(x, -1)).cast("int")
    low, high = F.when(F.size(years) > 0, year(years)), F.when(F.size(years_to) > 0, year(years_to))
    return F.when(low.isNotNull(), F.struct(low.alias("low"), F.greatest(low, F.coalesce(high, low)).alias("high")))


def scope(requests: DataFrame, *, ids: list[int] | None = None, documents: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """`requests` (request_id, document_id, …) with `place`: the asked ids in the order asked, each once; or those of the documents; or all, by id."""
    if ids is not None:
        spark = requests.sparkSession
        wanted = spark.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(ids), 1)], "request_id long, place long")
        rows = requests.join(F.broadcast(wanted), "request_id")
    else:
        rows = requests if documents is None else requests.filter(F.col("document_id").isin(*documents))
        rows = rows.withColumn("place", F.col("request_id"))
    rows = rows.orderBy("place")
    return rows.limit(limit) if limit else rows


def recoverable(requests: DataFrame, now: Column, least_age: Column) -> DataFrame:
    """Requests whose message may never have been sent, and that are old enough. requests: request_id, status, enqueued_at, updated_at."""
    unsent = ((F.col("status") == "QUEUED") & F.col("enqueued_at").isNull()) | (F.col("status") == "ENQUEUE_FAILED")
    return requests.filter(unsent & (F.col("updated_at") <= now - least_age)).orderBy("request_id")


def stale_drafts(documents: DataFrame, before: Column) -> DataFrame:
    """Image documents that were begun and never finished: no expected number of files, no file of their own, not uploaded, untouched since `before`."""
    return documents.filter(
        (F.col("kind") == "IMAGE") & F.col("expected_files").isNull() & (F.coalesce("file_key", F.lit("")) == "") & (F.col("item_type") == "DOCUMENT") & (F.col("upload_status") != "UPLOADED") & (F.col("updated_at") < before)
    ).orderBy("updated_at", "document_id")


def stale_extras(files: DataFrame, documents: DataFrame, before: Column) -> DataFrame:
    """Files that are for display only, never arrived, lie beyond the pages of their uploaded document and belong to none that is being processed.

    files: file_id, document_id, position, in_ocr, status, updated_at. documents: document_id, pages, upload_status, busy.
    """
    old = files.filter(~F.col("in_ocr") & F.col("status").isin("PENDING", "FAILED") & (F.col("updated_at") < before))
    idle = documents.filter((F.col("upload_status") == "UPLOADED") & ~F.col("busy")).select("document_id", "pages")
    return old.join(idle, "document_id").filter(F.col("position") >= F.col("pages")).select(*files.columns).orderBy("updated_at", "file_id")


def without_thumbnail(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, source_key): uploaded image documents whose thumbnail key is blank and whose first file has a key.

    documents: document_id, kind, upload_status, thumbnail_key. files: document_id, position, key.
    """
    blank = F.regexp_replace(F.coalesce("thumbnail_key", F.lit("")), "^\\s+|\\s+$", "") == ""
    first = files.filter((F.col("position") == 0) & (F.coalesce("key", F.lit("")) != "")).groupBy("document_id").agg(F.min("key").alias("source_key"))
    return documents.filter((F.col("kind") == "IMAGE") & (F.col("upload_status") == "UPLOADED") & blank).join(first, "document_id").select("document_id", "source_key")


def latest(rows: DataFrame, keys: list[str], order: list[str], where: Column | None = None) -> DataFrame:
    """The row of each key that is last in `order`, of those that meet a condition: a maximum of structs, combined before it is shuffled."""
    rows = rows if where is None else rows.filter(where)
    rest = [c for c in rows.columns if c not in {*keys, *order}]
    found = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return found.select(*keys, *[f"x.{c}" for c in (*order, *rest)])


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).rlike("\\S"), F.lit(False))


def reusable_run() -> Column:
    """A run whose upload another recognition may start from. Runs: status, remote_id, pages."""
    return F.col("status").isin(*REUSABLE) & _filled("remote_id") & _filled("pages")


def blocking_run() -> Column:
    """A run that forbids a new upload: under way or done, or failed after it reached the other side."""
    return F.col("status").isin(*BLOCKING) | ((F.col("status") == "FAILED") & _filled("remote_id"))


def coalesce_outcome(status: Column) -> Column:
    """What a repeated request is told, by the status of the active one."""
    # Outcomes that callers act on.
    return F.when(status == "RUNNING", "ALREADY_RUNNING").when(status == "RECOVERY_REQUIRED", "BLOCKED_RECOVERY_REQUIRED").otherwise("ALREADY_QUEUED")


def abandoned(requests: DataFrame, asked: DataFrame) -> DataFrame:
    """(request_id, outcome, status, failure) of requests that staff give up. asked: request_id, document_id.

    Only a parked request can be given up: it fails with a code of its own. Terminal ones stay as they are.
    """
    rows = asked.select("request_id", F.col("document_id").alias("__asked")).join(requests, "request_id", "left")
    outcome = (
        F.when(F.col("status").isNull(), "REQUEST_NOT_FOUND").when(F.col("document_id") != F.col("__asked"), "DOCUMENT_MISMATCH")
        .when(F.col("status").isin(*TERMINAL), "ALREADY_TERMINAL").when(F.col("status") == "RECOVERY_REQUIRED", "ABANDONED").otherwise("NOT_ABANDONABLE")
    )
    rows = rows.withColumn("outcome", outcome)
    given_up = F.col("outcome") == "ABANDONED"
    return rows.select("request_id", "outcome", F.when(given_up, "FAILED").otherwise(F.col("status")).alias("status"), F.when(given_up, ABANDONED).otherwise(F.col("failure")).alias("failure"))


def retried(requests: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """(request_id, outcome) of retries by staff: PAGE_LEASE_LIVE, ABANDON_AND_ENQUEUE, ENQUEUE or REQUEST_ALREADY_FINISHED, or REQUEST_ACTIVE.

    requests: request_id, document_id, operation, status, failure. leases: document_id, status, lease. Only a
    parked request, or one that staff gave up, makes a new one; for OCR, while no page is leased.
    """
    live = leases.filter((F.col("status") == "RUNNING") & (F.col("lease") > now)).select("document_id").distinct().withColumn("__live", F.lit(True))
    rows = requests.join(live, "document_id", "left")
    parked, given_up = F.col("status") == "RECOVERY_REQUIRED", (F.col("status") == "FAILED") & F.coalesce(F.col("failure") == ABANDONED, F.lit(False))
    outcome = (
        F.when((F.col("operation") == "OCR") & (parked | given_up) & F.col("__live"), "PAGE_LEASE_LIVE").when(parked, "ABANDON_AND_ENQUEUE").when(given_up, "ENQUEUE")
        .when(F.col("status").isin(*TERMINAL), "REQUEST_ALREADY_FINISHED").otherwise("REQUEST_ACTIVE")
    )
    return rows.select("request_id", outcome.alias("outcome"))


def page_claims(claims: DataFrame, checkpoints: DataFrame, attempts: DataFrame, now: Column, first_page: int = 1) -> DataFrame:
    """(attempt, page, action) of claims (attempt, page, fingerprint): OUT_OF_RANGE, FINGERPRINT_MISMATCH, REUSE of what is done, BUSY under a live lease, else RUN.

    checkpoints: attempt, page, fingerprint, status, lease. attempts: attempt, pages. first_page: number of an attempt's first page.
    """
    known = checkpoints.select("attempt", "page", F.col("fingerprint").alias("__print"), "status", "lease")
    rows = claims.join(attempts, "attempt").join(known, ["attempt", "page"], "left")
    outside = (F.col("page") < first_page) | (F.col("page") >= F.col("pages") + first_page)
    action = (
        F.when(outside, "OUT_OF_RANGE").when(F.col("__print") != F.col("fingerprint"), "FINGERPRINT_MISMATCH").when(F.col("status") == "SUCCEEDED", "REUSE")
        .when((F.col("status") == "RUNNING") & (F.col("lease") > now), "BUSY").otherwise("RUN")
    )
    return rows.select("attempt", "page", action.alias("action"))


def whole_transcripts(pages: DataFrame) -> DataFrame:
    """(document, page, transcript) of documents each of whose pages has exactly one transcript; a page with none or several refuses the document.

    pages: document, page, transcript (null: none).
    """
    per_page = pages.groupBy("document", "page").agg(F.count("transcript").alias("n"), F.min("transcript").alias("transcript"))
    refused = per_page.filter("n <> 1").select("document").distinct()
    return per_page.join(refused, "document", "left_anti").select("document", "page", "transcript")


def binding_trust(results: DataFrame, bindings: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(result_id, bound, fresh, hover) of text results and what binds them to a snapshot; anything missing is not fresh.

    results: result_id, document_id, result_type, sha, revision, based_on. bindings: result_id, snapshot_id,
    role, bound_revision, bound_sha. snapshots: snapshot_id, snapshot_document, snapshot_status,
    canonical_sha, hover_eligible. A translation is as fresh as the source revision it rests on.
    """
    rows = results.join(bindings, "result_id", "left").join(snapshots, "snapshot_id", "left")
    c = F.col
    role = F.when(c("result_type") == "SOURCE_TEXT", "SOURCE").when(c("result_type") == "HEBREW_TEXT", "TRANSLATION")
    revision = F.when(c("result_type") == "HEBREW_TEXT", c("based_on")).otherwise(c("revision"))
    fresh = (c("role") == role) & (c("snapshot_document") == c("document_id")) & (c("snapshot_status") == "READY") & (c("bound_sha") == c("canonical_sha"))
    fresh = fresh & (c("bound_revision") >= 1) & (revision == c("bound_revision")) & ((c("result_type") == "HEBREW_TEXT") | (c("sha") == c("bound_sha")))
    fresh = F.coalesce(fresh, F.lit(False))
    return rows.select("result_id", c("role").isNotNull().alias("bound"), fresh.alias("fresh"), (fresh & F.coalesce(c("hover_eligible"), F.lit(False))).alias("hover"))


def bind(bindings: DataFrame, asked: DataFrame, results: DataFrame, snapshots: DataFrame) -> DataFrame:
    """`bindings` after binding `asked` (result_id, snapshot_id, role, bound_revision): one a result, and only to a READY snapshot of its document with the text's SHA, from revision 1 on.

    bindings: result_id, snapshot_id, role, bound_revision. results: result_id, document_id, sha. snapshots: as in `binding_trust`.
    """
    good = asked.join(results, "result_id").join(snapshots, "snapshot_id").filter(
        (F.col("snapshot_status") == "READY") & (F.col("snapshot_document") == F.col("document_id")) & (F.col("sha") == F.col("canonical_sha")) & (F.col("bound_revision") >= 1)
    )
    last = good.groupBy("result_id").agg(F.max(F.struct("bound_revision", "snapshot_id", "role")).alias("x")).select("result_id", "x.snapshot_id", "x.role", "x.bound_revision")
    return bindings.join(last.select("result_id"), "result_id", "left_anti").select(*last.columns).unionByName(last)


def reprocess_error(verified: Column) -> Column:
    """First reason that keeps a document from being processed anew, or null. verified: whether any of its results is verified."""
    return (
        F.when(F.col("upload_status") != "UPLOADED", "not_uploaded").when(~F.col("state").isin("READY", "PARTIAL", "FAILED"), "not_eligible_state").when(F.col("item_id").isNull(), "no_item")
        .when(F.col("item_type") != "DOCUMENT", "not_a_document").when(verified, "has_verified_result")
    )


def messages(requests: DataFrame) -> DataFrame:
    """(body): queue messages of requests, as a stream or a batch."""
    return requests.select(F.to_json(F.struct(F.lit("PROCESS_DOCUMENT").alias("type"), "request_id")).alias("body"))


def dispatched(received: DataFrame, known: tuple[str, ...] = ("PROCESS_DOCUMENT", "SYNC_CORRECTED")) -> DataFrame:
    """Messages (body) with type, request_id and `route`: the type where it is known and the id is a positive integer, else `dead_letter`: such messages are taken off the queue."""
    body = F.from_json("body", "type string, request_id long")
    rows = received.withColumn("__m", body).withColumn("type", F.col("__m.type")).withColumn("request_id", F.col("__m.request_id")).drop("__m")
    good = F.coalesce(F.col("type").isin(*known) & (F.col("request_id") > 0), F.lit(False))
    return rows.withColumn("route", F.when(good, F.col("type")).otherwise("dead_letter"))


def staff_documents(documents: DataFrame, tags: DataFrame, *, admin: bool, text: str = "", **wanted: str) -> DataFrame:
    """The document list, newest first. wanted: values of columns; those for staff alone (upload_status, visibility, metadata_status) are passed over for others.

    text: part of title or category, of a tag (document_id, name), and for staff of the file name or notes.
    A document of several matching tags comes once, as tags are a semi join.
    """
    for name, value in wanted.items():
        if value and (admin or name not in ("upload_status", "visibility", "metadata_status")):
            documents = documents.filter(F.col(name) == value)
    needle = text.strip().lower()
    if needle:
        inside = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
        tagged = tags.filter(inside("name")).select("document_id").distinct().withColumn("__tagged", F.lit(True))
        fields = ["title", "category", *(["file_name", "notes"] if admin else [])]
        some = F.coalesce("__tagged", F.lit(False))
        for f in fields:
            some = some | inside(f)
        documents = documents.join(tagged, "document_id", "left").filter(some).drop("__tagged")
    return documents.orderBy(F.desc("created_at"), F.desc("document_id"))
