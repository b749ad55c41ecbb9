"""Incremental harvest: newly landed pages are upserted batch by batch.

The stream's checkpoint takes the place of resume tokens: an interrupted run continues with the
pages it has not committed.
"""

from datetime import UTC, datetime

from paperlake.operators import harvest
from paperlake.session import cut
from paperlake.sources import inputs
from paperlake.sources.store import Archive


def mark_key(category: str) -> str:
    return f"oai_last_{category}"


def check_errors(spark, landing: str, checkpoint: str) -> None:
    """Fail when a newly landed page is an error answer."""

    def fail(errors, batch_id):
        row = errors.first()
        if row is not None:
            raise ValueError(f"harvest error [{row.code}]: {row.message} ({row.page})")

    errors = inputs.harvest_error_stream(spark, landing)
    query = errors.writeStream.foreachBatch(fail).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def upsert_pages(
    archive: Archive, landing: str, checkpoint: str, categories=None, fetched_at=None,
    strict: bool = False,
) -> dict:
    """Upsert all pages not processed yet. Gives the number of papers submitted per category.

    With `categories`, only records listed in their sets are taken, each from the category's mark
    in the sync state on, and the newest datestamp of each becomes its new mark.
    """
    spark = archive.spark
    check_errors(spark, landing, f"{checkpoint}/errors")
    counts = {"papers": 0}

    def upsert(batch, batch_id):
        records = inputs.with_order(batch)
        marks = {c: archive.get_state(mark_key(c)) for c in categories or []}
        if categories:
            # Parsed once: the papers and the marks are both taken from the written records.
            records = harvest.changed_since(cut(records, "records"), marks)
        papers = harvest.records_to_papers(records, "seq")
        # The stream's own id: a new checkpoint must not be taken for a repeated batch.
        stream = spark.read.schema("id string").json(f"{checkpoint}/records/metadata").first()
        name = f"{stream.id}-{batch_id}"
        time = fetched_at or datetime.now(UTC).replace(tzinfo=None)
        counts["papers"] += archive.upsert_papers(papers, time, name, strict)
        if not categories:
            return
        newest = {}
        for row in harvest.newest_datestamp(records, categories).collect():
            counts[row.category] = counts.get(row.category, 0) + row.records
            newest[mark_key(row.category)] = max(row.datestamp or "", marks[row.category])
        if newest:
            archive.set_state(**newest)

    stream = inputs.harvest_record_stream(spark, landing)
    query = stream.writeStream.foreachBatch(upsert)
    query = query.option("checkpointLocation", f"{checkpoint}/records")
    query.trigger(availableNow=True).start().awaitTermination()
    return counts

