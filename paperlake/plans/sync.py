"""The four sync steps: metadata, full text, embeddings, reference audit."""

import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake import params
from paperlake.functions.ids import full_text_path, primary_category
from paperlake.operators import catalog, embed, graph, harvest
from paperlake.session import counted_cut, cut
from paperlake.sources import inputs, outputs
from paperlake.sources.store import Archive
from paperlake.streaming.harvest import upsert_pages

# The names of the steps, in order.
STEPS = ("metadata", "fulltext", "embed", "refs")
HASHED = "hashed"


def sync_full_text(
    archive: Archive, documents=None, fetch=None, limit="all", separator: str = ","
) -> dict:
    """Store the texts and edges of enrichment documents for papers without full text.

    The documents are either landed ones, of which those of queued papers are taken, or the
    answers of `fetch` for the queued ids.
    """
    papers = archive.papers.read()
    queue = cut(catalog.pending_full_text(papers, limit).select("arxiv_id", "categories"), "queue")
    failed = 0
    if fetch:
        answers = embed.enrich(queue, fetch)
        answers, failed = counted_cut(answers, "answers", F.coalesce(F.sum("failed"), F.lit(0)))
        documents = answers.where(F.col("externalIds.ArXiv") != "")
    elif documents is None:
        raise ValueError("the fulltext step needs documents or fetch")
    else:
        ids = harvest.slim(documents).withColumn("arxiv_id", F.col("externalIds.ArXiv"))
        documents = cut(ids.join(queue.select("arxiv_id"), "arxiv_id", "left_semi"), "documents")

    category = primary_category(F.col("categories"), separator)
    texts = (
        harvest.full_texts(documents)
        .groupBy("arxiv_id")
        .agg(F.max("text").alias("text"))
        .join(queue, "arxiv_id", "left")
        .select("arxiv_id", "text", category.alias("category"))
    )
    texts, fetched = counted_cut(texts, "texts")
    # Edges come before the marks: a paper leaves the queue only once its edges are stored, and
    # inserting them again after an interrupted run changes nothing.
    edges = archive.insert_refs(harvest.document_edges(documents))
    if fetched:
        # Texts an interrupted run stored without marking the paper are not stored twice.
        stored = outputs.read_full_texts(archive.spark, archive.fulltext_path)
        outputs.write_full_texts(
            cut(catalog.unknown_ids(texts, stored)),
            archive.fulltext_path,
            f"papers-{uuid.uuid4().hex}",
        )
        path = full_text_path(archive.fulltext_path, F.col("category"), F.col("arxiv_id"))
        archive.mark_full_text(texts.withColumn("full_text_path", path))
    return {"fetched": fetched, "failed": failed, "edges": edges}


def sync_embeddings(archive: Archive, embedder, limit="all", dim=params.EMBED_DIM) -> dict:
    """Embed the papers without a vector; `embedder` is a callable or `HASHED`, None skips."""
    if embedder is None:
        return {"embedded": 0, "embed_failed": 0}
    papers, vectors = archive.papers.read(), archive.embeddings.read()
    queue = catalog.pending_embedding(papers, vectors, limit)
    call = None if embedder == HASHED else embedder
    # Embedding is the costly step: its result is stored before anything else is done with it.
    done = embed.embed_papers(queue, call, dim)
    done, failed = counted_cut(done, "embedded", F.count_if("failed"))
    good = done.where(~F.col("failed")).select("arxiv_id", "embedding", F.lit(0).alias("seq"))
    return {"embedded": archive.update_embeddings(good), "embed_failed": failed}


def sync_references(archive: Archive) -> dict:
    """Count the full-text papers without references."""
    row = graph.missing_reference_count(archive.papers.read(), archive.refs.read()).first()
    return {"missing_refs": row.papers}


def run(
    archive: Archive, step: str = "", *, landing=None, checkpoint=None, categories=None,
    documents=None, fetch=None, embedder=None, dim: int = params.EMBED_DIM, limit="all", now=None,
) -> dict:
    """Run one step, or all of them in order; the first failing step ends the run.

    `landing` holds harvest pages and `checkpoint` the progress over them; `documents` is the path
    of landed enrichment payloads or a DataFrame of parsed documents, `fetch` a callable asking
    for them instead. Gives the run's counts, which are also kept in the sync state.
    """
    if step not in ("", *STEPS):
        raise ValueError(f"unknown sync step: {step}")
    started = time.monotonic()
    now = now or datetime.now(UTC).replace(tzinfo=None)
    counts = {}
    for current in STEPS if step == "" else (step,):
        if current == "metadata":
            done = upsert_pages(archive, landing, checkpoint, categories, now)
            counts.update({f"harvested_{name}": n for name, n in done.items()})
        elif current == "fulltext":
            parsed = documents
            if isinstance(documents, str):
                parsed = inputs.enrichment_documents(archive.spark, documents)
            counts.update(sync_full_text(archive, parsed, fetch, limit))
        elif current == "embed":
            counts.update(sync_embeddings(archive, embedder, limit, dim))
        else:
            counts.update(sync_references(archive))
    archive.set_state(
        last_sync=now.strftime("%Y-%m-%dT%H:%M:%SZ"),
        last_sync_duration=f"{time.monotonic() - started:.3f}s",
        **{f"run_{name}": str(count) for name, count in counts.items()},
    )
    return counts
