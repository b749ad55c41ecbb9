import datetime
import json

import pytest
from pyspark.sql import functions as F

from paperlake import schemas
from paperlake.operators import embed, harvest
from paperlake.plans import answers, sync
from paperlake.sources import inputs, outputs
from paperlake.sources.store import Archive
from paperlake.streaming.harvest import upsert_pages

NOW = datetime.datetime(2024, 5, 1)


def record(number, title="Title", status="", own_id=True, sets=("cs:cs:AI",), day="2024-01-20"):
    own = f"<id>2301.{number:05d}</id>" if own_id else ""
    listed = "".join(f"<setSpec>{s}</setSpec>" for s in sets)
    mark = f' status="{status}"' if status else ""
    metadata = f"""<metadata><arXiv xmlns="http://arxiv.org/OAI/arXiv/">{own}
      <created>2023-11-04</created><updated>2023-11-09T06:05:00Z</updated>
      <authors><author><keyname>Okafor</keyname><forenames>Ada</forenames></author>
      <author><keyname>Lindqvist</keyname><forenames>Per</forenames></author></authors>
      <title>  {title}
        here </title><categories>cs.AI cs.CL</categories>
      <abstract> An abstract &amp; more. </abstract><doi>10.5555/own.7</doi>
      <journal-ref>J. 1</journal-ref></arXiv></metadata>"""
    return f"""<record><header{mark}><identifier>oai:arXiv.org:2301.{number:05d}v2</identifier>
      <datestamp>{day}</datestamp>{listed}</header>{"" if status else metadata}</record>"""


def page(*records, token="", cursor="0", size="73"):
    return f"""<?xml version="1.0" encoding="UTF-8"?>
<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>{"".join(records)}
<resumptionToken cursor="{cursor}" completeListSize="{size}">{token}</resumptionToken>
</ListRecords></OAI-PMH>"""


def error_page(code):
    return f"""<?xml version="1.0"?><OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/">
<error code="{code}">The message</error></OAI-PMH>"""


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    return folder


@pytest.fixture
def archive(spark, tmp_path):
    return Archive(spark, str(tmp_path / "archive"), buckets=4).create()


def test_records_to_papers(spark, landing):
    nameless = "<record><header><identifier></identifier></header></record>"
    records = [
        record(1), record(2, status="deleted"), record(3, own_id=False), nameless,
    ]
    (landing / "1.xml").write_text(page(*records, token="page-two"))
    (landing / "2.xml").write_text(error_page("noRecordsMatch"))
    papers = harvest.records_to_papers(inputs.harvest_records(spark, str(landing)))
    got = {r.arxiv_id: r for r in papers.collect()}
    assert sorted(got) == ["2301.00001", "2301.00003"]
    assert got["2301.00001"].asDict() == {
        "arxiv_id": "2301.00001",
        "title": "Title here",
        "abstract": "An abstract & more.",
        "authors": "Ada Okafor, Per Lindqvist",
        "categories": "cs.AI cs.CL",
        "published": datetime.datetime(2023, 11, 4),
        "updated": datetime.datetime(2023, 11, 9, 6, 5),
        "doi": "10.5555/own.7",
        "journal_ref": "J. 1",
        "has_full_text": False,
        "full_text_path": "",
    }


def test_page_envelope(spark, landing):
    (landing / "1.xml").write_text(page(record(1), token=" page-two "))
    (landing / "2.xml").write_text(page(record(2), cursor="50"))
    (landing / "3.xml").write_text(error_page("noRecordsMatch"))
    rows = inputs.page_tokens(spark, str(landing)).orderBy("page").collect()
    assert [(r.token, r.complete_size, r.cursor) for r in rows] == [
        ("page-two", "73", "0"), ("", "73", "50"),
    ]
    assert inputs.harvest_errors(spark, str(landing)).count() == 0
    (landing / "4.xml").write_text(error_page("badArgument"))
    bad = inputs.harvest_errors(spark, str(landing)).first()
    assert (bad.code, bad.message) == ("badArgument", "The message")


def test_later_pages_win(spark, landing):
    (landing / "1.xml").write_text(page(record(1, "First"), record(1, "Second")))
    (landing / "2.xml").write_text(page(record(1, "Third"), record(1, "Fourth")))
    rows = harvest.records_to_papers(inputs.harvest_records(spark, str(landing)), "seq")
    assert [r.title for r in rows.orderBy("seq").collect()] == [
        "First here", "Second here", "Third here", "Fourth here",
    ]


def test_category_selection(spark, landing):
    records = [
        record(1, sets=["cs:cs:AI", "cs:cs:LG"], day="2024-01-10"),
        record(2, sets=["cs:cs:CV"], day="2024-01-20"),
        record(3, sets=["cs:cs:AI"], day="2024-01-30"),
    ]
    (landing / "1.xml").write_text(page(*records))
    rows = inputs.harvest_records(spark, str(landing))
    assert harvest.in_categories(rows, ["cs.AI"]).count() == 2
    marks = {r.category: r for r in harvest.newest_datestamp(rows, ["cs.AI", "cs.LG"]).collect()}
    assert (marks["cs.AI"].records, marks["cs.AI"].datestamp) == (2, "2024-01-30")
    assert marks["cs.LG"].datestamp == "2024-01-10"
    changed = harvest.changed_since(rows, {"cs.AI": "2024-01-12", "cs.CV": ""})
    assert sorted(r.header.datestamp for r in changed.collect()) == ["2024-01-20", "2024-01-30"]


def test_stream_resumes(archive, landing, tmp_path):
    progress = str(tmp_path / "progress")

    def run():
        return upsert_pages(archive, str(landing), progress, ["cs.AI"], NOW)

    (landing / "1.xml").write_text(page(record(1), record(2), record(9, sets=["cs:cs:CV"])))
    assert run() == {"papers": 2, "cs.AI": 2}
    assert archive.get_state("oai_last_cs.AI") == "2024-01-20"
    assert run() == {"papers": 0}
    # An error answer fails the run; the pages landed with it are taken once it is gone.
    (landing / "2.xml").write_text(page(record(1, "New"), record(3)))
    bad = landing / "3.xml"
    bad.write_text(error_page("badResumptionToken"))
    with pytest.raises(Exception, match="badResumptionToken"):
        run()
    bad.write_text(error_page("noRecordsMatch"))
    assert run()["papers"] == 2
    titles = {r.arxiv_id: r.title for r in archive.papers.read().collect()}
    assert titles == {
        "2301.00001": "New here", "2301.00002": "Title here", "2301.00003": "Title here",
    }


def document(number, **fields):
    external = {"ArXiv": f"2301.{number:05d}"} if number else {"DOI": "10.1/x"}
    return {"paperId": f"s{number}", "externalIds": external, **fields}


DOCUMENTS = [
    document(
        1,
        abstract="Text",
        tldr={"model": "m", "text": "short"},
        references=[document(4), document(5), document(0), {"paperId": "x"}],
        citations=[document(6), document(0)],
        openAccessPdf={"url": "https://x/1.pdf", "status": "GREEN"},
    ),
    None,
    document(0, abstract="no id"),
    document(2, abstract=None, tldr=None, references=None, openAccessPdf={"url": ""}),
    document(3, abstract="Three", references=[document(1)], citations=[]),
]


def test_documents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.json").write_text(json.dumps(DOCUMENTS, indent=1))
    (tmp_path / "d" / "2.json").write_text("[]")
    documents = inputs.enrichment_documents(spark, str(tmp_path / "d"))
    assert documents.count() == 3
    edges = {(r.from_id, r.to_id) for r in harvest.document_edges(documents).collect()}
    first = "2301.00001"
    assert edges == {
        (first, "2301.00004"), (first, "2301.00005"), ("2301.00006", first),
        ("2301.00003", first),
    }
    assert harvest.outgoing_edges(documents).count() == 3
    assert harvest.incoming_edges(documents).count() == 1
    texts = {r.arxiv_id: r.text for r in harvest.full_texts(documents).collect()}
    assert texts == {first: "Text\n\nTL;DR: short", "2301.00003": "Three"}
    urls = harvest.open_access_urls(documents).collect()
    assert [(r.arxiv_id, r.url) for r in urls] == [(first, "https://x/1.pdf")]


def land_documents(tmp_path):
    folder = tmp_path / "documents"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps(DOCUMENTS))
    return str(folder)


def test_full_run(spark, archive, landing, tmp_path):
    (landing / "1.xml").write_text(page(*[record(n) for n in (1, 2, 3)]))
    counts = sync.run(
        archive, landing=str(landing), checkpoint=str(tmp_path / "progress"),
        documents=land_documents(tmp_path), embedder=sync.HASHED, dim=16, now=NOW,
    )
    assert counts == {
        "harvested_papers": 3, "fetched": 2, "failed": 0, "edges": 4, "embedded": 3,
        "embed_failed": 0, "missing_refs": 0,
    }
    papers = {r.arxiv_id: r for r in archive.papers.read().collect()}
    root = archive.fulltext_path
    assert papers["2301.00001"].full_text_path == f"{root}/cs/AI cs/CL/2301.00001.txt"
    assert not papers["2301.00002"].has_full_text
    texts = outputs.read_full_texts(spark, root)
    assert {r.category for r in texts.collect()} == {"cs.AI cs.CL"}
    assert archive.get_state("last_sync") == "2024-05-01T00:00:00Z"
    assert archive.get_state("run_edges") == "4"

    again = sync.run(archive, "fulltext", documents=str(tmp_path / "documents"), now=NOW)
    assert again == {"fetched": 0, "failed": 0, "edges": 0}
    assert outputs.read_full_texts(spark, root).count() == 2


def test_interrupted_full_text_is_not_stored_twice(spark, archive, landing, tmp_path):
    (landing / "1.xml").write_text(page(record(1), record(3)))
    upsert_pages(archive, str(landing), str(tmp_path / "progress"), None, NOW)
    early = spark.createDataFrame([("2301.00001", "Text", "cs.AI")], schemas.FULLTEXT)
    outputs.write_full_texts(early, archive.fulltext_path, "papers-0")
    documents = inputs.enrichment_documents(spark, land_documents(tmp_path))
    assert sync.sync_full_text(archive, documents)["fetched"] == 2
    assert outputs.read_full_texts(spark, archive.fulltext_path).count() == 2
    assert archive.papers.read().where("has_full_text").count() == 2


def test_fetched_documents(spark, archive, landing, tmp_path):
    (landing / "1.xml").write_text(page(*[record(n) for n in range(1, 4)]))
    upsert_pages(archive, str(landing), str(tmp_path / "progress"), None, NOW)

    def fetch(ids):
        assert all(i.startswith("arXiv:2301.") for i in ids)
        wanted = {i.removeprefix("arXiv:") for i in ids}
        found = [d for d in DOCUMENTS if d and d["externalIds"].get("ArXiv") in wanted]
        return [json.dumps(d) for d in found] + [None]

    assert sync.sync_full_text(archive, fetch=fetch) == {"fetched": 2, "failed": 0, "edges": 4}

    def broken(ids):
        raise RuntimeError("no service")

    assert sync.sync_full_text(archive, fetch=broken)["failed"] == 1


def test_enrich_batches(spark):
    ids = spark.range(120).select(F.format_string("%d", "id").alias("arxiv_id")).coalesce(1)

    def fetch(wanted):
        if "arXiv:60" in wanted:
            raise RuntimeError("no service")
        assert len(wanted) <= 50
        return [json.dumps({"externalIds": {"ArXiv": w[6:]}}) for w in wanted]

    rows = embed.enrich(ids, fetch)
    assert rows.where("externalIds.ArXiv <> ''").count() == 70
    assert rows.agg(F.sum("failed")).first()[0] == 50


def test_steps(archive):
    with pytest.raises(ValueError, match="unknown sync step"):
        sync.run(archive, "everything")
    assert sync.run(archive, "embed", now=NOW) == {"embedded": 0, "embed_failed": 0}
    assert sync.run(archive, "refs", now=NOW) == {"missing_refs": 0}
    with pytest.raises(ValueError, match="needs documents"):
        sync.run(archive, "fulltext")


def test_failed_embeddings_stay_pending(archive, landing, tmp_path):
    (landing / "1.xml").write_text(page(record(1), record(2)))
    upsert_pages(archive, str(landing), str(tmp_path / "progress"), None, NOW)

    def broken(texts):
        raise RuntimeError("no service")

    assert sync.sync_embeddings(archive, broken, dim=2) == {"embedded": 0, "embed_failed": 2}
    done = sync.sync_embeddings(archive, lambda texts: [[1.0, 2.0]] * len(texts), dim=2)
    assert done == {"embedded": 2, "embed_failed": 0}
    assert archive.embeddings.read().count() == 2


# --- answers -----------------------------------------------------------------------------------


def answer_tables(spark):
    rows = [
        ("a", "T a", "about cats", "", "cs.AI", NOW, None, "10.1/a", "", True, "x", NOW),
        ("b", "T b", "about cats", "x", "cs.AI", None, None, "", "", False, "", None),
    ]
    papers = spark.createDataFrame(rows, schemas.PAPERS)
    vectors = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [1.0, 0.0])], schemas.EMBEDDINGS)
    refs = spark.createDataFrame([("a", "b")], schemas.REFS)
    texts = spark.createDataFrame([("a", "full", "cs.AI")], schemas.FULLTEXT)
    return papers, vectors, refs, texts


def parsed(rows):
    return [json.loads(r.value) for r in rows.collect()]


def test_answers(spark):
    papers, vectors, refs, texts = answer_tables(spark)
    (one,) = parsed(answers.paper(papers, vectors, refs, texts, "a"))
    assert one == {
        "arxiv_id": "a", "title": "T a", "abstract": "about cats", "categories": "cs.AI",
        "published": "2024-05-01T00:00:00Z", "doi": "10.1/a", "has_full_text": True,
        "full_text_path": "x", "embedding": [1.0, 0.5], "fetched_at": "2024-05-01T00:00:00Z",
        "ref_count": 1, "cited_by_count": 0, "full_text": "full",
    }
    assert parsed(answers.paper(papers, vectors, refs, texts, "zz")) == []

    (found,) = parsed(answers.search_papers(papers, 'about "cat"'))
    assert (found["query"], found["count"]) == ('about "cat"', 2)
    assert [p["arxiv_id"] for p in found["papers"]] == ["a", "b"]
    (near,) = parsed(answers.similar_papers(papers, vectors, "a"))
    assert (near["source"], near["count"], near["papers"][0]["arxiv_id"]) == ("a", 1, "b")
    (none,) = parsed(answers.similar_papers(papers, vectors, "zz"))
    assert none == {"source": "zz", "count": 0, "papers": []}
    (text,) = parsed(
        answers.similar_to_text(papers, vectors, "x", embedder=lambda t: [[1.0, 0.0]], dim=2)
    )
    assert [p["arxiv_id"] for p in text["papers"]] == ["b", "a"]
    (late,) = parsed(answers.recent(papers, NOW, "cs.AI"))
    assert (late["category"], late["days"], late["count"]) == ("cs.AI", 7, 1)
    head, line = parsed(answers.references(refs, papers, "a"))
    assert head == {"source": "a", "count": 1} and line["arxiv_id"] == "b"
    head, line = parsed(answers.cited_by(refs, papers, "b"))
    assert head == {"source": "b", "count": 1} and line["arxiv_id"] == "a"
    state = spark.createDataFrame([], schemas.SYNC_STATE)
    (numbers,) = parsed(answers.archive_stats(papers, vectors, refs, state, NOW))
    assert (numbers["total_papers"], numbers["total_refs"]) == (2, 1)


def test_write_json(spark, tmp_path):
    papers, *_ = answer_tables(spark)
    outputs.write_json(papers, str(tmp_path / "out"))
    rows = spark.read.json(str(tmp_path / "out"))
    assert rows.count() == 2


def test_a_break_between_edges_and_marks_loses_nothing(archive, landing, tmp_path, monkeypatch):
    (landing / "1.xml").write_text(page(*[record(n) for n in (1, 2, 3)]))
    sync.run(archive, "metadata", landing=str(landing), checkpoint=str(tmp_path / "p"), now=NOW)
    documents = land_documents(tmp_path)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(archive, "mark_full_text", die)
        with pytest.raises(RuntimeError, match="lost"):
            sync.run(archive, "fulltext", documents=documents, now=NOW)
    assert archive.papers.read().where("has_full_text").count() == 0
    sync.run(archive, "fulltext", documents=documents, now=NOW)
    assert archive.papers.read().where("has_full_text").count() == 2
    assert archive.refs.read().count() == archive.refs_by_target.read().count() == 4


def test_marks_bound_the_next_harvest(archive, landing, tmp_path):
    (landing / "1.xml").write_text(page(record(1, "First"), record(2, "Old", day="2024-01-10")))
    options = {"landing": str(landing), "checkpoint": str(tmp_path / "p"), "categories": ["cs.AI"]}
    sync.run(archive, "metadata", now=NOW, **options)
    assert archive.get_state("oai_last_cs.AI") == "2024-01-20"
    (landing / "2.xml").write_text(page(record(1, "Late", day="2024-01-19"), record(3, day="2024-01-21")))
    sync.run(archive, "metadata", now=NOW, **options)
    got = {r.arxiv_id: r.title for r in archive.papers.read().collect()}
    assert len(got) == 3 and got["2301.00001"].startswith("First")
    assert archive.get_state("oai_last_cs.AI") == "2024-01-21"


def test_a_harvest_without_categories_writes_its_records_once(
    archive, landing, tmp_path, monkeypatch
):
    """Their papers are written by the upsert; the records would be written for the marks only."""
    (landing / "1.xml").write_text(page(record(1), record(2), record(3, status="deleted")))
    monkeypatch.setattr("paperlake.streaming.harvest.cut", None)
    counts = upsert_pages(archive, str(landing), str(tmp_path / "progress"), None, NOW)
    assert counts == {"papers": 2} and archive.papers.read().count() == 2


def test_slim_documents_give_the_same_texts_and_edges(spark):
    def links(*ids):
        return [{"paperId": "p", "externalIds": {"ArXiv": i, "DOI": "d"}} for i in ids]

    rows = [
        {"externalIds": {"ArXiv": "a"}, "abstract": "x", "tldr": {"text": "y"},
         "references": links("b", None, ""), "citations": links("c"),
         "openAccessPdf": {"url": "u"}},
        {"externalIds": {"ArXiv": "b"}, "tldr": {"text": "z"}},
        {"externalIds": {"ArXiv": "c"}, "references": [], "citations": [None]},
    ]
    payloads = spark.createDataFrame([(json.dumps(rows),)], "value string")
    documents = inputs.parse_documents(payloads)
    slim = harvest.slim(documents)
    for step in (harvest.full_texts, harvest.document_edges):
        assert sorted(step(slim).collect()) == sorted(step(documents).collect())
    assert harvest.document_edges(slim).count() == 2
    shown = slim.schema.simpleString()
    assert "openAccessPdf" not in shown and "DOI" not in shown and "paperId" not in shown
