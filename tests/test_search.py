import math
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paperlake.functions import analysis
from paperlake.functions.rank import rank_positions
from paperlake.functions.stemming import STOP_WORDS, common_start, english_term, stem
from paperlake.operators import search
from paperlake.plans import answers
from paperlake.schemas import PAPERS, POSTINGS
from paperlake.sources.store import Archive


def make_papers(spark, texts):
    rows = [
        (f"p{n:03d}", title, abstract, *[None] * 9) for n, (title, abstract) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, PAPERS)


def brute_rank(position_lists):
    """Rank straight from the definition, over all pairs."""
    if len(position_lists) == 1:
        return sum(0.1 / (n * n) for n in range(1, len(position_lists[0]) + 1)) / 1.64493406685
    none = 0.0
    for i, left in enumerate(position_lists):
        for right in position_lists[:i]:
            for p in left:
                for q in right:
                    d = abs(p - q)
                    if d:
                        w = 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) if d <= 100 else 1e-30
                        none += math.log1p(-0.1 * math.sqrt(w))
    return -math.expm1(none)


def ranks(spark, cases):
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, p array<array<int>>")
    out = rows.select("n", rank_positions(F.col("p")).alias("rank")).orderBy("n")
    return [row["rank"] for row in out.collect()]


def test_rank_golden(spark):
    single, pair = ranks(spark, [[[5]], [[5], [6]]])
    assert single == pytest.approx(0.0607927, abs=1e-7)
    assert pair == pytest.approx(0.0991032, abs=1e-7)


def test_rank_matches_definition(spark):
    cases = [
        [[1, 4, 9]],
        [[1, 50, 300], [2, 49, 299, 500]],
        [[1], [150]],
        [list(range(1, 400, 7)), list(range(2, 400, 11)), list(range(3, 400, 5))],
        [[16383], [16383], [16380, 16383]],
        [[1, 2000, 16383], [900, 16383]],
    ]
    for got, case in zip(ranks(spark, cases), cases, strict=True):
        assert got == pytest.approx(brute_rank(case), rel=1e-5, abs=1e-12)


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("gas", "gas"),
        ("agreed", "agre"), ("hopping", "hop"), ("hoped", "hope"), ("luxuriating", "luxuri"),
        ("cry", "cri"), ("by", "by"), ("say", "say"), ("consignment", "consign"),
        ("consolatory", "consolatori"), ("relational", "relat"), ("conditional", "condit"),
        ("generalization", "general"), ("networks", "network"), ("attention", "attent"),
        ("transformers", "transform"), ("universities", "univers"), ("happily", "happili"),
        ("electricity", "electr"), ("adjustment", "adjust"), ("effective", "effect"),
        ("boyish", "boyish"), ("analysis", "analysi"), ("dying", "die"), ("skies", "sky"),
        ("communism", "communism"), ("naïve", "naïve"), ("42", "42"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


SUFFIXES = """s es ed ing ings ly ally ation ations ational ator izer ization ize izes ized ability
    ibility ibly ably able ible ance ances ence ency ancy encies ment ments ness nesses ful fulness
    fully less lessly lessness ous ously ousness ive iveness ivity ical ically icate iciti icity
    al alism ality ally ate ated ating ative atives ent ently ion ions ied ies y yed ying eed eedly
    ogy ogi ism iti e er ers est""".split()


def test_words_start_like_their_stem():
    bases = """happ cr d l t sk hop hopp fall trouble siz conflat relat ration sens poss organ gener
        commun arsen electr vit feed agre nat operat adjust radic analog anarch depend homolog
        effect angular controll rol be bo ae x yell boy syzyg queu tann""".split()
    words = [b + s for b in bases for s in SUFFIXES]
    words += [a + b for a in words[::7] for b in SUFFIXES]
    words += ["skis", "skies", "dying", "lying", "tying", "idly", "news", "only", "singly"]
    wrong = [w for w in words if not w.startswith(common_start(stem(w)))]
    assert wrong == []


def test_stop_words():
    assert len(STOP_WORDS) == 127
    assert english_term("the") is None
    assert english_term("learning") == "learn"


def test_positions_advance_over_stop_words():
    lists = pa.array([["the", "cats", "and", "cat"], [], ["cat"]])
    docs, terms, positions = analysis.group_positions(lists, analysis.term_of("english"))
    assert docs.tolist() == [0, 2]
    assert terms.to_pylist() == ["cat", "cat"]
    assert positions.to_pylist() == [[2, 4], [1]]


def test_all_positions_are_kept():
    lists = pa.array([["a"] * 300 + ["b"] * 20000 + ["c", "c"]])
    _, terms, positions = analysis.group_positions(lists, analysis.term_of("simple"))
    found = dict(zip(terms.to_pylist(), positions.to_pylist(), strict=True))
    assert found["a"] == list(range(1, 301))
    assert found["b"] == list(range(301, 20301))
    assert found["c"] == [20301, 20302]


@pytest.mark.parametrize("analyzer", analysis.ANALYZERS)
def test_long_texts_rank_by_all_positions(spark, analyzer):
    texts = [("x", "cat " * 300 + "filler " * 20000 + "dog fish"), ("y", "cat " * 299 + "dog")]
    papers = make_papers(spark, texts)
    one = search.search(papers, "cat", analyzer=analyzer).collect()
    assert [r["arxiv_id"] for r in one] == ["p000", "p001"]
    assert one[0]["rank"] == pytest.approx(brute_rank([list(range(300))]), rel=1e-6)
    two = search.search(papers, "dog fish", analyzer=analyzer).collect()
    assert [r["arxiv_id"] for r in two] == ["p000"]
    assert two[0]["rank"] == pytest.approx(brute_rank([[20302], [20303]]), rel=1e-5)


def test_empty_batch():
    docs, terms, positions = analysis.group_positions(
        pa.array([], pa.list_(pa.string())), analysis.term_of("simple")
    )
    assert (len(docs), len(terms), len(positions)) == (0, 0, 0)


TEXTS = [
    ("Deep networks", "We train deep networks for vision."),
    ("Shallow models", "A network of ideas; the deep sea."),
    ("Vision", None),
    ("Deep deep deep", "networks networks"),
    ("Other", "nothing to see here, networking at depth"),
]


def test_search_simple(spark):
    found = search.search(make_papers(spark, TEXTS), "Deep, NETWORKS!", analyzer="simple").collect()
    assert [row.arxiv_id for row in found] == ["p003", "p000"]
    for row in found:
        title, abstract = TEXTS[int(row.arxiv_id[1:])]
        words = f"{title} {abstract}".lower().replace(".", "").split()
        expected = brute_rank(
            [[n + 1 for n, w in enumerate(words) if w == t] for t in ("deep", "networks")]
        )
        assert row["rank"] == pytest.approx(expected, rel=1e-6)


def test_search_english(spark):
    papers = make_papers(spark, TEXTS)
    found = search.search(papers, "the deep network", analyzer="english").collect()
    assert {row.arxiv_id for row in found} == {"p000", "p001", "p003"}
    assert search.search(papers, "the of and", analyzer="english").count() == 0


def test_whole_words_only(spark):
    texts = [("cat", ""), ("concat", "cats"), ("a cat-flap", ""), ("caté", "2cat"), ("CAT", "")]
    found = search.search(make_papers(spark, texts), "cat", analyzer="simple").collect()
    assert [row.arxiv_id for row in found] == ["p000", "p002", "p004"]


def test_search_limit_and_missing_query(spark):
    papers = make_papers(spark, [("same words", "")] * 30)
    found = search.search(papers, "words").collect()
    assert [row.arxiv_id for row in found] == [f"p{n:03d}" for n in range(20)]
    assert search.search(papers, "words", limit="3").count() == 3
    assert search.search(papers, "?!").count() == 0
    with pytest.raises(ValueError, match="missing query"):
        search.search(papers, "")


@pytest.mark.parametrize("analyzer", analysis.ANALYZERS)
def test_index_agrees_with_scan(spark, tmp_path, analyzer):
    papers = make_papers(spark, TEXTS * 3)
    path = str(tmp_path / "postings")
    search.write_postings(search.build_postings(papers, analyzer), path, 4)
    postings = search.read_postings(spark, path)
    for query in ("deep networks", "vision", "deep unheard", "networks deep vision"):
        scanned = search.search(papers, query, analyzer=analyzer)
        indexed = search.search_index(postings, query, analyzer=analyzer, buckets=4)
        expected = [(r.arxiv_id, r["rank"]) for r in scanned.collect()]
        assert [(r.arxiv_id, r["rank"]) for r in indexed.collect()] == expected


def test_index_reads_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "postings")
    search.write_postings(search.build_postings(make_papers(spark, TEXTS)), path, 8)
    found = search.search_index(search.read_postings(spark, path), "vision", buckets=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(term_bucket" in plan or "term_bucket#" in plan
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,vision)]" in plan


def test_batch_reads_the_index_twice(spark, tmp_path):
    path = str(tmp_path / "postings")
    search.write_postings(search.build_postings(make_papers(spark, TEXTS)), path, 4)
    queries = spark.createDataFrame([(1, "deep networks"), (2, "vision")], "query_id int, query string")
    reads, labels = [], []
    cut = search.cut

    def read(rows):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        reads.append(len(re.findall(r"Relation \[[^]]*positions#[^]]*term_bucket#", plan)))

    def counted(rows, label):
        read(rows)
        labels.append(label)
        return cut(rows, label)

    search.cut = counted
    try:
        found = search.search_batch(
            search.read_postings(spark, path), queries, buckets=4, terms=search.read_terms(spark, path)
        )
    finally:
        search.cut = cut
    read(found)
    assert found.count() == 5
    # The rarest terms are known without the postings.
    assert dict(zip([*labels, "answer"], reads, strict=True)) == {"rarest": 0, "first": 1, "answer": 1}


def test_stored_frequencies_are_those_of_the_index(spark, tmp_path):
    path = str(tmp_path / "postings")
    postings = search.build_postings(make_papers(spark, TEXTS * 2))
    search.write_postings(postings, path, 4)
    counted = {r.term: r["count"] for r in postings.groupBy("term").count().collect()}
    stored = search.read_terms(spark, path).collect()
    assert {r.term: r.df for r in stored} == counted and len(stored) == len(counted)


@pytest.mark.parametrize("analyzer", analysis.ANALYZERS)
def test_batch_agrees_with_single_queries(spark, analyzer):
    # One term is in every paper and every query.
    texts = [(f"common word{n % 7}", f"common filler word{n % 3} x{n}") for n in range(60)]
    papers = make_papers(spark, texts)
    asked = ["common word1", "common", "common word2 x5", "common missing", "x7 x8", "?"]
    asked += ["Common, word1!"] * 3
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    postings = search.build_postings(papers, analyzer)
    got = search.search_batch(postings, queries, 5, analyzer).collect()
    for number, query in enumerate(asked):
        expected = search.search(papers, query, 5, analyzer).collect()
        mine = sorted((r.place, r.arxiv_id, r["rank"]) for r in got if r.query_id == number)
        assert [m[1:] for m in mine] == [(r.arxiv_id, r["rank"]) for r in expected]


def archive_of(spark, path, texts):
    archive = Archive(spark, str(path), buckets=2, term_buckets=4).create()
    archive.papers.write(make_papers(spark, texts), whole=True)
    return archive


def upsert(spark, archive, *rows):
    """Rows (number, title, abstract)."""
    values = [(f"p{n:03d}", title, text, *[None] * 9) for n, title, text in rows]
    batch = spark.createDataFrame(values, PAPERS).withColumn("seq", F.lit(0))
    return archive.upsert_papers(batch, "2024-01-01 00:00:00")


def same_index(archive):
    rebuilt = search.build_postings(archive.papers.read(), "english")
    wanted = sorted((r.term, r.arxiv_id, tuple(r.positions)) for r in rebuilt.collect())
    index = archive.index()
    assert sorted((r.term, r.arxiv_id, tuple(r.positions)) for r in index.postings().collect()) == wanted
    for query in ("deep networks", "vision", "brand new words"):
        scanned = search.search(archive.papers.read(), query).collect()
        found = index.search(query).collect()
        assert [(r.arxiv_id, r["rank"]) for r in found] == [(r.arxiv_id, r["rank"]) for r in scanned]
    held = {r.term: r.df for r in index.terms().collect()}
    assert all(held[term] >= 1 for term, _, _ in wanted)


def test_index_follows_upserts(spark, tmp_path):
    archive = archive_of(spark, tmp_path / "archive", TEXTS)
    assert archive.index() is None
    archive.build_index()
    same_index(archive)
    # A changed paper, a new one, one that is changed again, one that loses all its terms.
    upsert(spark, archive, (0, "brand new", "vision words"), (900, "deep networks", "of vision"))
    same_index(archive)
    before = set((tmp_path / "archive").glob("index-*/**/*.parquet"))
    upsert(spark, archive, (0, "deep", "again"), (1, "?", ""))
    assert before < set((tmp_path / "archive").glob("index-*/**/*.parquet"))
    same_index(archive)
    archive.compact_index()
    assert archive.index()._changes() == []
    same_index(archive)
    exact = {r.term: r.df for r in archive.index().terms().collect()}
    counted = archive.index().postings().groupBy("term").count().collect()
    assert exact == {r.term: r["count"] for r in counted}
    upsert(spark, archive, (2, "vision", "of vision"))
    same_index(archive)


def test_interrupted_index_change_is_not_seen(spark, tmp_path):
    archive = archive_of(spark, tmp_path / "archive", TEXTS)
    index = archive.build_index()
    half = make_papers(spark, [("deep", "deep")])
    search.place_postings(search.build_postings(half), f"{index.path}/changes/change=1", 4)
    same_index(archive)
    upsert(spark, archive, (1, "networks", "vision"))
    assert index._changes() == [1]
    same_index(archive)


def test_batch_over_a_changed_index_looks_up_candidates_only(spark, tmp_path):
    archive = archive_of(spark, tmp_path / "archive", TEXTS)
    index = archive.build_index()
    upsert(spark, archive, (0, "brand new", "vision words"), (900, "deep networks", "of vision"))
    upsert(spark, archive, (0, "deep", "again vision"), (1, "?", ""), (901, "vision", "deep vision"))
    half = make_papers(spark, [("deep", "deep vision")] * 4)
    search.place_postings(search.build_postings(half), f"{index.path}/changes/change=3", 4)
    words = ["deep vision", "vision", "vision deep", "brand new words", "networks", "absent", ""]
    queries = spark.createDataFrame(list(enumerate(words)), "query_id int, query string")
    found = archive.index().search_batch(queries, 50)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan
    rebuilt = search.build_postings(archive.papers.read(), "english")
    expected = search.search_batch(rebuilt, queries, 50)
    assert len(found.collect()) > 8
    columns = ["query_id", "place", "arxiv_id", "rank"]
    assert sorted(found.select(columns).collect()) == sorted(expected.select(columns).collect())


def test_answer_from_the_index(spark, tmp_path):
    archive = archive_of(spark, tmp_path / "archive", TEXTS)
    index, papers = archive.build_index(), archive.papers.read().select(*PAPERS.fieldNames())
    scanned = answers.search_papers(papers, "deep networks", 3)
    assert answers.search_papers(papers, "deep networks", 3, index=index).collect() == scanned.collect()


def test_postings_are_grouped_in_slices_of_bounded_tokens():
    lists = [["a"] * n for n in (0, 3, search.SLICE_TOKENS, 5, search.SLICE_TOKENS + 7, 0, 2)]
    lists += [None] + [["x", "y"] * (search.SLICE_TOKENS // 8)] * 9
    batch = pa.RecordBatch.from_arrays(
        [pa.array([str(i) for i in range(len(lists))]), pa.array(lists, pa.list_(pa.string()))],
        names=["arxiv_id", "tokens"],
    )
    slices = list(search._by_tokens(batch.slice(1)))
    assert [i for s in slices for i in s.column("arxiv_id").to_pylist()] == [
        str(i) for i in range(1, len(lists))
    ]
    sizes = [len(s.column("tokens").flatten()) for s in slices]
    assert all(
        size <= search.SLICE_TOKENS or s.num_rows == 1
        for size, s in zip(sizes, slices, strict=True)
    )
    assert sum(sizes) == sum(len(x or []) for x in lists[1:])


def test_tasks_write_their_own_postings(spark, tmp_path):
    papers = make_papers(spark, TEXTS * 4).repartition(3)
    postings = search.build_postings(papers)
    path = tmp_path / "postings"
    search.place_postings(postings, str(path), 2)
    # A shuffle would have brought such a small bucket into one file.
    assert max(len(list(bucket.glob("*.parquet"))) for bucket in path.glob("term_bucket=*")) == 3
    for file in path.glob("term_bucket=*/*.parquet"):
        names = pq.read_table(file)["term"].to_pylist()
        assert names == sorted(names)
    columns = POSTINGS.fieldNames()
    stored = search.read_postings(spark, str(path)).select(columns).collect()
    assert sorted(stored) == sorted(postings.select(columns).collect())


def test_wanted_postings_are_marked(spark):
    rows = spark.range(5000).select(
        F.concat(F.lit("t"), F.col("id") % 50).alias("term"), F.col("id").cast("string").alias("arxiv_id")
    )
    rows = rows.unionByName(spark.createDataFrame([("t1", None), (None, "1")], "term string, arxiv_id string"))
    wanted = rows.where("arxiv_id % 700 = 1").unionByName(rows.limit(1))
    found = search._marked(rows, wanted, ["term", "arxiv_id"])
    assert found.columns == rows.columns
    got = {(r.term, r.arxiv_id) for r in found.collect()}
    assert {(r.term, r.arxiv_id) for r in wanted.collect()} <= got and len(got) < 20
    assert search._marked(rows, wanted.limit(0), ["term", "arxiv_id"]).count() == 0


@pytest.mark.parametrize("marks", [64, 1 << 26])
def test_batch_looks_marked_postings_up(spark, tmp_path, monkeypatch, marks):
    monkeypatch.setattr(search, "MARKS", marks)
    texts = [(f"common word{n % 7}", f"common filler word{n % 3} x{n}") for n in range(60)]
    papers = make_papers(spark, texts)
    path = str(tmp_path / "postings")
    search.write_postings(search.build_postings(papers), path, 4)
    asked = ["common word1", "common word2 x5", "filler common", "x7 x8", "common"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    found = search.search_batch(
        search.read_postings(spark, path), queries, 5, buckets=4, terms=search.read_terms(spark, path)
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan.lower()
    got = found.collect()
    for number, query in enumerate(asked):
        expected = search.search(papers, query, 5).collect()
        mine = sorted((r.place, r.arxiv_id, r["rank"]) for r in got if r.query_id == number)
        assert [m[1:] for m in mine] == [(r.arxiv_id, r["rank"]) for r in expected]
