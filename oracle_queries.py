"""SQL equivalents of the registered queries, for the test tables registered as views."""

PAPER = "2306.00005"


def _pid(number: str) -> str:
    return f"printf('%04d.%05d', 2301 + {number} % 12, {number})"


def _time(column: str) -> str:
    name = column.split(".")[-1]
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name}"


AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}]+"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _clean(text: str) -> str:
    return f"regexp_replace({_trim(text)}, '[ \\n\\r\\t]+', ' ', 'g')"


PAPERS = f"""papers AS (
  SELECT {_pid('d.doc_id')} AS arxiv_id, split_part(d.text, chr(10), 1) AS title,
    d.text AS abstract, d.source AS authors, 'cs.' || upper(d.lang) || ',' || d.source AS categories,
    CASE WHEN coalesce(l.toxic, 0) = 0 THEN o.o_orderdate END AS published,
    o.o_orderdate AS updated, d.n_chars > 500 AS has_full_text,
    CASE WHEN d.n_chars > 500
      THEN 'texts/cs/' || upper(d.lang) || '/' || {_pid('d.doc_id')} || '.txt' END AS full_text_path
  FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

VECTORS = f"""vectors AS (
  SELECT {_pid('vec_id')} AS arxiv_id, CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"""

REFS = f"""refs AS (
  SELECT DISTINCT {_pid('l_orderkey')} AS from_id, {_pid('l_partkey')} AS to_id FROM lineitem)"""

DEGREES = """degrees AS (
  SELECT arxiv_id, sum(o) AS ref_count, sum(i) AS cited_by_count FROM (
    SELECT from_id AS arxiv_id, 1 AS o, 0 AS i FROM refs
    UNION ALL SELECT to_id, 0, 1 FROM refs) GROUP BY arxiv_id)"""

WHOLE = f"""arxiv_id, title, abstract, authors, categories, {_time('published')},
  {_time('updated')}, has_full_text, CAST(NULL AS VARCHAR) AS fetched_at"""
LISTED = f"arxiv_id, title, authors, categories, {_time('published')}"
NEWEST = "ORDER BY published DESC NULLS LAST, arxiv_id"
COSINE = "list_cosine_similarity({a}, {b})"

HARVESTED = f"""SELECT {_pid('d.doc_id')} AS arxiv_id,
  {_clean("split_part(d.text, chr(10), 1)")} AS title, {_clean('d.text')} AS abstract,
  trim(upper(substr(lang, 1, 1)) || substr(lang, 2) || ' ' || source) || ', '
    || trim(upper(substr(lang, 1, 1)) || substr(lang, 2) || ' ' || source) AS authors,
  'cs.' || upper(lang) || ' ' || source AS categories,
  {_time('o.o_orderdate').replace('AS o_orderdate', 'AS published')},
  strftime(o.o_orderdate, '%Y-%m-%d') || ' 10:30:00' AS updated,
  o.o_orderpriority AS journal_ref, false AS has_full_text
FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id
LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.toxic, 0) <> 1"""

UPSERTS = f"""batch AS (
  SELECT {_pid('(conv_id + CASE WHEN conv_id % 2 = 1 THEN 500000 ELSE 0 END)')} AS arxiv_id,
    role AS title, text AS abstract,
    CASE WHEN role = 'user' THEN 'user' ELSE '' END AS authors,
    CASE WHEN role = 'user' THEN NULL ELSE 'cs.DL' END AS categories,
    CASE WHEN role = 'user' THEN '10.1/' || turn ELSE '' END AS doi,
    length(text) > 500 AS has_full_text, turn AS seq FROM conversations),
folded AS (
  SELECT arxiv_id, arg_max(title, seq) AS title, arg_max(abstract, seq) AS abstract,
    arg_max(EMPTY(authors), seq) FILTER (EMPTY(authors) IS NOT NULL) AS authors,
    arg_max(EMPTY(categories), seq) FILTER (EMPTY(categories) IS NOT NULL) AS categories,
    arg_max(EMPTY(doi), seq) FILTER (EMPTY(doi) IS NOT NULL) AS doi,
    bool_or(has_full_text) AS has_full_text FROM batch GROUP BY arxiv_id)"""


def _folded(strict: bool) -> str:
    out = UPSERTS
    for name in ("authors", "categories", "doi"):
        value = name if strict else f"nullif({name}, '')"
        out = out.replace(f"EMPTY({name})", value)
    return out


def _upsert(strict: bool) -> str:
    return f"""WITH {PAPERS}, {_folded(strict)}, old AS (
      SELECT p.*, CAST(NULL AS VARCHAR) AS doi FROM papers p)
    SELECT coalesce(n.arxiv_id, o.arxiv_id) AS arxiv_id,
      CASE WHEN n.arxiv_id IS NOT NULL THEN n.title ELSE o.title END AS title,
      CASE WHEN n.arxiv_id IS NOT NULL THEN n.abstract ELSE o.abstract END AS abstract,
      coalesce(n.authors, o.authors) AS authors, coalesce(n.categories, o.categories) AS categories,
      {_time('o.published')}, coalesce(n.doi, o.doi) AS doi,
      CASE WHEN n.arxiv_id IS NULL THEN o.has_full_text WHEN o.arxiv_id IS NULL
        THEN n.has_full_text ELSE n.has_full_text OR o.has_full_text END AS has_full_text,
      CASE WHEN n.arxiv_id IS NOT NULL THEN '2001-08-02 00:00:00' END AS fetched_at
    FROM old o FULL OUTER JOIN folded n ON o.arxiv_id = n.arxiv_id"""


# All positions of each term.
TERMS = f"""tokens AS (
  SELECT arxiv_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (
    SELECT arxiv_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')),
      '{WORD}') AS t FROM papers)),
terms AS (SELECT arxiv_id, term, pos FROM tokens WHERE FILTER)"""

PAIR_LOG = """ln(1 - 0.1 * sqrt(CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30
  ELSE 1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)) END))"""


PAIRED = f"""CAST(1 - exp(sum({PAIR_LOG})) AS FLOAT)"""
ONE_TERM = "CAST(sum(0.1 / (n * n)) / 1.64493406685 AS FLOAT)"


def _ranked(terms: str, n_words: int) -> str:
    """Common table `ranked` (arxiv_id, rank) of the papers with all of the terms of `terms`."""
    hits = f"""hits AS (SELECT * FROM terms WHERE arxiv_id IN (
      SELECT arxiv_id FROM terms GROUP BY 1 HAVING count(DISTINCT term) = {n_words}))"""
    if n_words == 1:
        ranked = f"""ranked AS (SELECT arxiv_id, {ONE_TERM}
          AS rank FROM (SELECT arxiv_id, row_number() OVER (PARTITION BY arxiv_id ORDER BY pos) AS n
          FROM hits) GROUP BY 1)"""
    else:
        ranked = f"""ranked AS (SELECT a.arxiv_id, {PAIRED} AS rank
          FROM hits a JOIN hits b ON a.arxiv_id = b.arxiv_id AND a.term < b.term AND a.pos <> b.pos
          GROUP BY 1)"""
    return f"WITH {PAPERS}, {terms}, {hits}, {ranked}"


def _search(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return _ranked(TERMS.replace("FILTER", f"term IN ({listed})"), len(words))


# The words of the test texts, at any scale, whose stems are searched for.
STEMS = {
    "eren": """eren erenated erenates erenating erenator ereneable ereneant ereneation erened
      erenedly erener erenered erenering erenerly erenes erening ereningly erenly erenlyed
      erenlying""".split(),
    "thin": "thin thinly thinlyed thinlying".split(),
}


def _search_english() -> str:
    """The same by stems; stop words of the query match nothing but keep their places."""
    listed = ", ".join(f"'{word}'" for words in STEMS.values() for word in words)
    cases = " ".join(
        f"WHEN term IN ({', '.join(repr(w) for w in words)}) THEN '{stem}'"
        for stem, words in STEMS.items()
    )
    terms = TERMS.replace("FILTER", f"term IN ({listed})")
    terms = terms.replace("SELECT arxiv_id, term, pos", f"SELECT arxiv_id, CASE {cases} END AS term, pos")
    return _ranked(terms, len(STEMS))


RANK = "round(CAST(rank AS DOUBLE), 6) AS rank"
TOP_20 = "ORDER BY ranked.rank DESC, arxiv_id LIMIT 20"

SEARCH_BATCH = f"""WITH {PAPERS}, queries AS (
  SELECT item_id AS query_id, text FROM benchmark
  UNION ALL SELECT -1 - item_id, regexp_extract(lower(text), '{WORD}') FROM benchmark),
asked AS (
  SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term
  FROM queries), sizes AS (SELECT query_id, count(*) AS n FROM asked GROUP BY 1),
{TERMS.replace('FILTER', 'term IN (SELECT term FROM asked)')},
found AS (
  SELECT query_id, arxiv_id, n FROM (SELECT DISTINCT arxiv_id, term FROM terms) t
  JOIN asked USING (term) JOIN sizes USING (query_id)
  GROUP BY query_id, arxiv_id, n HAVING count(*) = n),
hits AS (
  SELECT query_id, arxiv_id, term, pos FROM found JOIN asked USING (query_id)
  JOIN terms USING (arxiv_id, term) WHERE n > 1),
ranked AS (
  SELECT a.query_id, a.arxiv_id, {PAIRED} AS rank
  FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.arxiv_id = b.arxiv_id
    AND a.term < b.term AND a.pos <> b.pos GROUP BY 1, 2
  UNION ALL SELECT query_id, arxiv_id, {ONE_TERM} FROM (
    SELECT query_id, arxiv_id, row_number() OVER (PARTITION BY query_id, arxiv_id ORDER BY pos) AS n
    FROM found f JOIN asked USING (query_id) JOIN terms USING (arxiv_id, term) WHERE f.n = 1)
  GROUP BY 1, 2)
SELECT query_id, arxiv_id, {RANK},
  row_number() OVER (PARTITION BY query_id ORDER BY ranked.rank DESC, arxiv_id) AS place
FROM ranked QUALIFY place <= 20"""

NEAREST = f"""WITH {VECTORS}, one AS (SELECT * FROM vectors WHERE arxiv_id = '{PAPER}')
SELECT v.arxiv_id, round({COSINE.format(a='v.embedding', b='one.embedding')}, 6) AS similarity
FROM vectors v, one WHERE v.arxiv_id <> one.arxiv_id
ORDER BY {COSINE.format(a='v.embedding', b='one.embedding')} DESC, v.arxiv_id LIMIT 10"""

NEIGHBOURS = f"""WITH {VECTORS}, pairs AS (
  SELECT a.arxiv_id, b.arxiv_id AS similar_id,
    round({COSINE.format(a='a.embedding', b='b.embedding')}, 12) AS s
  FROM vectors a JOIN vectors b ON a.arxiv_id <> b.arxiv_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY s DESC, similar_id) AS rank
  FROM pairs)
SELECT arxiv_id, similar_id, round(s, 6) AS similarity, rank FROM ranked WHERE rank <= 10"""

ASKED = "CAST(split_part(a.arxiv_id, '.', 2) AS INT) % 20 = 0"

SIMILAR_MANY = f"""WITH {VECTORS}, pairs AS (
  SELECT a.arxiv_id, b.arxiv_id AS similar_id,
    b.arxiv_id IN (SELECT {_pid('doc_id')} FROM labels) AS there,
    round({COSINE.format(a='a.embedding', b='b.embedding')}, 12) AS s
  FROM vectors a JOIN vectors b ON a.arxiv_id <> b.arxiv_id),
stored AS (SELECT * FROM pairs WHERE arxiv_id IN (SELECT {_pid('conv_id')} FROM conversations)
  QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY s DESC, similar_id) <= 10),
known AS (SELECT * FROM stored WHERE there),
filled AS (SELECT * FROM known UNION ALL SELECT * FROM pairs
  WHERE there AND arxiv_id NOT IN (SELECT arxiv_id FROM known))
SELECT arxiv_id, similar_id, round(s, 6) AS similarity,
  row_number() OVER (PARTITION BY arxiv_id ORDER BY s DESC, similar_id) AS rank
FROM filled QUALIFY rank <= 3"""

SIMILAR_RECALL = f"""WITH {VECTORS}, pairs AS (
  SELECT a.arxiv_id, b.arxiv_id AS similar_id FROM vectors a JOIN vectors b
  ON a.arxiv_id <> b.arxiv_id WHERE {ASKED}
  QUALIFY row_number() OVER (PARTITION BY a.arxiv_id ORDER BY b.arxiv_id) <= 10)
SELECT count(DISTINCT arxiv_id) AS asked, count(*) AS neighbours, true AS nine_tenths_found
FROM pairs"""

DETAIL = f"""WITH {PAPERS}, {VECTORS}, {REFS}, {DEGREES}
SELECT p.arxiv_id, title, authors, categories, {_time('published')},
  coalesce(ref_count, 0) AS ref_count, coalesce(cited_by_count, 0) AS cited_by_count,
  CASE WHEN has_full_text THEN abstract END AS full_text, len(v.embedding) AS dim
FROM papers p LEFT JOIN vectors v ON v.arxiv_id = p.arxiv_id
LEFT JOIN degrees g ON g.arxiv_id = p.arxiv_id"""

PENDING = f"""WITH {PAPERS}, {VECTORS}
SELECT arxiv_id, title, categories, {_time('published')} FROM papers
WHERE arxiv_id NOT IN (SELECT arxiv_id FROM vectors) AND abstract <> ''"""

DOCUMENT_EDGES = f"""SELECT {_pid('l_orderkey')} AS from_id, {_pid('l_partkey')} AS to_id FROM lineitem
  UNION ALL SELECT {_pid('l_suppkey')}, {_pid('l_orderkey')} FROM lineitem"""

DOCUMENT_TEXT = """CASE WHEN l_returnflag <> 'A' THEN l_returnflag ELSE '' END
  || CASE WHEN l_returnflag = 'R' THEN chr(10) || chr(10) || 'TL;DR: ' || l_linestatus ELSE '' END"""

ORACLES = {
    "normalize_ids": f"""SELECT raw, regexp_replace(replace(raw, 'oai:arXiv.org:', ''),
        '^(.+)v[0-9]+$', '\\1') AS arxiv_id
      FROM (SELECT 'oai:arXiv.org:' || {_pid('doc_id')} || 'v' || length(source) AS raw
        FROM documents)""",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "parse_dates": """SELECT event_id, strftime(ts, '%Y-%m-%d') || ' 00:00:00.000' AS from_day,
        strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000' AS from_instant,
        strftime(ts, '%Y-%m-%d %H:%M:%S') || '.250' AS from_offset,
        CAST(NULL AS VARCHAR) AS from_year, CAST(NULL AS VARCHAR) AS from_words FROM events""",
    "classify_inputs": f"""WITH inputs AS (SELECT url AS input FROM pages UNION ALL
        SELECT {_pid('doc_id')} FROM documents UNION ALL SELECT p_name FROM part UNION ALL
        SELECT text FROM documents), trimmed AS (SELECT input, {_trim('input')} AS s FROM inputs)
      SELECT input, CASE WHEN contains(s, ' ') THEN false
        WHEN strlen(s) >= 9 AND hex(encode(s))[9:10] = '2E' THEN true
        ELSE contains(s, '/') END AS is_id FROM trimmed""",
    "category_columns": f"""WITH {PAPERS} SELECT arxiv_id,
        regexp_replace(categories, '^([^.]*)\\.(.*)$', '\\1:\\1:\\2') AS harvest_set,
        split_part(categories, ',', 1) AS primary_category,
        split_part(categories, ',', 1) AS primary_any_separator,
        '/data/' || replace(split_part(categories, ',', 1), '.', '/') || '/' || arxiv_id || '.txt'
          AS path,
        'arXiv:' || arxiv_id AS request_id,
        title || chr(10) || chr(10) || abstract AS embedding_text,
        title || ' ' || abstract AS search_text FROM papers""",
    "listing": f"""WITH {PAPERS} SELECT arxiv_id,
        CASE WHEN length(title) > 80 THEN substr(title, 1, 77) || '...' ELSE title END AS title,
        coalesce(strftime(published, '%Y-%m-%d'), '') AS date,
        CASE WHEN length(categories) > 30 THEN substr(categories, 1, 27) || '...'
          ELSE categories END AS categories FROM papers""",
    "harvest_papers": HARVESTED,
    "harvest_pages": HARVESTED,
    "harvest_stream": HARVESTED,
    "harvest_changed": f"""SELECT 'oai:arXiv.org:' || {_pid('doc_id')} || 'v' || length(source)
        AS identifier, strftime(o_orderdate, '%Y-%m-%d') AS datestamp
      FROM documents JOIN orders ON o_orderkey = doc_id
      WHERE lang = 'fr' OR (lang = 'en' AND o_orderdate >= DATE '2000-01-01')""",
    "category_marks": """SELECT 'cs.' || upper(lang) AS category, count(*) AS records,
        strftime(max(o_orderdate), '%Y-%m-%d') AS datestamp
      FROM documents LEFT JOIN orders ON o_orderkey = doc_id GROUP BY 1""",
    "document_edges": f"""SELECT from_id, to_id, count(*) AS n FROM ({DOCUMENT_EDGES})
      GROUP BY 1, 2""",
    "document_texts": f"""SELECT arxiv_id, text, count(*) AS n FROM (
        SELECT {_pid('l_orderkey')} AS arxiv_id, {DOCUMENT_TEXT} AS text FROM lineitem)
      WHERE text <> '' GROUP BY 1, 2""",
    "open_access_urls": f"""SELECT {_pid('l_orderkey')} AS arxiv_id,
        'https://x/' || l_partkey AS url FROM lineitem WHERE l_linestatus = 'O'""",
    "document_files": f"""SELECT {_pid('l_orderkey')} AS arxiv_id,
        'https://x/' || l_partkey AS url FROM lineitem WHERE l_linestatus = 'O'""",
    "enrich_batches": f"""WITH {PAPERS} SELECT arxiv_id,
        CAST(length('arXiv:' || arxiv_id) AS VARCHAR) AS text FROM papers
      WHERE has_full_text = FALSE""",
    "recent_exact_category": f"""WITH {PAPERS} SELECT {LISTED} FROM papers
      WHERE papers.published >= {AS_OF} - INTERVAL 3000 DAY
        AND list_contains(string_split(categories, ','), 'cs.EN')
      ORDER BY papers.published DESC, arxiv_id LIMIT 50""",
    "recent_week": f"""WITH {PAPERS} SELECT {LISTED} FROM papers
      WHERE papers.published >= {AS_OF} - INTERVAL 7 DAY {NEWEST} LIMIT 50""",
    "recent_year": f"""WITH {PAPERS} SELECT {LISTED} FROM papers
      WHERE papers.published >= {AS_OF} - INTERVAL 365 DAY
      ORDER BY papers.published DESC, arxiv_id LIMIT 50""",
    "recent_by_category": f"""WITH {PAPERS} SELECT {LISTED} FROM papers
      WHERE papers.published >= {AS_OF} - INTERVAL 365 DAY AND categories LIKE '%' || 'cs.E' || '%'
      ORDER BY papers.published DESC, arxiv_id LIMIT 50""",
    "recent_rows": f"""WITH {PAPERS} SELECT {WHOLE} FROM papers
      WHERE papers.published >= {AS_OF} - INTERVAL 365 DAY
      ORDER BY papers.published DESC, arxiv_id LIMIT 50""",
    "similar_rows": f"""WITH {PAPERS}, near AS ({NEAREST})
      SELECT {WHOLE}, similarity FROM near JOIN papers USING (arxiv_id)""",
    "vector_checks": """SELECT vec_id, CASE WHEN label = 0 THEN 'no vector'
        WHEN label % 3 <> 0 THEN 'expected 64 dimensions, got ' || (64 - label % 3) END AS problem
      FROM embeddings""",
    "page_envelopes": """SELECT 'token' AS kind, CASE WHEN c_nationkey <> 0 THEN c_name ELSE '' END
        AS value, CAST(c_nationkey AS VARCHAR) AS code_or_size, CAST(c_custkey AS VARCHAR) AS cursor
      FROM customer UNION ALL SELECT 'error', s_name, 'badArgument', NULL FROM supplier
      WHERE s_nationkey <> 0""",
    "state_stored": """SELECT 'oai_last_cs.' || upper(lang) AS key,
        strftime(max(o_orderdate), '%Y-%m-%d') AS value
      FROM documents LEFT JOIN orders ON o_orderkey = doc_id GROUP BY 1
      UNION ALL SELECT 'other', 'kept'""",
    "sync_texts": f"""WITH papers AS ({HARVESTED}), texts AS (
        SELECT {_pid('l_orderkey')} AS arxiv_id, max({DOCUMENT_TEXT}) AS text
        FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
      SELECT arxiv_id, categories AS category, length(text) AS n_chars
      FROM texts JOIN papers USING (arxiv_id)""",
    "get_paper": f"WITH {PAPERS} SELECT {LISTED} FROM papers WHERE arxiv_id = '{PAPER}'",
    "paper_detail": f"{DETAIL} WHERE p.arxiv_id = '{PAPER}'",
    "paper_details": DETAIL,
    "pending_embedding": f"{PENDING} ORDER BY papers.published DESC NULLS LAST, arxiv_id LIMIT 500",
    "pending_embedding_all": PENDING,
    "pending_full_text": f"""WITH {PAPERS} SELECT arxiv_id, title, categories, {_time('published')}
      FROM papers WHERE has_full_text = FALSE
      ORDER BY papers.published DESC NULLS LAST, arxiv_id LIMIT 500""",
    "pending_newest": f"""WITH {PAPERS} SELECT
        row_number() OVER (ORDER BY papers.published DESC NULLS LAST, arxiv_id) AS place, arxiv_id,
        {_time('published')} FROM papers WHERE has_full_text = FALSE QUALIFY place <= 25""",
    "known_ids": f"""SELECT {_pid('p_partkey')} AS arxiv_id FROM part
      WHERE p_partkey IN (SELECT doc_id FROM documents)""",
    "unknown_ids": f"""SELECT {_pid('o_orderkey')} AS arxiv_id FROM orders
      WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)""",
    "archive_stats": f"""WITH {PAPERS}, {VECTORS}, {REFS}
      SELECT count(*) AS total_papers, count(*) FILTER (has_full_text = TRUE) AS with_full_text,
        (SELECT count(*) FROM vectors) AS with_embedding, (SELECT count(*) FROM refs) AS total_refs,
        (SELECT count(DISTINCT c) FROM (SELECT unnest(string_split(categories, ',')) AS c
          FROM papers WHERE categories <> '')) AS categories_count,
        strftime(coalesce(min(published), TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S')
          AS oldest_paper,
        strftime(coalesce(max(published), TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S')
          AS newest_paper,
        (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS last_sync,
        count(*) FILTER (published >= {AS_OF} - INTERVAL 7 DAY) AS papers_last_7_days,
        count(*) FILTER (published >= {AS_OF} - INTERVAL 30 DAY) AS papers_last_30_days
      FROM papers""",
    "category_names": f"""WITH {PAPERS} SELECT DISTINCT unnest(string_split(categories, ','))
      AS category FROM papers WHERE categories <> ''""",
    "progress": f"""WITH {PAPERS}, {VECTORS} SELECT count(*) AS total,
        count(*) FILTER (has_full_text) AS with_text,
        (SELECT count(*) FROM vectors) AS with_embedding FROM papers""",
    "refs_of": f"""WITH {PAPERS}, {REFS} SELECT {LISTED} FROM refs
      JOIN papers ON arxiv_id = to_id WHERE from_id = '{PAPER}'""",
    "cited_by": f"""WITH {PAPERS}, {REFS} SELECT {LISTED} FROM refs
      JOIN papers ON arxiv_id = from_id WHERE to_id = '{PAPER}'""",
    "ref_ids": f"WITH {REFS} SELECT to_id FROM refs WHERE from_id = '{PAPER}'",
    "cited_by_ids": f"WITH {REFS} SELECT from_id FROM refs WHERE to_id = '{PAPER}'",
    "degrees": f"WITH {REFS}, {DEGREES} SELECT * FROM degrees",
    "degree_of": f"""WITH {REFS} SELECT
        (SELECT count(*) FROM refs WHERE from_id = '{PAPER}') AS ref_count,
        (SELECT count(*) FROM refs WHERE to_id = '{PAPER}') AS cited_by_count""",
    "missing_refs": f"""WITH {PAPERS}, {REFS} SELECT arxiv_id, title FROM papers
      LEFT JOIN refs ON from_id = arxiv_id WHERE from_id IS NULL AND has_full_text""",
    "missing_ref_count": f"""WITH {PAPERS}, {REFS} SELECT count(DISTINCT arxiv_id) AS papers
      FROM papers LEFT JOIN refs ON from_id = arxiv_id WHERE from_id IS NULL AND has_full_text""",
    "fold_batch": f"""WITH {_folded(False)} SELECT arxiv_id, title, abstract, authors, categories,
        doi, has_full_text FROM folded""",
    "upsert_papers": _upsert(False),
    "upsert_papers_strict": _upsert(True),
    "upsert_papers_stored": _upsert(False),
    "insert_ignore_refs": f"""WITH {REFS} SELECT DISTINCT {_pid('l_orderkey')} AS from_id,
        {_pid('l_suppkey')} AS to_id FROM lineitem EXCEPT SELECT from_id, to_id FROM refs""",
    "insert_refs_stored": f"""SELECT {_pid('l_orderkey')} AS from_id, {_pid('l_partkey')} AS to_id
      FROM lineitem UNION SELECT {_pid('l_orderkey')}, {_pid('l_suppkey')} FROM lineitem""",
    "update_embeddings": f"""WITH {VECTORS}, last AS (
        SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 1000000000 + l_linenumber * 100000000
          + l_suppkey) AS vec_id FROM lineitem
        WHERE l_partkey IN (SELECT doc_id FROM documents) GROUP BY 1),
      changed AS (SELECT {_pid('l_partkey')} AS arxiv_id, embedding FROM last
        JOIN embeddings USING (vec_id))
      SELECT coalesce(c.arxiv_id, v.arxiv_id) AS arxiv_id,
        len(coalesce(c.embedding, v.embedding)) AS dim,
        round(coalesce(CAST(c.embedding AS DOUBLE[]), v.embedding)[1], 6) AS first
      FROM vectors v FULL OUTER JOIN changed c ON c.arxiv_id = v.arxiv_id""",
    "mark_full_text": f"""WITH {PAPERS}, marks AS (
        SELECT {_pid('doc_id')} AS id, 'texts/' || quality AS path FROM labels)
      SELECT arxiv_id, has_full_text OR id IS NOT NULL AS has_full_text,
        coalesce(path, full_text_path) AS full_text_path
      FROM papers LEFT JOIN marks ON id = arxiv_id""",
    "kv_upsert": """WITH latest AS (SELECT CAST(user_id AS VARCHAR) AS key,
        arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY 1),
      old AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value FROM orders)
      SELECT coalesce(n.key, o.key) AS key,
        CASE WHEN n.key IS NOT NULL THEN n.value ELSE o.value END AS value
      FROM old o FULL OUTER JOIN latest n ON o.key = n.key""",
    "token_counts": f"""SELECT token, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM documents)
      GROUP BY 1""",
    "postings": f"""WITH {PAPERS}, {TERMS.replace('FILTER', 'true')}
      SELECT term, arxiv_id, count(*) AS n, min(pos) AS first, max(pos) AS last FROM terms
      GROUP BY 1, 2""",
    "search_one_word": f"{_search(['thin'])} SELECT arxiv_id, {RANK} FROM ranked {TOP_20}",
    "search_two_words": f"{_search(['thin', 'than'])} SELECT arxiv_id, {RANK} FROM ranked {TOP_20}",
    "search_matches": f"{_search(['thin', 'than', 'from'])} SELECT arxiv_id, {RANK} FROM ranked",
    "search_index": f"""{_search(['thin', 'than', 'from'])}
      SELECT title, arxiv_id, {RANK} FROM ranked JOIN papers USING (arxiv_id) {TOP_20}""",
    "search_english": f"{_search_english()} SELECT arxiv_id, {RANK} FROM ranked {TOP_20}",
    "search_index_english": f"""{_search_english()}
      SELECT arxiv_id, title, abstract, authors, categories, {_time('published')},
        {_time('updated')}, CAST(NULL AS VARCHAR) AS doi, CAST(NULL AS VARCHAR) AS journal_ref,
        has_full_text, CAST(NULL AS VARCHAR) AS fetched_at, {RANK}
      FROM ranked JOIN papers USING (arxiv_id) {TOP_20}""",
    "search_batch": SEARCH_BATCH,
    "similar_by_id": NEAREST,
    "similar_ivf": NEAREST,
    "similar_ivf_cells": NEAREST,
    "similar_precomputed": NEAREST,
    "similar_by_vector": NEAREST.replace("WHERE v.arxiv_id <> one.arxiv_id", ""),
    "cosine_columns": NEAREST.replace("WHERE v.arxiv_id <> one.arxiv_id", "").split("ORDER BY")[0],
    "build_similar": NEIGHBOURS,
    "similar_filled": NEIGHBOURS,
    "similar_many": SIMILAR_MANY,
    "similar_recall": SIMILAR_RECALL,
    "similar_by_letters": f"""WITH {PAPERS}, texts AS (
        SELECT arxiv_id, title || chr(10) || chr(10) || abstract AS t FROM papers),
      counted AS (SELECT arxiv_id, [length(t) - length(replace(t, 'e', '')),
        length(t) - length(replace(t, 'n', '')), length(t)]::DOUBLE[] AS v FROM texts)
      SELECT arxiv_id, round(s, 6) AS similarity FROM (
        SELECT arxiv_id, round(list_cosine_similarity(v, [0, 2, 11]::DOUBLE[]), 12) AS s FROM counted)
      ORDER BY s DESC, arxiv_id LIMIT 10""",
    "similar_lookup": NEAREST,
    "build_similar_blocks": NEIGHBOURS,
    "embed_pending": f"""SELECT arxiv_id, 64 AS dim,
        CASE WHEN regexp_matches(abstract, '{WORD}') THEN 1.0 ELSE 0.0 END AS norm
      FROM (WITH {PAPERS}, {VECTORS} SELECT * FROM papers
        WHERE arxiv_id NOT IN (SELECT arxiv_id FROM vectors) AND abstract <> '')""",
    "embed_batches": f"""WITH {PAPERS}, texts AS (
        SELECT arxiv_id, title || chr(10) || chr(10) || abstract AS t FROM papers)
      SELECT arxiv_id, length(t) - length(replace(t, 'e', '')) AS v1,
        length(t) - length(replace(t, 'n', '')) AS v2, length(t) AS v3, false AS failed FROM texts""",
    "answer_lines": f"""WITH {PAPERS}, {REFS} SELECT arxiv_id, title,
        strftime(published, '%Y-%m-%dT%H:%M:%SZ') AS published
      FROM refs JOIN papers ON arxiv_id = from_id WHERE to_id = '{PAPER}'""",
    "answer_cited_by": f"""WITH {PAPERS}, {REFS}, found AS (SELECT papers.* FROM refs
        JOIN papers ON arxiv_id = from_id WHERE to_id = '{PAPER}')
      SELECT 'cited_by' AS part, arxiv_id, title,
        strftime(published, '%Y-%m-%dT%H:%M:%SZ') AS published,
        CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BIGINT) AS count FROM found
      UNION ALL SELECT 'header', NULL, NULL, NULL, '{PAPER}', count(*) FROM found""",
    "answer_refs": f"""WITH {PAPERS}, {REFS}, found AS (SELECT papers.* FROM refs
        JOIN papers ON arxiv_id = to_id WHERE from_id = '{PAPER}')
      SELECT 'refs' AS part, arxiv_id, title,
        strftime(published, '%Y-%m-%dT%H:%M:%SZ') AS published,
        CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BIGINT) AS count FROM found
      UNION ALL SELECT 'header', NULL, NULL, NULL, '{PAPER}', count(*) FROM found""",
    "answer_recent": f"""WITH {PAPERS}, top AS (SELECT arxiv_id, published FROM papers
        WHERE published >= {AS_OF} - INTERVAL 365 DAY
        ORDER BY published DESC, arxiv_id LIMIT 50)
      SELECT '' AS category, 365 AS days, (SELECT count(*) FROM top) AS count,
        row_number() OVER (ORDER BY published DESC, arxiv_id) - 1 AS place, arxiv_id FROM top""",
    "full_text_store": f"""WITH {PAPERS} SELECT arxiv_id,
        CASE WHEN has_full_text THEN length(abstract) END AS n_chars FROM papers""",
    "sync_run": f"""WITH papers AS ({HARVESTED}), edges AS (
        SELECT DISTINCT from_id, to_id FROM ({DOCUMENT_EDGES}) e
        JOIN papers p ON p.arxiv_id = e.owner),
      texts AS (SELECT DISTINCT {_pid('l_orderkey')} AS arxiv_id FROM lineitem
        WHERE l_returnflag <> 'A' AND {_pid('l_orderkey')} IN (SELECT arxiv_id FROM papers))
      SELECT count(*) AS total, (SELECT count(*) FROM texts) AS with_text,
        count(*) FILTER (abstract <> '') AS with_embedding,
        (SELECT count(*) FROM texts) AS texts, (SELECT count(*) FROM edges) AS edges,
        (SELECT count(*) FROM edges) AS edges_by_target,
        (SELECT count(*) FROM texts WHERE arxiv_id NOT IN (SELECT from_id FROM edges))
          AS missing_refs
      FROM papers""".replace(
        DOCUMENT_EDGES,
        f"""SELECT {_pid('l_orderkey')} AS from_id, {_pid('l_partkey')} AS to_id,
          {_pid('l_orderkey')} AS owner FROM lineitem
          UNION ALL SELECT {_pid('l_suppkey')}, {_pid('l_orderkey')}, {_pid('l_orderkey')}
          FROM lineitem""",
    ),
}

for _name, _sql in (("postings", ORACLES["postings"]), ("search", SEARCH_BATCH)):
    ORACLES[f"{_name}_after_upsert"] = _sql.replace(PAPERS, f"papers AS ({_upsert(False)})")

_RUN = {
    "harvested_papers": "total", "fetched": "texts", "failed": "0", "edges": "edges",
    "embedded": "with_embedding", "embed_failed": "0", "missing_refs": "missing_refs",
}
ORACLES["sync_record"] = f"WITH run AS ({ORACLES['sync_run']})" + " UNION ALL ".join(
    f" SELECT 'run_{name}' AS key, CAST({value} AS VARCHAR) AS value FROM run"
    for name, value in _RUN.items()
) + " UNION ALL SELECT 'last_sync', '2001-08-02T00:00:00Z'"
