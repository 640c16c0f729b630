"""Named queries over the driver's tables, and the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeview.functions import text as X
from lodeview.operators import extract, index, scoring, search
from lodeview.plans import corpus, globs
from lodeview.plans.query import analyse

Query = Callable[[SparkSession, str], DataFrame]

#: The questions that the single-question queries ask.
ASKED = "the server reports with thing screenshot"
FIND = {"find_topk": ASKED, "find_text": "than ering enter", "find_repo": "treegrapht", "find_plural": "which recipes were for the travels"}
#: Questions that are asked together.
MANY = ("than erings", "eres", "thor-whed", "of the ther", "nothing here matches zzzz", "que verb")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


_WITH = f"WITH files AS ({corpus.FILES}), repos AS ({corpus.REPOS}), blobs AS ({corpus.BLOBS}), ev AS ({corpus.EVENTS})"


# -- names, kinds and identities ------------------------------------------------------------------


@_query(f"{_WITH} SELECT path, sha1(path) AS id FROM files")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select("path", X.stable_id(F.col("path")).alias("id"))


@_query(f"{_WITH} SELECT path, concat(path, ':', size_bytes::VARCHAR, ':', floor(size_bytes * 1.5)::BIGINT::VARCHAR) AS fingerprint FROM files")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select("path", X.fingerprint(F.col("path"), F.col("size_bytes"), F.col("size_bytes") * 1.5).alias("fingerprint"))


_list = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_KIND_SQL = f"""CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext = '.docx' THEN 'docx' WHEN base IN {_list(extract.MANIFESTS)} THEN 'package_manifest'
    WHEN base = 'readme' OR starts_with(base, 'readme.') THEN 'readme' WHEN ext IN {_list(extract.MARKDOWN)} THEN 'markdown'
    WHEN ext IN {_list(extract.PLAIN)} OR base IN {_list(extract.PLAIN_NAMES)} THEN 'plain_text' ELSE 'unsupported' END"""
_TYPE_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in extract.EXTRACTORS.items()) + " END"
_MIXED_PATHS = """SELECT CASE doc_id % 6 WHEN 0 THEN concat('/x/README-', doc_id::VARCHAR, '.md') WHEN 1 THEN concat('/x/', doc_id::VARCHAR, '/ReadMe.txt') WHEN 2 THEN concat('/x/', doc_id::VARCHAR, '/package.json')
    WHEN 3 THEN concat('/x/', doc_id::VARCHAR, '/.npmrc') WHEN 4 THEN concat('/x/', doc_id::VARCHAR, '.tar.PDF') ELSE path END AS path FROM files"""


def _mixed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p, s = F.col("doc_id") % 6, F.lit("/x/"), F.col("doc_id").cast("string")
    return corpus.files(spark, sf_dir).select(
        F.when(k == 0, F.concat(F.lit("/x/README-"), s, F.lit(".md"))).when(k == 1, F.concat(p, s, F.lit("/ReadMe.txt"))).when(k == 2, F.concat(p, s, F.lit("/package.json")))
        .when(k == 3, F.concat(p, s, F.lit("/.npmrc"))).when(k == 4, F.concat(p, s, F.lit(".tar.PDF"))).otherwise(F.col("path")).alias("path")
    )


@_query(f"""{_WITH}, p AS ({_MIXED_PATHS}), b AS (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS base FROM p),
    e AS (SELECT *, regexp_extract(base, '^.+(\\.[^.]*)$', 1) AS ext FROM b), k AS (SELECT path, {_KIND_SQL} AS kind FROM e) SELECT path, kind, {_TYPE_SQL} AS extractor_type FROM k""")
def kind_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed_paths(spark, sf_dir).withColumn("kind", extract.kind(F.col("path"))).withColumn("extractor_type", extract.extractor_type(F.col("kind")))


@_query(f"""{_WITH} SELECT path, coalesce(regexp_matches(lower(path), '\\.(png|jpg|jpeg|gif|webp|bmp|tif|tiff|heic|svg)$'), false) AS is_image,
    contains(lower(path), '/screenshots/') OR contains(lower(path), '/screenshot/') OR contains(lower(name), 'screenshot') OR contains(lower(name), 'screen shot') OR starts_with(lower(name), 'shot-') AS is_screenshot FROM files""")
def screenshot_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select("path", extract.is_image(F.col("path")).alias("is_image"), extract.is_screenshot(F.col("path")).alias("is_screenshot"))


@_query(f"""{_WITH} SELECT path FROM files WHERE NOT regexp_matches(concat('/', path, '/'), '/(node_modules|\\.git|\\.pgdata|\\.cache|Library|__pycache__|\\.venv|venv|vendor|dist|build|\\.next|coverage)/')""")
def glob_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select("path").filter(~globs.excluded(F.col("path")))


# -- incremental scan ---------------------------------------------------------------------------------


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir)
    size = F.col("size_bytes") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)
    return f.select("id", "path", "extension", "doc_id", size.alias("size_bytes"), X.fingerprint(F.col("path"), size, F.lit(0)).alias("fingerprint"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir).filter("doc_id % 3 <> 0")
    return f.withColumn("metadata_json", F.to_json(F.struct(X.fingerprint(F.col("path"), F.col("size_bytes"), F.lit(0)).alias("scanFingerprint"))))


_REUSE = "(doc_id % 3 <> 0 AND doc_id % 4 <> 0)"


@_query(f"{_WITH} SELECT path, {_REUSE} AS reused FROM files")
def scan_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.split_by_reuse(_listing(spark, sf_dir), _stored(spark, sf_dir)).select("path", "reused")


@_query(f"""{_WITH} SELECT count(*) FILTER (NOT {_REUSE})::BIGINT AS indexed, count(*) FILTER ({_REUSE})::BIGINT AS reused, count(*) FILTER (extension NOT IN ('png', 'bin') AND NOT {_REUSE})::BIGINT AS text_extractions,
    count(*) FILTER (extension = 'png' AND NOT {_REUSE})::BIGINT AS image_summaries, count(*) FILTER (extension = 'png' AND NOT {_REUSE} AND (doc_id % 8 = 3 OR contains(name, 'screenshot')))::BIGINT AS ocr_extractions FROM files""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.split_by_reuse(_listing(spark, sf_dir), _stored(spark, sf_dir))
    p = F.col("path")
    return index.scan_summary(rows.select("reused", (~F.col("reused") & (extract.kind(p) != "unsupported")).alias("text"), extract.is_image(p).alias("image"), extract.wants_ocr(p, F.col("size_bytes"), "screenshots").alias("ocr")))


@_query(f"{_WITH} SELECT source_id, source_type, extractor_type FROM blobs WHERE seq % 5 = 0")
def missing_blob_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = corpus.blobs(spark, sf_dir)
    return index.missing_blobs(b.select(*index.KEY), b.filter("seq % 5 <> 0"))


@_query(f"""{_WITH}, n AS (SELECT * FROM files WHERE doc_id % 2 = 0 UNION ALL SELECT * FROM files WHERE doc_id % 4 = 0)
    SELECT path, id, created_at, CASE WHEN doc_id % 4 = 0 THEN concat(modified_at, '+') ELSE modified_at END AS modified_at FROM (SELECT DISTINCT * FROM files WHERE doc_id % 3 = 0 OR doc_id % 2 = 0)""")
def upsert_latest_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir).select("path", "id", "created_at", "modified_at", "doc_id")
    again = f.filter("doc_id % 4 = 0").withColumns({"modified_at": F.concat("modified_at", F.lit("+")), "created_at": F.lit("later")})
    new = index.latest_by(f.filter("doc_id % 2 = 0").unionByName(again.withColumn("created_at", F.col("created_at"))), "path", "modified_at")
    new = new.join(f.select(F.col("path").alias("p"), F.col("created_at").alias("c")), F.col("path") == F.col("p")).withColumn("created_at", F.col("c")).drop("p", "c")
    return index.upsert_files(f.filter("doc_id % 3 = 0"), new.select(*f.columns)).drop("doc_id")


@_query(f"""{_WITH}, f AS (SELECT extension, count(*) AS n_files, count(b.source_id) AS n_texts, coalesce(sum(length(b.content)), 0)::BIGINT AS n_chars FROM files LEFT JOIN blobs AS b ON files.id = b.source_id GROUP BY extension)
    SELECT extension, n_files::BIGINT AS n_files, n_texts::BIGINT AS n_texts, n_chars FROM f""")
def extraction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, b = corpus.files(spark, sf_dir), corpus.blobs(spark, sf_dir)
    return f.join(b, f["id"] == b["source_id"], "left").groupBy("extension").agg(F.count(F.lit(1)).alias("n_files"), F.count("source_id").alias("n_texts"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n_chars"))


@_query(f"""{_WITH} SELECT id, CASE WHEN doc_id % 2 = 0 THEN concat('{{"a":"1","b":"', doc_id::VARCHAR, '","c":"3"}}') ELSE '{{"a":"1","b":"2"}}' END AS metadata_json FROM files""")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir)
    old = f.select("id", F.lit('{"b":"2","a":"1"}').alias("metadata_json"))
    new = f.select("id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"c":"3","b":"'), F.col("doc_id").cast("string"), F.lit('"}'))).otherwise("not json").alias("metadata_json"))
    return index.merge_metadata(old, new)


# -- candidates ---------------------------------------------------------------------------------------------


def _like_sql(column: str, stems: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"translate({column}, '{X.UPPER}', '{X.LOWER}') LIKE '%{s}%'" for s in stems) + ")"


_Q = analyse(ASKED)
_NAMES = f"SELECT *, 0 AS phase FROM (SELECT * FROM files WHERE {_like_sql('name', _Q.stems)} ORDER BY modified_at DESC NULLS LAST, id LIMIT 150)"
_PATHS = f"SELECT *, 1 AS phase FROM (SELECT * FROM files WHERE {_like_sql('path', _Q.stems)} ORDER BY modified_at DESC NULLS LAST, id LIMIT 30)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of files, a projection of their table: what asks only of these builds no index."""
    return corpus.files(spark, sf_dir)


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored inverted index."""
    return corpus.stored(spark, sf_dir).read("postings")


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Files, repositories and texts."""
    return [corpus.files(spark, sf_dir), corpus.repos(spark, sf_dir), corpus.texts(spark, sf_dir)]


@_query(f"{_WITH} SELECT id, name FROM ({_NAMES})")
def name_like_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.name_candidates(_files(spark, sf_dir), _Q).select("id", "name")


@_query(f"{_WITH} SELECT id, path FROM ({_PATHS})")
def path_like_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.path_candidates(_files(spark, sf_dir), _Q).select("id", "path")


@_query(f"{_WITH} SELECT id, min(phase)::INTEGER AS phase FROM ({_NAMES} UNION ALL {_PATHS}) GROUP BY id")
def candidate_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.file_candidates(_files(spark, sf_dir), _Q).select("id", "phase")


@_query(f"""{_WITH} SELECT id, repo_name FROM repos WHERE {_like_sql('repo_name', _Q.stems)} OR {_like_sql("coalesce(remote_url, '')", _Q.stems)} OR {_like_sql('root_path', _Q.stems)} ORDER BY last_commit_at DESC NULLS LAST, id LIMIT 25""")
def repo_like_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.repo_candidates(corpus.repos(spark, sf_dir), _Q).select("id", "repo_name")


_T = analyse("than erings")
_TERMS = [t[0] for t in _T.index_terms]
_WORDS_SQL = f"regexp_extract_all(translate(lower(content), '{X.ACCENTED}', '{X.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"
_HAS = [f"len(list_filter({_WORDS_SQL}, lambda w: starts_with(w, '{t}'))) > 0" for t in _TERMS]
_STRICT = f"SELECT *, true AS strict FROM (SELECT * FROM blobs WHERE {' AND '.join(_HAS)} ORDER BY seq LIMIT 30)"
_LOOSE = f"SELECT *, false AS strict FROM (SELECT * FROM blobs WHERE {' OR '.join(_HAS)} ORDER BY seq LIMIT 30)"


@_query(f"{_WITH} SELECT source_id, extractor_type, seq FROM ({_LOOSE})")
def fts_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_sources(search.text_matches(_postings(spark, sf_dir), _T).orderBy("seq").limit(search.TEXT_CAP), corpus.texts(spark, sf_dir)).select("source_id", "extractor_type", "seq")


@_query(f"{_WITH} SELECT source_id, extractor_type, seq FROM ({_STRICT})")
def fts_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_sources(search.text_matches(_postings(spark, sf_dir), _T).filter("strict").orderBy("seq").limit(search.TEXT_CAP), corpus.texts(spark, sf_dir)).select("source_id", "extractor_type", "seq")


@_query(f"{_WITH} SELECT source_id, extractor_type, bool_or(strict) AS strict FROM ({_STRICT} UNION ALL {_LOOSE}) GROUP BY source_id, source_type, extractor_type")
def fts_strict_then_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_sources(search.text_candidates(_postings(spark, sf_dir), _T), corpus.texts(spark, sf_dir)).select("source_id", "extractor_type", "strict")


def _term_sql(term: list[str]) -> str:
    """Whether the word list ``ws`` holds a term, its parts one after another."""
    tests = [f"starts_with(ws[i + {k}], '{t}')" if k == len(term) - 1 else f"ws[i + {k}] = '{t}'" for k, t in enumerate(term)]
    return f"len(list_filter(range(1, len(ws) - {len(term) - 2}), lambda i: {' AND '.join(tests)})) > 0"


def _many_sql() -> str:
    parts = []
    for n, question in enumerate(MANY):
        has = [_term_sql(t) for t in analyse(question).index_terms]
        for strict, test in ((True, " AND ".join(has) if len(has) > 1 else "false"), (False, " OR ".join(has))):
            parts.append(f"SELECT {n} AS question, source_id, extractor_type, {strict} AS strict FROM (SELECT * FROM words WHERE {test} ORDER BY seq LIMIT 30)")
    return f"{_WITH}, words AS (SELECT source_id, source_type, extractor_type, seq, {_WORDS_SQL} AS ws FROM blobs) SELECT question::INTEGER AS question, source_id, extractor_type, bool_or(strict) AS strict FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY question, source_id, extractor_type")


@_query(_many_sql())
def fts_many_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many questions, one of them with a phrase, in one job."""
    return search.with_sources(search.text_candidates_of_many(_postings(spark, sf_dir), list(MANY)), corpus.texts(spark, sf_dir)).select("question", "source_id", "extractor_type", "strict")


_PREFIXES = ("tha", "erin", "ver", "que", "mento")


@_query(f"{_WITH} " + " UNION ALL ".join(f"""SELECT '{p}' AS prefix, count(*) FILTER (n > 0)::BIGINT AS n_texts, sum(n)::BIGINT AS n_places
    FROM (SELECT len(list_filter({_WORDS_SQL}, lambda w: starts_with(w, '{p}'))) AS n FROM blobs)""" for p in _PREFIXES))
def prefix_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many prefixes in one job, through the inverted index."""
    asked = spark.createDataFrame([(p,) for p in _PREFIXES], "prefix string")
    hit = index.prefix_lookup(_postings(spark, sf_dir), asked)
    return hit.groupBy("prefix").agg(F.countDistinct(*index.PLACE).alias("n_texts"), F.sum(F.size("places")).alias("n_places"))


# -- scores ---------------------------------------------------------------------------------------------------


def _sep(x: str) -> str:
    return f"regexp_replace(lower({x}), '[-_/\\\\.]+', ' ', 'g')"


def _string_sql(q, hay: str, base: int) -> str:
    h = _sep(hay)
    hits = " + ".join(f"CASE WHEN contains({h}, '{w}') OR contains({h}, '{s}') THEN 5 ELSE 0 END" for w, s in ((w, analyse(w).stems[0] if analyse(w).stems else w) for w in q.words))
    return f"(CASE WHEN contains({h}, '{q.text}') THEN {base + 40} ELSE {base} + {hits} END)"


def _bonus_sql(q) -> str:
    tests = [f"CASE WHEN regexp_matches(lower(name), '(?:^|[^a-z0-9]){w}(?:$|[^a-z0-9])') THEN 40 WHEN contains(lower(name), '{w}') THEN 15 ELSE 0 END" for word in q.words for w in {word, *analyse(word).stems} if len(w) >= 2]
    return f"greatest(0, {', '.join(tests)})"


def _hint_sql(q) -> str:
    parts = ["0"]
    if "image" in q.hints:
        parts.append("CASE WHEN json_extract_string(metadata_json, '$.fileCategory') = 'image' THEN 20 ELSE 0 END")
    if "screenshot" in q.hints:
        parts.append("CASE WHEN json_extract_string(metadata_json, '$.isScreenshot') = 'true' THEN 30 ELSE 0 END")
    if "pdf" in q.hints:
        parts.append("CASE WHEN lower(extension) = 'pdf' THEN 20 ELSE 0 END")
    if "download" in q.hints:
        parts.append("CASE WHEN contains(lower(path), '/downloads/') THEN 20 ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


def _quality_sql(p: str, repo: bool = False) -> str:
    noise = " + ".join(f"CASE WHEN contains(lower({p}), '{s}') THEN {-60 if repo else -45} ELSE 0 END" for s in scoring.NOISY)
    good = " + ".join(f"CASE WHEN contains(lower({p}), '{s}') THEN 5 ELSE 0 END" for s in ("/downloads/", "/pictures/"))
    work = " OR ".join(f"contains(lower({p}), '{s}')" for s in ("/projects/", "/work/", "/src/"))
    return f"({noise} + {good} + CASE WHEN {work} THEN 12 ELSE 0 END - least(greatest(len(list_filter(string_split({p}, '/'), lambda x: x <> '')) - 6, 0) * 2, 20))"


_S = analyse("server notes images screenshot pdf downloads")


@_query(f"{_WITH} SELECT id, {_string_sql(_S, chr(39) + chr(39) + ' || name || ' + chr(39) + ' ' + chr(39) + ' || path', 100)}::INTEGER AS score FROM files")
def string_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select("id", scoring.string_score(_S, F.concat("name", F.lit(" "), "path")).cast("int").alias("score"))


@_query(f"{_WITH} SELECT id, {_bonus_sql(_S)}::INTEGER AS bonus FROM files")
def name_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select("id", scoring.name_bonus(_S, F.col("name")).cast("int").alias("bonus"))


@_query(f"{_WITH} SELECT id, {_hint_sql(_S)}::INTEGER AS points FROM files")
def source_hint_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select("id", scoring.source_hint_score(_S, F.col("metadata_json"), F.col("extension"), F.col("path")).cast("int").alias("points"))


@_query(f"""{_WITH} SELECT source_id, extractor_type, (CASE WHEN starts_with(extractor_type, 'screenshot_') THEN 28 WHEN starts_with(extractor_type, 'image_') THEN 24 WHEN extractor_type = 'application/pdf' THEN 24 ELSE 0 END)::INTEGER AS points FROM blobs""")
def blob_hint_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.blobs(spark, sf_dir).select("source_id", "extractor_type", scoring.blob_hint_score(_S, F.col("extractor_type")).cast("int").alias("points"))


@_query(f"{_WITH} SELECT path, {_quality_sql('path')}::INTEGER AS as_file, {_quality_sql('path', True)}::INTEGER AS as_repo FROM files")
def path_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return corpus.files(spark, sf_dir).select("path", scoring.path_quality(p).cast("int").alias("as_file"), scoring.path_quality(p, True).cast("int").alias("as_repo"))


def _like_one(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length('{a}'), length({b})) > 0 THEN 1 - levenshtein('{a}', {b})::DOUBLE / greatest(length('{a}'), length({b})) ELSE 0 END"


def _similar_sql(q, name: str) -> str:
    spaced = _sep(name)
    parts = ["0.0"]
    if len(q.words) <= 1:
        parts += [_like_one(q.text, spaced), _like_one(q.text, _sep(f"regexp_replace({name}, '\\.[^.]+$', '')"))]
    for w in q.words:
        if len(w) >= 3:
            one = _like_one(w, "n").replace(chr(10), " ")
            parts.append(f"coalesce(list_max(list_transform(list_filter(string_split_regex({spaced}, '\\s+'), lambda n: length(n) >= 3), lambda n: {one})), 0.0)")
    return f"greatest({', '.join(parts)})"


_F = analyse("biling portl")


@_query(f"{_WITH} SELECT id, round(similarity, 6) AS similarity FROM (SELECT id, {_similar_sql(_F, 'name')} AS similarity FROM (SELECT * FROM files ORDER BY modified_at DESC NULLS LAST, id LIMIT 5000)) WHERE similarity >= 0.72")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy_files(_files(spark, sf_dir), _F).select("id", F.round("similarity", 6).alias("similarity"))


# -- the whole search -------------------------------------------------------------------------------------


def _find_sql(question: str, where: str = "true", limit: int = 10) -> str:
    """The search without reasons, from the same caps and scores, as set operations."""
    q = analyse(question)
    terms = q.index_terms
    has = [f"len(list_filter({_WORDS_SQL}, lambda w: starts_with(w, '{t[0]}'))) > 0" for t in terms]
    strict = f"SELECT *, true AS strict FROM (SELECT * FROM blobs WHERE {' AND '.join(has)} ORDER BY seq LIMIT {30 if len(has) > 1 else 0})"
    loose = f"SELECT *, false AS strict FROM (SELECT * FROM blobs WHERE {' OR '.join(has)} ORDER BY seq LIMIT 30)"
    file_score = f"{_string_sql(q, chr(39) + chr(39) + ' || name || ' + chr(39) + ' ' + chr(39) + ' || path', 100)} + {_bonus_sql(q)} + {_hint_sql(q)} + {_quality_sql('path')}"
    repo_hay = "repo_name || ' ' || root_path || ' ' || coalesce(remote_url, '')"
    blob = []
    if "screenshot" in q.hints:
        blob.append("WHEN starts_with(extractor_type, 'screenshot_') THEN 28")
    if "image" in q.hints:
        blob += ["WHEN starts_with(extractor_type, 'image_') THEN 24", "WHEN starts_with(extractor_type, 'screenshot_') THEN 18"]
    if "pdf" in q.hints:
        blob.append("WHEN extractor_type = 'application/pdf' THEN 24")
    points = f"(CASE {' '.join(blob)} ELSE 0 END)" if blob else "0"
    return f"""{_WITH},
    nm AS (SELECT *, 0 AS phase FROM (SELECT * FROM files WHERE {_like_sql('name', q.stems)} ORDER BY modified_at DESC NULLS LAST, id LIMIT 150)),
    pt AS (SELECT *, 1 AS phase FROM (SELECT * FROM files WHERE {_like_sql('path', q.stems)} ORDER BY modified_at DESC NULLS LAST, id LIMIT 30)),
    fr AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY modified_at DESC NULLS LAST, id) AS place FROM (SELECT * FROM nm UNION ALL SELECT * FROM pt) QUALIFY row_number() OVER (PARTITION BY id ORDER BY phase) = 1),
    rr AS (SELECT *, row_number() OVER (ORDER BY last_commit_at DESC NULLS LAST, id) AS place FROM (SELECT * FROM repos WHERE {_like_sql('repo_name', q.stems)} OR {_like_sql("coalesce(remote_url, '')", q.stems)}
           OR {_like_sql('root_path', q.stems)} ORDER BY last_commit_at DESC NULLS LAST, id LIMIT 25)),
    base AS (SELECT id, 'file' AS result_type, name AS title, path, {file_score} AS score, modified_at AS last_modified, phase, place FROM fr
             UNION ALL SELECT id, 'repo', repo_name, root_path, {_string_sql(q, repo_hay, 120)} + {_quality_sql('root_path', True)}, last_commit_at, 2, place FROM rr),
    tx AS (SELECT *, row_number() OVER (ORDER BY strict DESC, seq) AS place FROM (SELECT * FROM ({strict}) UNION ALL SELECT * FROM ({loose})) QUALIFY row_number() OVER (PARTITION BY source_id, source_type, extractor_type ORDER BY strict DESC, seq) = 1),
    per AS (SELECT source_id, source_type, count(*) AS n, sum((CASE WHEN strict THEN {min(12 * len(q.words), 70)} ELSE 0 END) + {points}) AS boost, min(place) AS place FROM tx GROUP BY source_id, source_type),
    own AS (SELECT per.*, name AS title, path, modified_at AS last_modified, 125 + {_quality_sql('path')} AS b FROM per JOIN files ON id = source_id AND source_type = 'file'
            UNION ALL SELECT per.*, repo_name, root_path, last_commit_at, 135 + {_quality_sql('root_path', True)} FROM per JOIN repos ON id = source_id AND source_type = 'repo'),
    named AS (SELECT base.id, result_type, base.title, base.path, base.score + coalesce(boost + 35 * n, 0) AS score, base.last_modified, phase, base.place FROM base LEFT JOIN own ON base.id = own.source_id
              UNION ALL SELECT source_id, source_type, title, path, b + boost + 35 * (n - 1), last_modified, 3, place FROM own WHERE source_id NOT IN (SELECT id FROM base)),
    ff AS (SELECT *, {_similar_sql(q, 'name')} AS sim FROM (SELECT * FROM files ORDER BY modified_at DESC NULLS LAST, id LIMIT {5000 if len(q.text) >= 4 else 0})),
    fz AS (SELECT *, {_similar_sql(q, 'repo_name')} AS sim FROM (SELECT * FROM repos ORDER BY last_commit_at DESC NULLS LAST, id LIMIT {1000 if len(q.text) >= 4 else 0})),
    fuzzy AS (SELECT id, 'file' AS result_type, name AS title, path, 70 + floor(sim * 50 + 0.5) + {_hint_sql(q)} + {_quality_sql('path')} AS score, modified_at AS last_modified, 4 AS phase,
                     row_number() OVER (ORDER BY modified_at DESC NULLS LAST, id) AS place FROM ff WHERE sim >= 0.72
              UNION ALL SELECT id, 'repo', repo_name, root_path, 72 + floor(sim * 55 + 0.5) + {_quality_sql('root_path', True)}, last_commit_at, 5, row_number() OVER (ORDER BY last_commit_at DESC NULLS LAST, id) FROM fz WHERE sim >= 0.72)
    SELECT id AS result_id, result_type, title, path, score::INTEGER AS score, last_modified FROM (SELECT * FROM named UNION ALL SELECT * FROM fuzzy WHERE id NOT IN (SELECT id FROM named)) WHERE {where} ORDER BY score DESC, phase, place LIMIT {limit}"""


def _find(question: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    (f, r, b), p = _tables(spark, sf_dir), _postings(spark, sf_dir)
    return search.find(f, r, b, question, postings=p, snippets=False).drop("why_matched")


for _name, _question in FIND.items():
    _QUERIES[_name] = partial(_find, _question)
    _SQL[_name] = _find_sql(_question)


@_query(_find_sql(ASKED, "result_type = 'file' AND starts_with(path, '/home/u/work') AND last_modified >= '2026-03-01'", 5))
def find_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    (f, r, b), p = _tables(spark, sf_dir), _postings(spark, sf_dir)
    found = search.find(f, r, b, ASKED, postings=p, snippets=False, kinds=["file"], path_prefix="/home/u/work", since="2026-03-01", limit=5)
    return found.drop("why_matched")


@_query()
def find_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search with reasons and snippets; tests hold snippets against those of SQLite's full-text engine."""
    (f, r, b), p = _tables(spark, sf_dir), _postings(spark, sf_dir)
    return search.find(f, r, b, "than ering enter", postings=p)


@_query(f"""{_WITH} SELECT source_id, count(*)::BIGINT AS n_hits, (sum(CASE WHEN strict THEN 24 ELSE 0 END) + 35 * count(*))::BIGINT AS points FROM
    (SELECT source_id, bool_or(strict) AS strict FROM ({_STRICT} UNION ALL {_LOOSE}) GROUP BY source_id, source_type, extractor_type) GROUP BY source_id""")
def text_hit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = search.with_sources(search.text_candidates(_postings(spark, sf_dir), _T), corpus.texts(spark, sf_dir))
    return t.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_hits"), (F.sum(F.when(F.col("strict"), min(12 * len(_T.words), 70)).otherwise(0)) + 35 * F.count(F.lit(1))).alias("points"))


_ONE = "/home/u/Downloads/budget_notes-1.txt"


@_query(f"""{_WITH} SELECT 'file' AS kind, f.id, f.path, f.name, f.modified_at, b.extractor_type, substring(b.content, 1, 160) AS snippet FROM files AS f JOIN blobs AS b ON b.source_id = f.id WHERE f.id = sha1('{_ONE}')""")
def record_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    one = search.get_record(*_tables(spark, sf_dir), hashlib.sha1(_ONE.encode()).hexdigest())
    return one.select("kind", "id", "path", "name", "modified_at", F.inline("blobs"))


_RECENT = "SELECT id AS result_id, 'file' AS result_type, name AS title, path, 'Recently modified' AS why_matched, 0 AS score, modified_at AS last_modified FROM files"


@_query(f"{_WITH} {_RECENT} ORDER BY modified_at DESC NULLS LAST, id LIMIT 20")
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent(_files(spark, sf_dir))


@_query(f"{_WITH} {_RECENT} WHERE modified_at >= '2026-06-01T00:00:00Z' ORDER BY modified_at DESC NULLS LAST, id LIMIT 100")
def recent_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent(_files(spark, sf_dir), "2026-06-01T00:00:00Z", 500)


@_query()
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_snippets(search.text_candidates(_postings(spark, sf_dir), _T), corpus.texts(spark, sf_dir), _T).select("source_id", "extractor_type", "snippet")


# -- texts ----------------------------------------------------------------------------------------------------


@_query(r"""SELECT doc_id, regexp_replace(replace(regexp_replace(' ' || chr(13) || chr(10) || replace(text, '. ', chr(13)) || chr(9), '\r\n?', chr(10), 'g'), chr(0), ''), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", X.normalize_text(F.concat(F.lit(" \r\n"), F.replace(F.col("text"), F.lit(". "), F.lit("\r")), F.lit("\t"))).alias("text"))


@_query("""WITH h AS (SELECT doc_id, text, substring(text, 1, 500) AS head FROM documents), c AS (SELECT *, 500 - instr(reverse(head), chr(10)) AS upto FROM h)
    SELECT doc_id, CASE WHEN length(text) > 500 THEN regexp_replace(CASE WHEN contains(head, chr(10)) AND upto > 250 THEN substring(head, 1, upto) ELSE head END, '^\\s+|\\s+$', '', 'g') ELSE text END AS text FROM c""")
def limit_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.limit_content(F.col("text"), 500).alias("text"))


def _markup_sql(c: str) -> str:
    for pattern, by in (*X.MARKUP, (r"^\s+|\s+$", "")):
        text = " || ".join("chr(%d)" % ord(x) for x in by) or "''"
        c = f"regexp_replace({c}, '{pattern}', {text}, 'g')"
    return c


@_query(f"SELECT page_id, {_markup_sql('html')} AS text FROM pages")
def markup_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.markup_to_text(F.col("html")).alias("text"))


@_query("""WITH m AS (SELECT p_partkey, json_object('name', p_name, 'scripts', json_object('build', '1', 'test', '2'), 'dependencies', json_object(replace(p_brand, '#', ''), '1')) AS raw FROM part)
    SELECT p_partkey, list_concat(json_keys(raw, '$.scripts'), json_keys(raw, '$.dependencies'))::VARCHAR AS keys FROM m""")
def manifest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    raw = F.to_json(F.struct(F.col("p_name").alias("name"), F.create_map(F.lit("build"), F.lit("1"), F.lit("test"), F.lit("2")).alias("scripts"), F.create_map(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit("1")).alias("dependencies")))
    return p.select("p_partkey", F.concat(F.lit("["), F.array_join(extract.manifest_keys(raw), ", "), F.lit("]")).alias("keys"))


@_query(f"""{_WITH} SELECT id, concat('repo: ', repo_name, CASE WHEN remote_url IS NULL THEN '' ELSE concat(chr(10), chr(10), 'remote: ', remote_url) END, chr(10), chr(10), 'readme:', chr(10), 'about ', repo_name) AS summary FROM repos""")
def repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = corpus.repos(spark, sf_dir)
    return r.select("id", extract.repo_summary(F.col("repo_name"), F.col("remote_url"), F.concat(F.lit("about "), "repo_name"), F.lit(None).cast("string")).alias("summary"))


@_query("""WITH l AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
    SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(w, list_prepend(NULL, w[:len(w) - 1])), lambda p: p[1] IS DISTINCT FROM p[2]), lambda p: p[1]), ' ') AS text FROM l""")
def dedupe_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("w", F.split("text", " ", -1))
    return d.select("doc_id", F.array_join(X.dedupe_consecutive(F.col("w")), " ").alias("text"))


# -- events ---------------------------------------------------------------------------------------------------


@_query(f"""{_WITH}, e AS (SELECT event_id, path, inode, kind = 'unlink' AS gone, (epoch_us(ts) // 1000) AS ms FROM ev WHERE kind IN ('unlink', 'add')),
    w AS (SELECT *, CASE WHEN lag(gone) OVER p THEN lag(event_id) OVER p END AS own, lag(ms) OVER p AS own_ms,
                 last_value(CASE WHEN gone THEN event_id END IGNORE NULLS) OVER (PARTITION BY inode ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k
          FROM e WINDOW p AS (PARTITION BY path ORDER BY ms, event_id)),
    a AS (SELECT w.event_id AS ae, w.path, w.inode, w.ms, CASE WHEN w.ms - own_ms <= 3600000 THEN own END AS own, CASE WHEN w.ms - x.ms <= 3600000 AND x.path <> w.path THEN k END AS k, x.path AS old_path
          FROM w LEFT JOIN e AS x ON w.k = x.event_id WHERE NOT w.gone),
    m1 AS (SELECT * FROM a WHERE own IS NULL AND k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY ms, ae) = 1),
    sv AS (SELECT a.*, (m1.k IS NULL OR a.ms < m1.ms OR (a.ms = m1.ms AND a.ae < m1.ae)) AS wins FROM a LEFT JOIN m1 ON a.own = m1.k WHERE a.own IS NOT NULL),
    m2 AS (SELECT * FROM m1 WHERE k NOT IN (SELECT own FROM sv WHERE wins)),
    m3 AS (SELECT ae, path, inode, ms, own, k, old_path FROM sv WHERE NOT wins AND k IS NOT NULL AND k NOT IN (SELECT k FROM m2) AND k NOT IN (SELECT own FROM sv WHERE wins) QUALIFY row_number() OVER (PARTITION BY k ORDER BY ms, ae) = 1)
    SELECT old_path, path AS new_path, inode, k AS ue, ae FROM (SELECT * FROM m2 UNION ALL SELECT * FROM m3)""")
def rename_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.rename_pairs(corpus.events(spark, sf_dir), 3_600_000)  # the table's events are minutes apart


@_query(f"""{_WITH}, t AS (SELECT path, doc_id, sha256(text) AS sha256 FROM files JOIN documents USING (doc_id)),
    o AS (SELECT path, sha256 FROM t WHERE doc_id % 11 <> 0), n AS (SELECT CASE WHEN doc_id % 7 = 0 THEN concat('/moved', path) ELSE path END AS path, sha256 FROM t WHERE doc_id % 13 <> 0),
    g AS (SELECT sha256, min(path) AS old_path FROM o WHERE path NOT IN (SELECT path FROM n) AND sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) = 1), c AS (SELECT sha256, min(path) AS new_path FROM n WHERE path NOT IN (SELECT path FROM o) AND sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) = 1)
    SELECT old_path, new_path, sha256 FROM g JOIN c USING (sha256)""")
def content_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that two listings show as moved, by what is in them."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("d"), F.sha2("text", 256).alias("sha256"))
    t = corpus.files(spark, sf_dir).select("doc_id", "path").join(d, F.col("doc_id") == F.col("d"))
    new = t.filter("doc_id % 13 <> 0").withColumn("path", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("/moved"), "path")).otherwise(F.col("path")))
    return index.moved_by_content(t.filter("doc_id % 11 <> 0").select("path", "sha256"), new.select("path", "sha256"))


@_query(f"""{_WITH} SELECT (SELECT count(*) FROM files WHERE doc_id % 10 <> 0)::BIGINT AS n_files, (SELECT count(*) FROM blobs WHERE source_type = 'repo' OR seq % 10 <> 0)::BIGINT AS n_blobs""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, b = corpus.files(spark, sf_dir), corpus.blobs(spark, sf_dir)
    left, texts = index.delete_paths(f, b, f.filter("doc_id % 10 = 0").select("path"))
    return left.agg(F.count(F.lit(1)).alias("n_files")).crossJoin(F.broadcast(texts.agg(F.count(F.lit(1)).alias("n_blobs"))))  # one row each


@_query(f"""{_WITH}, e AS (SELECT *, (epoch_us(ts) // 1000) AS ms FROM ev), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w > 3600000 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY path ORDER BY ms, event_id)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ms, event_id) AS burst FROM g)
    SELECT path, burst::BIGINT AS burst, CASE WHEN arg_max(kind, struct_pack(ms := ms, e := event_id)) = 'unlink' THEN 'delete' ELSE 'upsert' END AS job, min(ms) AS first_ms, max(ms) AS last_ms, count(*)::BIGINT AS n_events FROM b GROUP BY path, burst""")
def debounce_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.debounce_gaps(corpus.events(spark, sf_dir), 3_600_000)


@_query(f"""{_WITH.replace("WITH ", "WITH RECURSIVE ", 1)}, e AS (SELECT path, kind, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS rn FROM ev),
    r AS (SELECT path, rn, ms AS first_ms, ms AS last_ms, kind, 0 AS burst FROM e WHERE rn = 1
          UNION ALL SELECT e.path, e.rn, CASE WHEN e.ms > least(r.last_ms + 3600000, r.first_ms + 14400000) THEN e.ms ELSE r.first_ms END, e.ms, e.kind,
                           r.burst + CASE WHEN e.ms > least(r.last_ms + 3600000, r.first_ms + 14400000) THEN 1 ELSE 0 END FROM r JOIN e ON e.path = r.path AND e.rn = r.rn + 1)
    SELECT path, CASE WHEN arg_max(kind, rn) = 'unlink' THEN 'delete' ELSE 'upsert' END AS job, min(first_ms) AS first_ms, max(last_ms) AS last_ms, count(*)::BIGINT AS n_events FROM r GROUP BY path, burst""")
def debounce_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful operator's rule, folded in batch: a burst also ends a fixed time after its first event."""
    from lodeview.streaming.live import debounce_batch

    return debounce_batch(corpus.events(spark, sf_dir), 3_600_000, 14_400_000)


# -- extensions --------------------------------------------------------------------------------------------


@_query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS s FROM embeddings, q)
    SELECT vec_id, round(s, 5) AS similarity FROM s ORDER BY s DESC, vec_id LIMIT 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("v", F.col("embedding").cast("array<double>"))
    probe = F.broadcast(e.filter("vec_id = 0").select(F.col("v").alias("q")).limit(1))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = e.crossJoin(probe).withColumn("s", dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q")))
    return scored.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 5).alias("similarity"))


@_query("""WITH e AS (SELECT user_id, ts, CASE WHEN date_diff('second', lag(ts) OVER w, ts) >= 1800 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
    SELECT user_id, count(DISTINCT n)::BIGINT AS n_sessions, count(*)::BIGINT AS n_events FROM s GROUP BY user_id""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    by = Window.partitionBy("user_id").orderBy("ts")
    gap = F.date_trunc("second", "ts").cast("long") - F.date_trunc("second", F.lag("ts").over(by)).cast("long")
    s = e.withColumn("fresh", F.coalesce((gap >= 1800).cast("int"), F.lit(0))).withColumn("n", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id").agg(F.countDistinct("n").alias("n_sessions"), F.count(F.lit(1)).alias("n_events"))


@_query("""WITH e AS (SELECT DISTINCT s_nationkey AS a, n_regionkey + 1000 AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT x.a AS start, count(DISTINCT y.a)::BIGINT AS within_two FROM e AS x JOIN e AS y ON x.b = y.b GROUP BY x.a""")
def graph_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    e = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("a"), (F.col("n_regionkey") + 1000).alias("b")).distinct()
    return e.alias("x").join(e.alias("y"), F.col("x.b") == F.col("y.b")).groupBy(F.col("x.a").alias("start")).agg(F.countDistinct("y.a").alias("within_two"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
