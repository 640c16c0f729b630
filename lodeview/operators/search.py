"""Ranked search: candidates, overlay of scores, reasons, and the best ten.

The caps on candidates are part of what a result is and are kept. Each is a
top-k, which Spark merges from one short list per task. Texts are found through
the stored inverted index: a question's terms are pushed down to the scan as
equalities and prefixes of tokens, which rows in order of token answer from a few
row groups, and strict and loose matches come from one aggregation. The at most
60 text candidates come to the driver, so that texts are read by their places and
tables meet the candidates as a local relation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add, and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeview.functions.snippet import snippet
from lodeview.functions.text import ascii_lower
from lodeview.operators import scoring as S
from lodeview.operators.index import KEY, PLACE, prefix_lookup
from lodeview.operators.index import postings as index_of
from lodeview.plans.query import Question, analyse

# How many candidates of each kind count.
NAME_CAP, PATH_CAP, REPO_CAP, TEXT_CAP, FUZZY_FILES, FUZZY_REPOS, RESULTS = 150, 30, 25, 30, 5000, 1000, 10
SIMILAR = 0.72
#: Up to so many prefixes are pushed down to the scan of the index; more would only make its plan long.
PUSHED = 64


def like_any(q: Question, *columns: Column) -> Column:
    """Any stem inside any column; % and _ in a stem are wildcards."""
    tests = [ascii_lower(c).like(f"%{s}%") for s in q.stems for c in columns]
    return reduce(or_, tests, F.lit(False))


def _one(lists: DataFrame) -> DataFrame:
    """Lists that each end in a limit, in one partition: what follows needs no exchange. Never for what reads a table without one."""
    return lists.coalesce(1)


def _top(rows: DataFrame, n: int, newest: str) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(newest), "id").limit(n)


def _ranked(rows: DataFrame, newest: str, phase: int) -> DataFrame:
    """With the place in a list of bounded length."""
    return rows.withColumn("phase", F.lit(phase)).withColumn("place", F.row_number().over(Window.partitionBy("phase").orderBy(F.desc_nulls_last(newest), "id")))


def name_candidates(files: DataFrame, q: Question) -> DataFrame:
    return _top(files.filter(like_any(q, F.col("name"))), NAME_CAP, "modified_at")


def path_candidates(files: DataFrame, q: Question) -> DataFrame:
    return _top(files.filter(like_any(q, F.col("path"))), PATH_CAP, "modified_at")


def file_candidates(files: DataFrame, q: Question) -> DataFrame:
    """Names, then paths; the first row of an id counts."""
    both = _ranked(name_candidates(files, q), "modified_at", 0).unionByName(_ranked(path_candidates(files, q), "modified_at", 1))
    return _one(both).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("phase"))).filter("nth = 1").drop("nth")


def repo_candidates(repos: DataFrame, q: Question) -> DataFrame:
    return _top(repos.filter(like_any(q, F.col("repo_name"), F.coalesce("remote_url", F.lit("")), F.col("root_path"))), REPO_CAP, "last_commit_at")


def _is(term: list[str], i: int) -> Column:
    """Whether a token is part i of a term; the last part is a prefix."""
    return F.startswith("token", F.lit(term[i])) if i == len(term) - 1 else F.col("token") == term[i]


def _less(places: str, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _holds(term: list[str]) -> Column:
    """Aggregate: whether a text holds the term, its parts one after another."""
    if len(term) == 1:
        return F.coalesce(F.bool_or(_is(term, 0)), F.lit(False))
    starts = [F.flatten(F.collect_list(F.when(_is(term, i), _less("places", i)))) for i in range(len(term))]
    return F.size(reduce(F.array_intersect, starts)) > 0


def text_matches(postings: DataFrame, q: Question) -> DataFrame:
    """Texts (by place of insertion) that hold any of the terms, and ``strict``: whether they hold all of two or more."""
    terms = q.index_terms
    if not terms:
        return postings.select(*PLACE, F.lit(False).alias("strict")).limit(0)
    asked = postings.filter(reduce(or_, [_is(t, i) for t in terms for i in range(len(t))]))
    held = asked.groupBy(*PLACE).agg(*[_holds(t).alias(f"h{j}") for j, t in enumerate(terms)])
    flags = [F.col(f"h{j}") for j in range(len(terms))]
    return held.filter(reduce(or_, flags)).select(*PLACE, (reduce(and_, flags) & F.lit(len(terms) > 1)).alias("strict"))


def text_candidates(postings: DataFrame, q: Question) -> DataFrame:
    """The first strict matches in the order of their insertion, then the first of all that aren't among them."""
    found = text_matches(postings, q)
    strict, loose = found.filter("strict").orderBy("seq").limit(TEXT_CAP), found.withColumn("strict", F.lit(False)).orderBy("seq").limit(TEXT_CAP)
    key = Window.partitionBy(*PLACE).orderBy(F.desc("strict"))
    kept = _one(strict.unionByName(loose)).withColumn("nth", F.row_number().over(key)).filter("nth = 1").drop("nth")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("strict"), "seq")))  # 60 rows at most


def text_candidates_of_many(postings: DataFrame, questions: list[str]) -> DataFrame:
    """(question, place of insertion, strict, place) for many questions in one job.

    The questions are broadcast to the index, of which only rows under their prefixes are read. Words count for a text as
    bits, which tasks merge before rows are exchanged; the parts of phrases meet by their places. The caps are rank limits,
    which Spark applies within each task too.
    """
    asked = {i: analyse(x).index_terms for i, x in enumerate(questions)}
    parts = [(i, j, k, len(terms), len(t), part, k == len(t) - 1) for i, terms in asked.items() for j, t in enumerate(terms) for k, part in enumerate(t)]

    def met(probes: list[tuple]) -> DataFrame:
        prefixes = sorted({p[5] for p in probes})
        read = postings.filter(reduce(or_, [F.startswith("token", F.lit(p)) for p in prefixes], F.lit(False))) if len(prefixes) <= PUSHED else postings
        hit = prefix_lookup(read, postings.sparkSession.createDataFrame(probes, "question int, term int, part int, terms int, parts int, prefix string, last boolean"))
        return hit.filter(F.col("last") | (F.col("token") == F.col("prefix")))

    of = ["question", "terms", "term", *PLACE]
    words, phrases = met([p for p in parts if p[4] == 1]).select(*of), met([p for p in parts if p[4] > 1]).repartition("question", "term", "seq")
    by_part = phrases.groupBy(*of, "parts", "part").agg(F.flatten(F.collect_list(F.transform("places", lambda p: p - F.col("part")))).alias("starts"))
    by_term = by_part.groupBy(*of, "parts").agg(F.collect_list("starts").alias("all"))
    common = F.aggregate(F.slice("all", 2, F.greatest(F.size("all"), F.lit(1))), F.get("all", F.lit(0)), F.array_intersect)
    holds = words.unionByName(by_term.filter((F.size("all") == F.col("parts")) & (F.size(common) > 0)).select(*of))
    firsts = range(0, max(map(len, asked.values()), default=0) or 1, 63)  # a number has room for 63 terms
    bits = [F.bit_or(F.expr(f"CASE WHEN term >= {b} AND term < {b + 63} THEN shiftleft(1L, term - {b}) ELSE 0L END")).alias(f"b{b}") for b in firsts]
    n = reduce(add, [F.bit_count(f"b{b}") for b in firsts])
    found = holds.groupBy("question", "terms", *PLACE).agg(*bits).select("question", *PLACE, ((n == F.col("terms")) & (F.col("terms") > 1)).alias("strict"))
    by = Window.partitionBy("question").orderBy("seq")
    capped = [x.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= TEXT_CAP).drop("nth") for x in (found.filter("strict"), found.withColumn("strict", F.lit(False)))]
    key = Window.partitionBy("question", *PLACE).orderBy(F.desc("strict"))
    kept = capped[0].unionByName(capped[1]).withColumn("nth", F.row_number().over(key)).filter("nth = 1").drop("nth")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("strict"), "seq")))


def _local(rows: DataFrame) -> DataFrame:
    """A list of bounded length as a local relation."""
    return rows.sparkSession.createDataFrame(rows.toArrow())


def _placed(rows: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A bounded list of candidates as a local relation, and the texts at their places of insertion."""
    held = _local(rows)
    return held, blobs.filter(F.col("seq").isin([r["seq"] for r in held.select("seq").distinct().collect()]))


def with_sources(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Candidates (a bounded list) with the ids of their sources; the texts themselves aren't read."""
    held, texts = _placed(rows, blobs)
    return held.join(F.broadcast(_local(texts.select(*KEY, "seq").distinct())), PLACE)


def with_snippets(rows: DataFrame, blobs: DataFrame, q: Question) -> DataFrame:
    """Candidates (60 at most) with their sources and the stretch of their text that shows a match best; texts are read by place of insertion."""
    terms = q.index_terms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(snippet=[snippet(c, terms) for c in b["content"]])[[*KEY, "seq", "snippet"]]

    held, texts = _placed(rows, blobs)
    made = texts.select(*KEY, "seq", "content").mapInPandas(run, "source_id string, source_type string, extractor_type string, seq long, snippet string")
    return held.join(F.broadcast(_local(made)), PLACE)


def fuzzy_files(files: DataFrame, q: Question) -> DataFrame:
    """Of the newest files, those whose name is similar."""
    pool = _top(files, FUZZY_FILES, "modified_at") if len(q.text) >= 4 else files.limit(0)
    return pool.withColumn("similarity", S.name_similarity(q, F.col("name"))).filter(F.col("similarity") >= SIMILAR)


def fuzzy_repos(repos: DataFrame, q: Question) -> DataFrame:
    pool = _top(repos, FUZZY_REPOS, "last_commit_at") if len(q.text) >= 4 else repos.limit(0)
    return pool.withColumn("similarity", S.name_similarity(q, F.col("repo_name"))).filter(F.col("similarity") >= SIMILAR)


_RESULT = ["result_id", "result_type", "title", "path", "score", "last_modified", "phase", "place", "reason"]


def file_results(files: DataFrame, q: Question) -> DataFrame:
    m, p = F.col("metadata_json"), F.col("path")
    score = S.string_score(q, F.concat("name", F.lit(" "), "path")) + S.name_bonus(q, F.col("name")) + S.source_hint_score(q, m, F.col("extension"), p) + S.path_quality(p)
    return file_candidates(files, q).select(
        F.col("id").alias("result_id"), F.lit("file").alias("result_type"), F.col("name").alias("title"), "path", score.cast("int").alias("score"),
        F.col("modified_at").alias("last_modified"), "phase", "place", S.file_reason(m).alias("reason"),
    )


def repo_results(repos: DataFrame, q: Question) -> DataFrame:
    hay = F.concat("repo_name", F.lit(" "), "root_path", F.lit(" "), F.coalesce("remote_url", F.lit("")))
    reason = F.when(F.col("remote_url").isNotNull(), F.concat(F.lit("Matched repo name or remote URL ("), "remote_url", F.lit(")"))).otherwise("Matched repo name")
    return _ranked(repo_candidates(repos, q), "last_commit_at", 2).select(
        F.col("id").alias("result_id"), F.lit("repo").alias("result_type"), F.col("repo_name").alias("title"), F.col("root_path").alias("path"),
        (S.string_score(q, hay, 120) + S.path_quality(F.col("root_path"), True)).cast("int").alias("score"), F.col("last_commit_at").alias("last_modified"), "phase", "place", reason.alias("reason"),
    )


def merge_text(base: DataFrame, texts: DataFrame, files: DataFrame, repos: DataFrame, q: Question) -> DataFrame:
    """Results by name overlaid with text hits: 35 and boosts on a result that exists, a result of its own otherwise."""
    boost = F.when(F.col("strict"), min(12 * len(q.words), 70)).otherwise(0) + S.blob_hint_score(q, F.col("extractor_type"))
    reason = F.concat(F.lit("Matched "), S.origin(F.col("extractor_type")), F.lit(": "), F.coalesce("snippet", F.lit("")))
    per = texts.groupBy("source_id", "source_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(boost).alias("boost"), F.min("place").alias("text_place"), F.sort_array(F.collect_list(F.struct("place", reason.alias("r")))).alias("said")
    )
    # a result by name has a parent of its own, so texts without one are left out by inner joins; at most 60 rows are broadcast
    of = lambda kind: F.broadcast(per.filter(F.col("source_type") == kind))
    # each side ends in a limit, which gathers what may come from all of a table's tasks
    about_files = files.select(F.col("id").alias("source_id"), F.col("path").alias("p"), F.col("name").alias("t"), F.col("modified_at").alias("m")).join(of("file"), "source_id")
    about_repos = repos.select(F.col("id").alias("source_id"), F.col("root_path").alias("p"), F.col("repo_name").alias("t"), F.col("last_commit_at").alias("m")).join(of("repo"), "source_id")
    found = about_files.unionByName(about_repos).limit(2 * TEXT_CAP)
    met = _one(base).join(_one(found), F.col("result_id") == F.col("source_id"), "full_outer")
    repo = F.col("source_type") == "repo"
    own = F.when(repo, 135 + S.path_quality(F.col("p"), True)).otherwise(125 + S.path_quality(F.col("p")))
    new = F.col("result_id").isNull()
    score = F.when(new, own + F.col("boost") + 35 * (F.col("n") - 1)).otherwise(F.col("score") + F.coalesce(F.col("boost") + 35 * F.col("n"), F.lit(0)))
    said = F.transform(F.coalesce("said", F.array()), lambda s: s["r"])
    parts = F.when(new, said).otherwise(F.concat(F.array("reason"), said))
    merged = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.get(parts, F.lit(0)), lambda a, x: F.when(F.contains(a, x), a).otherwise(F.concat(a, F.lit("; "), x)))
    return met.select(
        F.coalesce("result_id", "source_id").alias("result_id"), F.coalesce("result_type", "source_type").alias("result_type"), F.coalesce("title", "t").alias("title"), F.coalesce("path", "p").alias("path"),
        score.cast("int").alias("score"), F.when(new, F.col("m")).otherwise(F.col("last_modified")).alias("last_modified"), F.when(new, 3).otherwise(F.col("phase")).alias("phase"),
        F.when(new, F.col("text_place")).otherwise(F.col("place")).alias("place"), merged.alias("reason"),
    )


def fuzzy_results(files: DataFrame, repos: DataFrame, q: Question) -> DataFrame:
    percent = F.concat(S.half_up(F.col("similarity") * 100).cast("string"), F.lit("% "))
    m, p = F.col("metadata_json"), F.col("path")
    of_files = _ranked(fuzzy_files(files, q), "modified_at", 4).select(
        F.col("id").alias("result_id"), F.lit("file").alias("result_type"), F.col("name").alias("title"), "path",
        (70 + S.half_up(F.col("similarity") * 50) + S.source_hint_score(q, m, F.col("extension"), p) + S.path_quality(p)).cast("int").alias("score"), F.col("modified_at").alias("last_modified"), "phase", "place",
        F.concat(F.lit("Matched similar file name or path ("), percent, F.lit("name similarity)")).alias("reason"),
    )
    remote = F.when(F.col("remote_url").isNotNull(), F.concat(F.lit(" and remote URL ("), "remote_url", F.lit(")"))).otherwise("")
    of_repos = _ranked(fuzzy_repos(repos, q), "last_commit_at", 5).select(
        F.col("id").alias("result_id"), F.lit("repo").alias("result_type"), F.col("repo_name").alias("title"), F.col("root_path").alias("path"),
        (72 + S.half_up(F.col("similarity") * 55) + S.path_quality(F.col("root_path"), True)).cast("int").alias("score"), F.col("last_commit_at").alias("last_modified"), "phase", "place",
        F.concat(F.lit("Matched similar repo name ("), percent, F.lit("similarity)"), remote).alias("reason"),
    )
    return _one(of_files.unionByName(of_repos))


def find(
    files: DataFrame, repos: DataFrame, blobs: DataFrame, question: str, *, postings: DataFrame | None = None, snippets: bool = True,
    kinds: Sequence[str] = (), path_prefix: str | None = None, since: str | None = None, limit: int = RESULTS,
) -> DataFrame:
    """The ten best results for a question, with score and reason; no rows for a blank one.

    ``postings`` is the stored index of ``blobs``; without it one is made for this question. Filters choose among the
    candidates' results: their kinds (file, repo), the begin of their path, the earliest time of change, and how many.
    """
    q = analyse(question)
    texts = text_candidates(index_of(blobs) if postings is None else postings, q)
    texts = with_snippets(texts, blobs, q) if snippets else with_sources(texts, blobs).withColumn("snippet", F.lit(""))
    base = file_results(files, q).unionByName(repo_results(repos, q))
    named = merge_text(base, texts, files, repos, q)
    # each id once: a result by name or text before one by similarity
    every = _one(named.unionByName(fuzzy_results(files, repos, q).select(*_RESULT)))
    every = every.withColumn("nth", F.row_number().over(Window.partitionBy("result_id").orderBy(F.col("phase") > 3, "phase"))).filter("nth = 1").drop("nth")
    tests = [F.lit(bool(q.text))] + [F.col("result_type").isin(list(kinds))] * bool(kinds) + [F.startswith("path", F.lit(path_prefix))] * (path_prefix is not None) + [F.col("last_modified") >= since] * (since is not None)
    best = every.filter(reduce(and_, tests)).orderBy(F.desc("score"), "phase", "place").limit(max(0, min(RESULTS, limit)))
    return best.select("result_id", "result_type", "title", "path", F.col("reason").alias("why_matched"), "score", "last_modified")


def get_record(files: DataFrame, repos: DataFrame, blobs: DataFrame, id_: str) -> DataFrame:
    """A file's record, or else a repo's, with the first 160 characters of its texts by extractor."""
    said = blobs.filter(F.col("source_id") == id_).groupBy("source_id", "source_type").agg(
        F.sort_array(F.collect_list(F.struct("extractor_type", F.substring("content", 1, 160).alias("snippet")))).alias("blobs")
    )
    null = lambda t="string": F.lit(None).cast(t)
    f = files.filter(F.col("id") == id_).select(F.lit("file").alias("kind"), "id", "path", "name", "extension", "mime_type", "modified_at", "source_root", "metadata_json", null().alias("remote_url"), null().alias("current_branch"))
    r = repos.filter(F.col("id") == id_).select(
        F.lit("repo").alias("kind"), "id", F.col("root_path").alias("path"), F.col("repo_name").alias("name"), null().alias("extension"), null().alias("mime_type"), F.col("last_commit_at").alias("modified_at"),
        null().alias("source_root"), "metadata_json", "remote_url", "current_branch",
    )
    one = f.unionByName(r).orderBy("kind").limit(1)
    return one.join(said, (one["id"] == said["source_id"]) & (one["kind"] == said["source_type"]), "left").drop("source_id", "source_type").withColumn("blobs", F.coalesce("blobs", F.array().cast("array<struct<extractor_type:string,snippet:string>>")))


def recent(files: DataFrame, since: str | None = None, limit: int = 20) -> DataFrame:
    """The newest files, at most 1 to 100; ``since`` compares as text, as times are stored."""
    rows = files if since is None else files.filter(F.col("modified_at") >= since)
    return rows.orderBy(F.desc_nulls_last("modified_at"), "id").limit(max(1, min(100, limit))).select(
        F.col("id").alias("result_id"), F.lit("file").alias("result_type"), F.col("name").alias("title"), "path", F.lit("Recently modified").alias("why_matched"), F.lit(0).alias("score"), F.col("modified_at").alias("last_modified")
    )
