"""Grounded answers: citations, claims, numbers, outcomes and their evaluation.

Assistant turns of `conversations` stand in for answers. They hold no citations, so these are put behind their sentences
by a stated rule, wrong ones included; the first three user turns of a conversation are its evidence S1 to S3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators.textual import _TERMS
from tessera.registry import query, table
from tessera.sources.shared import new_path

#: Claims of fewer words need no citation.
LEAST_WORDS = 4


def _answers(spark, sf) -> DataFrame:
    """conv_id, turn, answer, abstained, expected_abstain, subjective, warned, expected (a title)."""
    rows = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.transform(t.sentences(F.col("text")), lambda s: F.trim(s)).alias("s"))
    sign = lambda s, i: F.when((F.col("turn") + i) % 9 == 8, s).otherwise(F.concat(s, F.when(i % 4 == 1, " and 12 more").otherwise(""), F.lit(" [S"), ((F.col("conv_id") + F.floor(i / 6)) % 4 + 1).cast("string"), F.lit("]")))
    cited = F.array_join(F.transform("s", sign), "\n")
    answer = F.when(F.col("conv_id") % 11 == 0, " ").when(F.col("conv_id") % 11 == 1, F.array_join("s", "\n")).otherwise(cited)
    n = F.col("conv_id")
    return rows.select("conv_id", "turn", answer.alias("answer"), (n % 5 == 0).alias("abstained"), (n % 10 < 2).alias("expected_abstain"), (n % 3 == 0).alias("subjective"), (F.col("turn") % 4 == 1).alias("warned"), F.concat(F.lit("src"), (n % 6).cast("string")).alias("expected"))


def _sources(spark, sf) -> DataFrame:
    """conv_id, id, content, title, active: the evidence of each conversation; some of it belongs to another corpus."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    users = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "text", rank.alias("k")).where("k <= 3")
    content = F.when(F.col("conv_id") % 2 == 0, F.concat("text", F.lit(" 12"))).otherwise(F.col("text"))
    return users.select("conv_id", F.concat(F.lit("S"), F.col("k").cast("string")).alias("id"), content.alias("content"), F.concat(F.lit("src"), ((F.col("conv_id") + F.col("k")) % 6).cast("string")).alias("title"), (~((F.col("conv_id") % 13 == 3) & (F.col("k") == 2))).alias("active"))


_SENT = r"list_transform(list_filter(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\f\r]+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s) <> ''), lambda s: trim(s))"
_NUMS = r"list_transform(regexp_extract_all(@, '(?:^|[^\p{L}\p{N}_])(-?[0-9]+(?:[.,][0-9]+)?%?)', 1), lambda x: replace(x, ',', '.'))"
_IDS = r"regexp_extract_all(@, '\[(S[1-9][0-9]*)\]', 1)"
_ANS = f"""a0 AS (SELECT conv_id, turn, {_SENT} AS s FROM conversations WHERE role = 'assistant'),
ans AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN ' ' WHEN conv_id % 11 = 1 THEN coalesce(array_to_string(s, chr(10)), '') ELSE coalesce(array_to_string(list_transform(s, lambda x, i: CASE WHEN (turn + i - 1) % 9 = 8 THEN x ELSE x || CASE WHEN (i - 1) % 4 = 1 THEN ' and 12 more' ELSE '' END || ' [S' || ((conv_id + (i - 1) // 6) % 4 + 1) || ']' END), chr(10)), '') END AS answer,
 conv_id % 5 = 0 AS abstained, conv_id % 10 < 2 AS expected_abstain, conv_id % 3 = 0 AS subjective, turn % 4 = 1 AS warned, 'src' || conv_id % 6 AS expected FROM a0),
src AS (SELECT conv_id, 'S' || k AS id, CASE WHEN conv_id % 2 = 0 THEN text || ' 12' ELSE text END AS content, 'src' || (conv_id + k) % 6 AS title, NOT (conv_id % 13 = 3 AND k = 2) AS active FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user' QUALIFY k <= 3)),
srcs AS (SELECT conv_id, list(id) AS ids, list(id) FILTER (active) AS live, map(list(id), list({_NUMS.replace('@', 'content')})) AS nums, map(list(id), list(title)) AS titles FROM src GROUP BY conv_id),
told AS (SELECT ans.*, coalesce(ids, []) AS ids, coalesce(live, []) AS live, nums, titles, {_IDS.replace('@', 'answer')} AS cited FROM ans LEFT JOIN srcs USING (conv_id)),
cl AS (SELECT conv_id, turn, p, claim, {_IDS.replace('@', 'claim')} AS cids, {_NUMS.replace('@', "regexp_replace(claim, '" + chr(92) + "[S[1-9][0-9]*" + chr(92) + "]', '', 'g')")} AS cn, len({_TERMS.replace('@', 'claim')}) AS words, nums FROM (SELECT *, unnest({_SENT.replace('text', 'answer')}) AS claim, generate_subscripts({_SENT.replace('text', 'answer')}, 1) AS p FROM told)),
cj AS (SELECT *, list_filter(cn, lambda x: NOT list_contains(flatten(list_transform(list_filter(cids, lambda c: nums[c] IS NOT NULL), lambda c: nums[c])), x)) AS bad FROM cl)"""


def claims(answers: DataFrame) -> DataFrame:
    """conv_id, turn, place, claim, ids, words, numbers (without citations): the sentences and lines of answers."""
    each = answers.select("conv_id", "turn", F.posexplode(t.sentences(F.col("answer"))).alias("place", "claim"))
    bare = F.regexp_replace("claim", r"\[S[1-9][0-9]*\]", "")
    return each.select("conv_id", "turn", "place", "claim", t.citations(F.col("claim")).alias("ids"), F.size(t.terms(F.col("claim"))).alias("words"), t.numbers(bare).alias("numbers"))


def judged_claims(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """claims with `unsupported`: the numbers that none of the claim's known sources has."""
    rows = claims(answers)
    held = rows.select("conv_id", "turn", "place", F.explode("ids").alias("id")).join(sources.select("conv_id", "id", t.numbers(F.col("content")).alias("has")), ["conv_id", "id"])
    held = held.groupBy("conv_id", "turn", "place").agg(F.array_distinct(F.flatten(F.collect_list("has"))).alias("has"))
    none = F.array().cast("array<string>")
    return rows.join(held, ["conv_id", "turn", "place"], "left").withColumn("unsupported", F.array_except("numbers", F.coalesce("has", none)))


def verdicts(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """conv_id, turn, verdict, cited: the first thing that is wrong with an answer, else valid with the sources it cites.

    In order: empty, no_citation, unknown_citation, wrong_corpus, then the first claim of LEAST_WORDS words or more that
    cites nothing (uncited_claim) or has a number that its sources lack (unsupported_number).
    """
    known = sources.groupBy("conv_id").agg(F.collect_set("id").alias("known"), F.collect_set(F.when(F.col("active"), F.col("id"))).alias("live"))  # a few of each conversation
    none = F.array().cast("array<string>")
    rows = answers.withColumn("ids", F.array_distinct(t.citations(F.col("answer")))).join(known, "conv_id", "left")
    bad = judged_claims(answers, sources).where(F.col("words") >= LEAST_WORDS)
    wrong = F.when(F.size("ids") == 0, "uncited_claim").when(F.size("unsupported") > 0, "unsupported_number")
    first = bad.withColumn("wrong", wrong).where("wrong is not null").groupBy("conv_id", "turn").agg(F.min_by("wrong", "place").alias("wrong"))
    lacks = lambda c: F.size(F.array_except("ids", F.coalesce(c, none))) > 0
    verdict = F.when(F.trim("answer") == "", "empty").when(F.size("ids") == 0, "no_citation").when(lacks("known"), "unknown_citation").when(lacks("live"), "wrong_corpus").otherwise(F.coalesce("wrong", F.lit("valid")))
    rows = rows.join(first, ["conv_id", "turn"], "left").withColumn("verdict", verdict)
    return rows.select("conv_id", "turn", "verdict", F.array_join(F.when(F.col("verdict") == "valid", F.array_sort("ids")).otherwise(none), ",").alias("cited"))


_VERDICT = f"""{_ANS}, fw AS (SELECT conv_id, turn, arg_min(CASE WHEN len(cids) = 0 THEN 'uncited_claim' ELSE 'unsupported_number' END, p) AS wrong FROM cj WHERE words >= 4 AND (len(cids) = 0 OR len(bad) > 0) GROUP BY ALL),
ver AS (SELECT t.*, CASE WHEN trim(answer) = '' THEN 'empty' WHEN len(cited) = 0 THEN 'no_citation' WHEN len(list_filter(cited, lambda c: NOT list_contains(ids, c))) > 0 THEN 'unknown_citation'
 WHEN len(list_filter(cited, lambda c: NOT list_contains(live, c))) > 0 THEN 'wrong_corpus' ELSE coalesce(wrong, 'valid') END AS verdict FROM told t LEFT JOIN fw USING (conv_id, turn))"""


@query(f"WITH {_VERDICT} SELECT conv_id, turn, verdict, CASE WHEN verdict = 'valid' THEN array_to_string(list_sort(list_distinct(cited)), ',') ELSE '' END AS cited FROM ver")
def job_validate_citations(spark, sf):
    return verdicts(_answers(spark, sf), _sources(spark, sf))


@query(f"WITH {_ANS} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(cited, lambda c: NOT list_contains(ids, c)))), ',') AS unknown FROM told")
def set_unknown_ids(spark, sf):
    known = _sources(spark, sf).groupBy("conv_id").agg(F.collect_set("id").alias("known"))
    rows = _answers(spark, sf).join(known, "conv_id", "left")
    missing = F.array_except(t.citations(F.col("answer")), F.coalesce("known", F.array().cast("array<string>")))
    return rows.select("conv_id", "turn", F.array_join(F.sort_array(missing), ",").alias("unknown"))


@query(f"WITH {_ANS} SELECT conv_id, turn, p::BIGINT - 1 AS place, len(list_filter(cids, lambda c: NOT list_contains(['S1', 'S2', 'S3'], c))) = 0 AS ids_known, len(bad) = 0 AS numbers_known FROM cj")
def set_subset_check(spark, sf):
    """Whether a claim's ids are among S1 to S3, and its numbers among those of its sources."""
    rows = judged_claims(_answers(spark, sf), _sources(spark, sf))
    ids = F.array(*(F.lit(f"S{i}") for i in (1, 2, 3)))
    return rows.select("conv_id", "turn", F.col("place").cast("long").alias("place"), (F.size(F.array_except("ids", ids)) == 0).alias("ids_known"), (F.size("unsupported") == 0).alias("numbers_known"))


def coverage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, coverage (share of claims of LEAST_WORDS words or more that cite something, 0 without any) and supported (all numbers are), from judged claims."""
    counts = F.col("words") >= LEAST_WORDS
    share = F.coalesce(F.try_divide(F.count_if(counts & (F.size("ids") > 0)).cast("double"), F.count_if(counts)), F.lit(0.0))
    return rows.groupBy("conv_id", "turn").agg(share.alias("coverage"), F.bool_and(F.size("unsupported") == 0).alias("supported"))


_COVER = "cov AS (SELECT conv_id, turn, coalesce(count(*) FILTER (words >= 4 AND len(cids) > 0) / nullif(count(*) FILTER (words >= 4), 0), 0) AS coverage, bool_and(len(bad) = 0) AS supported FROM cj GROUP BY ALL)"


@query(f"WITH {_ANS}, {_COVER} SELECT conv_id, turn, round(coverage, 6) AS coverage, supported FROM cov")
def job_claim_coverage(spark, sf):
    return coverage(judged_claims(_answers(spark, sf), _sources(spark, sf))).select("conv_id", "turn", F.round("coverage", 6).alias("coverage"), "supported")


def _scored(spark, sf) -> DataFrame:
    """Answers with all that their metrics need."""
    answers, sources = _answers(spark, sf), _sources(spark, sf)
    known = sources.groupBy("conv_id").agg(F.collect_set("id").alias("known"), F.collect_set("title").alias("titles"))
    rows = answers.join(known, "conv_id", "left").join(coverage(judged_claims(answers, sources)), ["conv_id", "turn"], "left")
    ids, none = t.citations(F.col("answer")), F.array().cast("array<string>")
    sound = (F.size(ids) > 0) & (F.size(F.array_except(ids, F.coalesce("known", none))) == 0)
    rows = rows.withColumns({"coverage": F.coalesce("coverage", F.lit(0.0)), "supported": F.coalesce("supported", F.lit(True)), "sound": sound})
    return rows.withColumns({"faithful": F.col("sound") & (F.col("coverage") == 1) & F.col("supported"), "relevant": F.coalesce(F.array_contains("titles", F.col("expected")), F.lit(False))})


def quality() -> list[Column]:
    """The six metrics of answers that don't abstain; 0 where there is nothing to judge."""
    mean = lambda c, name, of=F.lit(True): F.round(F.coalesce(F.avg(F.when(~F.col("abstained") & of, c.cast("double"))), F.lit(0.0)), 6).alias(name)
    return [
        mean(F.col("sound"), "citation_correctness"), mean(F.col("coverage"), "citation_completeness"), mean(F.col("faithful"), "faithfulness"), mean(F.col("relevant"), "answer_relevance"),
        mean(F.col("supported"), "numerical_accuracy"), mean(F.col("warned"), "subjectivity_labeling", F.col("subjective")),
    ]


def abstentions() -> list[Column]:
    right = F.count_if(F.col("abstained") & F.col("expected_abstain")).cast("double")
    ratio = lambda of, name: F.round(F.coalesce(F.try_divide(right, F.count_if(of)), F.lit(0.0)), 6).alias(name)
    return [ratio("abstained", "abstention_precision"), ratio("expected_abstain", "abstention_recall")]


_SCORED = f"""{_ANS}, {_COVER}, sc AS (SELECT t.*, coalesce(coverage, 0) AS coverage, coalesce(supported, true) AS supported, len(cited) > 0 AND len(list_filter(cited, lambda c: NOT list_contains(ids, c))) = 0 AS sound,
 coalesce(list_contains(map_values(titles), expected), false) AS relevant FROM told t LEFT JOIN cov USING (conv_id, turn))"""
_QUALITY = ", ".join(f"round(coalesce(avg({c}::DOUBLE) FILTER (NOT abstained{more}), 0), 6) AS {name}" for c, name, more in [("sound", "citation_correctness", ""), ("coverage", "citation_completeness", ""), ("(sound AND coverage = 1 AND supported)::INT", "faithfulness", ""), ("relevant", "answer_relevance", ""), ("supported", "numerical_accuracy", ""), ("warned", "subjectivity_labeling", " AND subjective")]).replace("avg(sound::", "avg(sound::INT::").replace("avg(relevant::", "avg(relevant::INT::").replace("avg(supported::", "avg(supported::INT::").replace("avg(warned::", "avg(warned::INT::")


@query(f"WITH {_SCORED} SELECT {_QUALITY} FROM sc")
def agg_answer_quality(spark, sf):
    return _scored(spark, sf).agg(*quality())


@query(f"""WITH {_SCORED} SELECT count(*) AS observations, {_QUALITY}, round(coalesce(count(*) FILTER (abstained AND expected_abstain) / nullif(count(*) FILTER (abstained), 0), 0), 6) AS abstention_precision,
 round(coalesce(count(*) FILTER (abstained AND expected_abstain) / nullif(count(*) FILTER (expected_abstain), 0), 0), 6) AS abstention_recall FROM sc""")
def job_evaluate_answers(spark, sf):
    return _scored(spark, sf).agg(F.count("*").alias("observations"), *quality(), *abstentions())


#: A line of evidence that gives a field its value.
FIELD = r"^\s*(?:Field:\s*)?([^:\n]{2,60}):\s*([^\n]{1,120})\s*$"


def conflicts(sources: DataFrame) -> DataFrame:
    """group, title, field, vals, ids: fields of a page that its sources (group, id, title, content) give different values."""
    lines = sources.select("group", "id", "title", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike(FIELD))
    found = lines.select("group", "id", F.lower("title").alias("title"), t.search_text(F.regexp_extract("line", FIELD, 1)).alias("field"), F.trim(F.regexp_extract("line", FIELD, 2)).alias("value"))
    told = found.groupBy("group", "title", "field").agg(F.sort_array(F.collect_set("value")).alias("vals"), F.sort_array(F.collect_set("id")).alias("ids"))
    return told.where(F.size("vals") >= 2)


def _fields(spark, sf) -> DataFrame:
    """Evidence with fields: each document tells the length and language of its source's page."""
    docs = table(spark, sf, "documents").where("source is not null")
    content = F.format_string("Length: %s\nField: Tongue:  %s\nno field here", (F.col("n_chars") % 7).cast("string"), "lang")
    return docs.select(F.col("lang").alias("group"), F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("title"), content.alias("content"))


@query("""SELECT "group", title, field, array_to_string(list_sort(list_distinct(list(v))), ',') AS vals, len(list_distinct(list(id)))::BIGINT AS n_ids FROM (
 SELECT lang AS "group", source AS title, 'S' || doc_id AS id, 'length' AS field, (n_chars % 7)::VARCHAR AS v FROM documents WHERE source IS NOT NULL UNION ALL SELECT lang, source, 'S' || doc_id, 'tongue', lang FROM documents WHERE source IS NOT NULL) GROUP BY ALL HAVING count(DISTINCT v) >= 2""")
def agg_conflicts(spark, sf):
    return conflicts(_fields(spark, sf)).select("group", "title", "field", F.array_join("vals", ",").alias("vals"), F.size("ids").cast("long").alias("n_ids"))


def grounded(answers: DataFrame, sources: DataFrame, gaps: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, turn, abstained, reason, confidence, warned, n_conflicts, cited of supplied answers.

    An answer abstains without evidence, if a comparison lacks evidence of one side (gaps: conv_id), or if its citations
    fail. found: conv_id, n (conflicts in its evidence). sources also have subjective.
    """
    held = sources.groupBy("conv_id").agg(F.count("*").alias("n_sources"), F.bool_or("subjective").alias("warned"))
    rows = answers.select("conv_id", "turn").join(verdicts(answers, sources), ["conv_id", "turn"]).join(held, "conv_id", "left").join(gaps.select("conv_id").distinct().withColumn("gap", F.lit(True)), "conv_id", "left").join(found.withColumnRenamed("n", "n_conflicts"), "conv_id", "left")
    reason = F.when(F.col("n_sources").isNull(), "insufficient_evidence").when(F.coalesce("gap", F.lit(False)), "comparison_missing_evidence").when(F.col("verdict") != "valid", F.concat(F.lit("citation_validation_failed:"), "verdict"))
    rows = rows.withColumn("reason", reason)
    ok, zero = F.col("reason").isNull(), F.lit(0).cast("long")
    band = F.when(~ok, "none").when(F.col("n_sources") >= 3, "high").when(F.col("n_sources") == 2, "medium").otherwise("low")
    return rows.select("conv_id", "turn", (~ok).alias("abstained"), F.coalesce("reason", F.lit("")).alias("reason"), band.alias("confidence"), (ok & F.coalesce("warned", F.lit(False))).alias("warned"), F.when(ok, F.coalesce("n_conflicts", zero)).otherwise(zero).alias("n_conflicts"), F.when(ok, F.col("cited")).otherwise("").alias("cited"))


@query(f"""WITH {_VERDICT}, hs AS (SELECT conv_id, count(*) AS n, bool_or(title = 'src1') AS warned FROM src GROUP BY conv_id), r AS (SELECT v.*, n, warned AS w, CASE WHEN n IS NULL THEN 'insufficient_evidence' WHEN conv_id % 17 = 0 THEN 'comparison_missing_evidence' WHEN verdict <> 'valid' THEN 'citation_validation_failed:' || verdict END AS reason FROM (SELECT * EXCLUDE (warned) FROM ver) v LEFT JOIN hs USING (conv_id))
 SELECT conv_id, turn, reason IS NOT NULL AS abstained, coalesce(reason, '') AS reason, CASE WHEN reason IS NOT NULL THEN 'none' WHEN n >= 3 THEN 'high' WHEN n = 2 THEN 'medium' ELSE 'low' END AS confidence, reason IS NULL AND coalesce(w, false) AS warned,
 CASE WHEN reason IS NULL AND n >= 2 AND conv_id % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS n_conflicts, CASE WHEN reason IS NULL THEN array_to_string(list_sort(list_distinct(cited)), ',') ELSE '' END AS cited FROM r""")
def job_grounded_answers(spark, sf):
    """Each conversation's sources give one page a field's value; every fourth conversation's disagree, every 17th compares without evidence."""
    answers, sources = _answers(spark, sf), _sources(spark, sf).withColumn("subjective", F.col("title") == "src1")
    told = F.concat(F.lit("Size: "), F.when(F.col("conv_id") % 4 == 0, F.col("id")).otherwise("one"))
    found = conflicts(sources.select(F.col("conv_id").alias("group"), "id", F.lit("page").alias("title"), told.alias("content"))).groupBy(F.col("group").alias("conv_id")).agg(F.count("*").alias("n"))
    return grounded(answers, sources, answers.where("conv_id % 17 = 0").select("conv_id"), found)


def prompts(sources: DataFrame, notes: DataFrame) -> DataFrame:
    """conv_id, prompt: evidence blocks in order of their number, then the notes (conv_id, note) that apply."""
    block = F.concat(F.lit("["), "id", F.lit("] "), "title", F.lit("\n"), "content")
    blocks = sources.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.substring("id", 2, 9).cast("int").alias("n"), block.alias("b")))).alias("b"))
    told = notes.groupBy("conv_id").agg(F.array_sort(F.collect_set("note")).alias("notes"))
    rows = blocks.join(told, "conv_id", "left")
    parts = F.concat(F.array(F.lit("Evidence:")), F.col("b.b"), F.coalesce("notes", F.array().cast("array<string>")), F.array(F.lit("Cite every claim as [S1].")))
    return rows.select("conv_id", F.array_join(parts, "\n\n").alias("prompt"))


@query(f"""WITH {_ANS} SELECT conv_id, md5('Evidence:' || chr(10) || chr(10) || string_agg('[' || id || '] ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY id) || chr(10) || chr(10) || CASE WHEN bool_or(title = 'src1') THEN 'Some evidence is opinion.' || chr(10) || chr(10) ELSE '' END || 'Cite every claim as [S1].') AS h FROM src GROUP BY conv_id""")
def job_render_prompt(spark, sf):
    sources = _sources(spark, sf)
    notes = sources.where("title = 'src1'").select("conv_id", F.lit("Some evidence is opinion.").alias("note"))
    return prompts(sources, notes).select("conv_id", F.md5("prompt").alias("h"))


# --- orders, boosts and merges


@query("""SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars // 500 DESC, nullif(doc_id % 17, 0) ASC NULLS LAST, doc_id)::BIGINT AS rank FROM documents""")
def sort_nulls_last(spark, sf):
    order = [F.expr("n_chars div 500").desc(), F.nullif(F.col("doc_id") % 17, F.lit(0)).asc_nulls_last(), F.col("doc_id").asc()]
    return numbered(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", order).select("source", "doc_id", "rank")


def numbered(rows: DataFrame, group: str, order: list[Column], ranges: int | None = None) -> DataFrame:
    """rows with rank, their place in the order of their group, without putting a group into one task.

    Rows are range-partitioned by group and order and numbered within each partition; what earlier partitions hold of
    the group is added. The ranges come from a sample, so rows are written with the number of theirs. The rows must be
    distinct in the order.
    """
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(ranges, F.col(group).asc_nulls_first(), *order).withColumn("_part", F.spark_partition_id())
    path = new_path(spark, "ranges")
    cut.write.parquet(path)
    cut = spark.read.schema(cut.schema).parquet(path)
    counts = cut.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), before.alias("_before"))
    here = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order))
    placed = cut.withColumn("_here", here).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn("rank", (F.col("_before") + F.col("_here")).cast("long")).drop("_part", "_here", "_g", "_p", "_before")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::BIGINT AS rank FROM documents")
def win_rank_lexical(spark, sf):
    return numbered(table(spark, sf, "documents").select("lang", "doc_id", "n_chars"), "lang", [F.desc("n_chars"), F.col("doc_id").asc()]).select("doc_id", "rank")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars // 500 DESC, doc_id % 50 DESC, lang DESC, doc_id DESC)::BIGINT AS rank FROM documents QUALIFY rank <= 10")
def sort_rerank(spark, sf):
    order = Window.partitionBy("source").orderBy(F.expr("n_chars div 500").desc(), (F.col("doc_id") % 50).desc(), F.desc("lang"), F.desc("doc_id"))
    return table(spark, sf, "documents").select("source", "doc_id", F.row_number().over(order).cast("long").alias("rank")).where("rank <= 10")


@query("SELECT doc_id, round(1.0 / (60 + doc_id % 50) + 0.02 * (source IN ('src1', 'src2'))::INT + 0.005 * (lang ILIKE '%E%')::INT, 6)::DOUBLE AS score FROM documents")
def prj_case_boost(spark, sf):
    titles = F.array(F.lit("src1"), F.lit("src2"))
    boost = F.when(F.array_contains(titles, F.col("source")), 0.02).otherwise(0.0) + F.when(F.col("lang").ilike("%E%"), 0.005).otherwise(0.0)
    return table(spark, sf, "documents").select("doc_id", F.round(1 / (60 + F.col("doc_id") % 50) + boost, 6).alias("score"))


def merged(ours: Column, theirs: Column) -> Column:
    """Shallow merge of two JSON objects, whatever their keys: the second one's win."""
    objects = [F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in (ours, theirs)]
    return F.map_concat(F.map_filter(objects[0], lambda k, _: ~F.array_contains(F.map_keys(objects[1]), k)), objects[1])


@query("""SELECT event_id, array_to_string(list_sort(list_transform(json_keys(m), lambda k: k || '=' || json_extract_string(m, '$.' || k))), ',') AS pairs FROM (SELECT event_id, json_merge_patch(props, json_object('type', event_type, CASE WHEN event_id % 2 = 0 THEN 'k' ELSE 'n' END, '1')) AS m FROM events)""")
def fn_json_merge(spark, sf):
    theirs = F.to_json(F.create_map(F.lit("type"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "k").otherwise("n"), F.lit("1")))
    pairs = F.transform(F.map_entries(merged(F.col("props"), theirs)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(pairs), ",").alias("pairs"))


@query("SELECT s_suppkey, s_nationkey + 100 AS nation_id FROM supplier")
def join_id_remap(spark, sf):
    """Keys of a restored table replaced by those of the new parent rows."""
    mapping = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") + 100).alias("nation_id"))
    return table(spark, sf, "supplier").join(mapping, "s_nationkey").select("s_suppkey", "nation_id")


#: What must be equal of a model under one key.
CONTRACT = ("provider", "name", "revision", "dims", "metric", "normalized")


def contract_issues(asked: DataFrame, registered: DataFrame) -> DataFrame:
    """model_key, issue: what differs between the models asked for and those registered under their key (CONTRACT), or unknown."""
    rows = asked.alias("a").join(registered.withColumn("_known", F.lit(True)).alias("r"), "model_key", "left")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in CONTRACT)))
    issues = F.when(F.col("_known").isNull(), F.array(F.lit("unknown"))).otherwise(differs)
    return rows.select("model_key", F.explode(issues).alias("issue"))


@query("""SELECT 'model' || label AS model_key, unnest(list_filter(['unknown', CASE WHEN label % 3 = 0 THEN 'revision' END, CASE WHEN label = 4 THEN 'dims' END], lambda x: CASE WHEN label = 9 THEN x = 'unknown' ELSE x IS NOT NULL AND x <> 'unknown' END)) AS issue FROM (SELECT DISTINCT label FROM embeddings)""")
def job_model_contract(spark, sf):
    """Models of the vectors' labels against a registry that lacks one, has other revisions of some and another length of one."""
    found = table(spark, sf, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).alias("dims"))
    shape = lambda revision, dims: [F.concat(F.lit("model"), F.col("label").cast("string")).alias("model_key"), F.lit("hashing").alias("provider"), F.lit("features").alias("name"), revision.alias("revision"), dims.alias("dims"), F.lit("cosine").alias("metric"), F.lit(True).alias("normalized")]
    registered = found.where("label <> 9").select(*shape(F.when(F.col("label") % 3 == 0, "2").otherwise("1"), F.when(F.col("label") == 4, 128).otherwise(F.lit(64))))
    return contract_issues(found.select(*shape(F.lit("1"), F.col("dims"))), registered)
