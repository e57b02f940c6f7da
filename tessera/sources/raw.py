"""Raw revision objects, evaluation cases and reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW = "metadata struct<page_id: long>, response struct<query: struct<pages: array<struct<pageid: long, revisions: array<struct<slots: struct<main: struct<content: string>>>>>>>>"
#: Behaviour that each category of an evaluation case asks for.
BEHAVIOUR = {"entity": "answer", "natural": "answer", "unanswerable": "abstain"}
LEAST_CASES = 150


def raw_pages(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, content, issue for every page; raw has one JSON object in `value` for each revision, pages has page_id.

    issue is null for good pages, else missing (no object names the page), identity (its response is of another page)
    or empty; only good pages have content.
    """
    told = raw.select(F.from_json("value", RAW).alias("r")).select(F.col("r.metadata.page_id").alias("page_id"), F.get("r.response.query.pages", F.lit(0)).alias("p"))
    content = F.get("p.revisions", F.lit(0))["slots"]["main"]["content"]
    issue = F.when(F.col("told").isNull(), "missing").when(~F.col("p.pageid").eqNullSafe(F.col("page_id")), "identity").when(F.trim(F.coalesce(content, F.lit(""))) == "", "empty")
    both = pages.select("page_id").join(told.withColumn("told", F.lit(True)), "page_id", "left").withColumn("issue", issue)
    return both.select("page_id", F.when(F.col("issue").isNull(), content).alias("content"), "issue")


def case_issues(cases: DataFrame) -> DataFrame:
    """issue, id of evaluation cases (id, category, expected_behavior): duplicate ids, a behaviour that the category doesn't ask for, too few cases."""
    asked = F.create_map(*(F.lit(x) for item in BEHAVIOUR.items() for x in item))
    twice = cases.groupBy("id").count().where("count > 1").select(F.lit("duplicate").alias("issue"), "id")
    wrong = cases.where(~F.col("expected_behavior").eqNullSafe(F.try_element_at(asked, F.col("category")))).select(F.lit("behaviour"), "id")
    few = cases.agg(F.count("*").alias("n")).where(F.col("n") < LEAST_CASES).select(F.lit("too_few"), F.lit(None).cast("long"))
    return twice.union(wrong).union(few)


def write_report(report: DataFrame, path: str, kind: str, run: str) -> str:
    """A report as JSON under its run and kind; an existing one is an error."""
    target = f"{path}/run={run}/kind={kind}"
    report.write.mode("errorifexists").json(target)
    return target
