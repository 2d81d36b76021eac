"""Queries on trees of stages, console pages, model calls and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import ci
from sparkloom.operators import models, tree
from sparkloom.plans.registry import query
from sparkloom.session import table

_EDGES = "e AS (SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN doc_id // 2 END AS parent, doc_id % 7 = 3 AS failed, doc_id % 11 = 5 AS skipped FROM documents)"
_UP = """u AS (SELECT id, parent AS ancestor, 1 AS distance FROM e WHERE parent IS NOT NULL
  UNION ALL SELECT u.id, e.parent, u.distance + 1 FROM u JOIN e ON e.id = u.ancestor WHERE e.parent IS NOT NULL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(i.alias("id"), F.when(i > 0, F.floor(i / 2)).alias("parent"), (i % 7 == 3).alias("failed"), (i % 11 == 5).alias("skipped"))


@query(
    f"""WITH RECURSIVE {_EDGES}, {_UP}, b AS (SELECT u.ancestor AS id, bool_or(failed) AS f, bool_or(skipped) AS s FROM u JOIN e USING (id) GROUP BY 1)
    SELECT id, coalesce(f, false) AS below_failed, coalesce(s, false) AS below_skipped FROM e LEFT JOIN b USING (id)"""
)
def stage_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return tree.any_below(e, e.select("id", "failed", "skipped"), "failed", "skipped")


@query(f"WITH RECURSIVE {_EDGES}, {_UP} SELECT id, min_by(ancestor, distance) AS ancestor FROM u WHERE ancestor % 3 = 1 GROUP BY id")
def nearest_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return tree.nearest_ancestor(e, e.filter("id % 3 = 1").select("id"))


@query(
    f"""WITH RECURSIVE {_EDGES}, {_UP}, d AS (SELECT e.id, coalesce(max(distance), 0)::INTEGER AS depth FROM e LEFT JOIN u USING (id) GROUP BY 1)
    SELECT id, depth FROM d JOIN documents ON doc_id = id WHERE source = 'src3' ORDER BY depth, id LIMIT 1"""
)
def stage_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return tree.first_by_level(nodes, _edges(spark, sf_dir), F.col("source") == "src3").select("id", "depth")


def _consoles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Console pages with two stages, the second within the first, that print a page's whole HTML as text."""
    i = F.col("page_id").cast("string")
    text = F.regexp_replace("html", "[<>&\"]", " ")
    page = F.concat(
        F.lit('<html><body><pre id="out">BUILD_TAG=build-'), i,
        F.lit('<span class="pipeline-new-node" nodeId="5" startId="5" enclosingId="2" label="Build">[Pipeline] { (Build)</span>'),
        F.lit('<span class="pipeline-new-node" nodeId="7" startId="7" enclosingId="5" label="Branch: Test">[Pipeline] { (Test)</span>'),
        F.lit('<span class="pipeline-new-node" nodeId="9" enclosingId="7">step</span><span class="pipeline-node-9"></span>'),
        F.when(F.col("page_id") % 2 == 0, "Failed! - Failed: 1, Passed: 2, Skipped: 0").otherwise("fine"), F.lit("<span>"), text, F.lit("</span>"),
        F.when(F.col("page_id") % 3 == 0, "Failed in branch Test").otherwise("\n"),
        F.lit('<span startId="7">[Pipeline] }</span><span startId="5">[Pipeline] }</span>Finished: '), F.when(F.col("page_id") % 3 == 0, "FAILURE").otherwise("SUCCESS"), F.lit("</pre></body></html>"),
    )
    return table(spark, sf_dir, "pages").select("page_id", ci.pipeline_of(page).alias("p"))


@query(
    """SELECT page_id, 'build-' || page_id AS build_tag, CASE WHEN page_id % 3 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS finish_status, 2::BIGINT AS n_stages,
    CASE WHEN page_id % 3 = 0 THEN 'Test' ELSE '' END AS failed, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END::INTEGER AS failure_flags FROM pages"""
)
def console_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _consoles(spark, sf_dir)
    flags = F.aggregate("p.stages", F.lit(0), lambda a, s: a.bitwiseOR(s["failure_flags"]))
    return c.select("page_id", "p.build_tag", "p.finish_status", F.size("p.stages").cast("long").alias("n_stages"), F.array_join("p.failed", ",").alias("failed"), flags.alias("failure_flags"))


@query()
def console_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consoles(spark, sf_dir).select("page_id", ci.pipeline_markdown(F.col("p")).alias("report"))


@query()
def stub_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of texts from the stand-in model."""
    return table(spark, sf_dir, "benchmark").select("item_id", models.embed(F.col("text"), models.StubEmbedder(16)).alias("vec"))


@query(
    """WITH a AS (SELECT conv_id, turn, length(text) || ': ' || array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:8], ' ') AS answer FROM conversations),
    m AS (SELECT conv_id, 'Merge:' || chr(10) || string_agg(answer, chr(10) || chr(10) ORDER BY turn) AS p FROM a GROUP BY conv_id)
    SELECT conv_id, length(p) || ': ' || array_to_string(list_filter(string_split_regex(p, '\\s+'), lambda x: x <> '')[1:8], ' ') AS answer FROM m"""
)
def answers_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the stand-in model to each turn, merged for each conversation."""
    c = table(spark, sf_dir, "conversations")
    answers = c.select("conv_id", "turn", models.complete(F.coalesce("text", F.lit("")), models.StubChat()).alias("answer"))
    return models.merge(answers, "conv_id", "turn", "answer", models.StubChat())


@query("SELECT event_id, '{\"type\":\"' || event_type || '\",\"n\":' || event_id || '}' AS parsed FROM events")
def structured_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers parsed by schema, after repairs where the first answer is no JSON."""
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.when(F.col("event_id") % 2 == 0, "Here: ").otherwise("```json "), F.lit('{"type": "'), "event_type", F.lit('", "n": '), F.col("event_id").cast("string"), F.lit("} ok"))
    return e.select("event_id", F.to_json(models.structured(raw, "type string, n long", models.StubChat())).alias("parsed"))


@query(
    """WITH f(name, value) AS (VALUES ('CanceledDueToTimeout', 1), ('DotNetTestsRunFailure', 2), ('DotNetBuildFailure', 4), ('TimeoutDueToLongRunningTest', 8))
    SELECT name, value, count(l_orderkey)::BIGINT AS n FROM f LEFT JOIN lineitem ON (1 << (l_linenumber - 1)) & value <> 0 GROUP BY ALL"""
)
def failure_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known failures, and how many lines have the flag of each."""
    from sparkloom.functions.flags import FAILURES

    flag = F.expr("shiftleft(1, CAST(l_linenumber - 1 AS INT))")
    counts = table(spark, sf_dir, "lineitem").agg(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"), F.count_if(flag.bitwiseAND(F.lit(v)) != 0).alias("n")) for n, v in FAILURES.items())).alias("c"))
    return counts.select(F.explode("c").alias("c")).select("c.*")
