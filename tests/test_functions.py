"""Golden cases of scalar functions, folds and renderers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import ci, flags, html, triage
from sparkloom.functions import text as X
from sparkloom.operators import packing, segments


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_series(spark):
    assert one(spark, X.series_of(F.lit("Series 4 and s5, S4 again, xS6"))) == ["S4", "S5"]
    assert one(spark, X.series_union(F.lit("s3"), F.array(F.lit("S6"), F.lit("S3")), F.lit(None).cast("array<string>"))) == ["S3", "S6"]


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("# A\n### B\nt1\n### C\nt2", [("A > B", "t1"), ("A > B > C", "t2")]),
        ("p\n# 1. Intro\n\n# Next", [("", "p"), ("Intro", "")]),
        ("# A\n## B\nx\n# C\ny", [("A > B", "x"), ("C", "y")]),
    ],
)
def test_segments(spark, md, want):
    assert [tuple(s) for s in one(spark, segments.segments(F.lit(md)))] == want


def test_think_and_json(spark):
    raw = F.lit("<think>a</think>b")
    assert one(spark, X.without_thinking(raw)) == "b" and one(spark, X.thinking(raw)) == "a"
    assert one(spark, X.json_slice(F.lit("x {1} y} z"))) == "{1} y}"
    assert one(spark, X.json_slice(F.lit("no braces"))) is None


def test_tokens_and_fit(spark):
    assert one(spark, X.tokens_estimated(F.lit("é€a"))) == 2
    fits = [one(spark, X.context_fit(F.lit(n), 50)) for n in (100, 101, 200)]
    assert fits == ["FitGuaranteed", "Ambiguous", "ExceedLikely"]
    with pytest.raises(ValueError):
        X.tokens_estimated(F.lit("a"), 0)


def test_decide(spark):
    def of(*labels):
        return tuple(one(spark, X.decide(F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>"))))

    assert of("logic-changed", "pure-rename") == (False, "pure-rename")
    assert of("logic-changed", "comments-only") == (True, "mixed-keep;logic-changed;comments-only")
    assert of() == (True, "uncertain-keep")


def test_flags(spark):
    assert one(spark, flags.lowest(F.lit(6))) == 2 and one(spark, flags.up_to(F.lit(6), F.lit(2))) == 2
    assert one(spark, flags.names_of(F.lit(5), flags.FAILURES)) == ["CanceledDueToTimeout", "DotNetBuildFailure"]


def test_locators(spark):
    u = F.lit("http://h/display/SP/My+Title#f")
    assert (one(spark, X.space_of(u)), one(spark, X.title_of(u)), one(spark, X.page_id_of(u))) == ("SP", "My Title", None)
    assert one(spark, X.page_id_of(F.lit("http://h/p?a=1&pageId=12"))) == "12"
    assert one(spark, X.title_query(F.lit("A+b c"), F.lit("S"))) == "title=A%20b%20c&spaceKey=S"


def test_errors_and_trims(spark):
    with pytest.raises(Exception, match="unknown file status"):
        one(spark, X.file_status(F.lit("copied")))
    assert one(spark, X.clean_title(F.lit("Plan DRAFT - ."), "draft")) == "Plan"
    assert one(spark, X.method_table(F.lit("a\nMethodTable: 00 7ff\nMethodTable: x"))) == "7ff"
    assert one(spark, X.fill(F.lit("{a}-{b}"), {"a": F.lit(1), "b": F.lit("z")})) == "1-z"


def test_html():
    md = html.Renderer().render('<div>x<p>A <a href="u">L</a></p></div>')
    assert md == "A [L](u)"
    page = "<h2>T &amp; U</h2><ol><li>a</li><li>b<ul><li>c</li></ul></li></ol><table><tr><th>Owner</th></tr><tr><td>me</td></tr></table><pre>x\ny</pre><script>z</script><img><p><img alt='i'><code> k </code>"
    assert html.Renderer().render(page) == "## T & U\n\n  1. a\n  2. bc\n| Owner |\n| --- |\n| me |\n\n```\nx\ny\n```\n\n![i]`k`"
    assert "Owner" not in html.Renderer(meta_tables=False).render(page)
    assert html.Renderer(False).render('<p><a href="u">L</a></p><hr>') == "L (u)\n\n--------------------"
    assert html.Renderer().render(None) == ""
    assert html.sections("<h1>A</h1><p>x</p><h3>B</h3><ol><li>i</li></ol><ul><li>j</li></ul>") == [("A", "x"), ("A > B", "i\n1. i\nj\n2. j")]


def test_console():
    page = (
        '<pre id="out">BUILD_TAG=t-1<span class="pipeline-new-node" nodeId="5" startId="5" enclosingId="2" label="Build">[Pipeline] { (Build)</span>'
        '<span class="pipeline-new-node" nodeId="6" startId="6" enclosingId="5" label="Branch: Test">[Pipeline] { (Test)</span>'
        '<span class="pipeline-new-node" nodeId="8" enclosingId="6">sh</span><span class="pipeline-node-8"></span>Failed! - Failed: 1, Passed: 2, Skipped: 0'
        '<span class="timestamp">10:00:00</span><span startId="6">[Pipeline] }</span>tail\nFailed in branch Test<span startId="5">[Pipeline] }</span>Finished: FAILURE</pre>'
    )
    p = ci.read_console(page)
    assert (p["build_tag"], p["finish_status"], p["failed"]) == ("t-1", "FAILURE", ["Test"])
    build, test = p["stages"]
    assert (build["name"], build["parent_id"], test["parent_id"], test["is_parallel"], test["failure_flags"]) == ("Build", None, 5, True, 2)
    assert test["is_failed"] and 'Stage "Build" finished with failed child stages' in p["summary"]
    assert "tail" not in test["output"]  # closing a stage ends what text belongs to it
    assert ci.read_console("<p>none</p>") is None
    looped = ci.Console()
    looped.enclosing = {1: 2, 2: 1}
    assert looped.ancestor(1) is None


@pytest.mark.parametrize(
    ("path", "diff", "want"),
    [
        ("a.cs", "@@ -1,1 +1,1 @@\n-// a\n+// b", (False, "comments-only")),
        ("a.cs", "@@ -1,1 +1,1 @@\n-if (a) return 1;\n+while (a) return 1;", (True, "logic-changed;control-flow-changed")),
        ("a.cs", "", (False, "whitespace-only")),
        ("a.ts", "@@ -1,2 +1,1 @@\n-import x\n-import y", (True, "mixed-keep;logic-changed;deletions-only;imports-only")),
        ("a.md", "-x", None),
    ],
)
def test_triage(path, diff, want):
    assert triage.classify(path, diff) == want


def test_lexer_and_declarations():
    kinds = [(t.kind, t.text) for t in triage.CSHARP.tokens('var x = "a//b"; // c')]
    assert kinds == [("word", "var"), ("id", "x"), ("punct", "="), ("other", '"'), ("id", "a")]
    assert [t.text for t in triage.SCRIPT.tokens("let $a = `s` + 0x1F")] == ["let", "$", "a", "=", "<str>", "+", "<num>"]
    assert triage.declarations("class A {\n  public int F(int x) {\n    return G(x);\n  }\n}") == {0: "class A", 1: "public int F(int x)"}
    assert triage.distance("kitten", "sitting") == 3


def test_packing(spark):
    rows = spark.createDataFrame([(1, 65_530), (2, 10)], "k int, n int")
    assert [r["k"] for r in packing.truncate(rows, "n", (F.col("k"),)).collect()] == [1]
    sizes = F.array(*(F.lit(n) for n in (100, 90, 80, 10)))
    assert one(spark, packing.bins(sizes, 50)) == [0, 1, 2, 2]


def test_exact_tokens(spark):
    import public_tokenizers as P

    from sparkloom.functions.tokens import count_tokens

    files = {"known": P.path("byte_bpe_50k.tiktoken")}
    assert one(spark, count_tokens(F.lit("hello world"), "known", files, P.PATTERN)) == 2
    assert one(spark, count_tokens(F.lit("hello world"), "other", files, P.PATTERN)) == 4


def test_json_without_hidden(spark):
    from sparkloom.operators.flows import as_json

    rows = spark.createDataFrame([(1, "s")], "a int, secret string")
    assert [r["json"] for r in as_json(rows, "secret").collect()] == ['{"a":1}']
