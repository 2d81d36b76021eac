"""What callers add: generators of samples, kinds of files, endpoints whose vectors are counted, batched repairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import triage
from sparkloom.operators import models, segments


def test_generators_make_samples(spark):
    docs = spark.createDataFrame([(1, "S3", "a. b. c"), (2, "S4", ""), (3, None, None)], "doc_id int, space string, md string")

    def sentences(metadata: dict, text: str):
        for s in text.split(". "):
            if s:
                yield f"{metadata['space']}: {s}"

    found = segments.generated(docs, sentences, "doc_id")
    assert found.columns == ["doc_id", "pos", "sample"]
    assert sorted(map(tuple, found.collect())) == [(1, 0, "S3: a"), (1, 1, "S3: b"), (1, 2, "S3: c")]
    assert segments.generated(docs, lambda m, t: ["x"] * m["doc_id"], "doc_id").groupBy("doc_id").count().orderBy("doc_id").collect()[2]["count"] == 3
    with pytest.raises(Exception, match="takes a struct and a text"):
        segments.generated(docs.withColumn("md", F.lit(1)), sentences, "doc_id").collect()


PYTHON = triage.FileKind((".py",), triage.language("def class import from return if else for while None True False try except raise await async".split(), r'|"""(?:.|\n)*?"""', r"\b[_A-Za-z]\w*\b", r"\s*(?:import|from)\b"), (("generated-artifact", r"_pb2\.py$"),))


def test_a_third_language(spark):
    rows = [("a.py", "@@ -1,1 +1,1 @@\n-import a\n+import b"), ("x_pb2.py", "@@ -1,1 +1,1 @@\n-x = 1\n+x = 2"), ("b.py", "@@ -1,1 +1,1 @@\n-    return f(x)\n+    raise E(x)"), ("c.cs", "@@ -1,1 +1,1 @@\n-using A;\n+using B;"), ("d.md", "-a\n+b")]
    df = spark.createDataFrame(rows, "path string, diff string")
    known = {r["path"]: r["t"]["reason"] for r in df.select("path", triage.triage(F.col("path"), F.col("diff")).alias("t")).collect()}
    found = {r["path"]: r["t"]["reason"] for r in df.select("path", triage.triage(F.col("path"), F.col("diff"), (PYTHON,)).alias("t")).collect()}
    assert known["a.py"] is None and known["b.py"] is None and found["d.md"] is None and found["c.cs"] == known["c.cs"]
    assert "imports-only" in found["a.py"] and "generated-artifact" in found["x_pb2.py"] and "control-flow-changed" not in (found["a.py"] or "") and found["b.py"]


def test_labels_of_paths_alike_in_both(spark):
    paths = ["src/a.cs", "src\\Obj\\a.CS", "a.Designer.cs", "x/.github/b.ts", "lib/j.min.js", "webpack.config.js", "a.g.cs", "ag.cs", "bin/a.cs", "q/bin/a.cs", "a.md", "csx", None, "x_pb2.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for kinds in (triage.KINDS, (PYTHON, *triage.KINDS)):
        got = {r["path"]: r["l"] for r in df.select("path", triage.path_labels(F.col("path"), kinds).alias("l")).collect()}
        for p in paths:
            want = triage.noise((p or "").replace("\\", "/").lower(), kinds)
            assert (sorted(got[p]) if got[p] is not None else None) == (sorted(want[1]) if want else None), p


class Odd(models.StubEmbedder):
    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[0.0] * self.dimensions if t == "zero" else v[:-1] if t == "short" else v for t, v in zip(texts, super().embed(texts), strict=True)]


def test_vectors_are_counted_as_they_pass(spark, tmp_path):
    rows = spark.createDataFrame([(i, "zero" if i % 10 == 0 else "short" if i % 7 == 0 else f"t{i}") for i in range(200)], "id int, text string").repartition(3)
    found, seen = models.embedded(rows, "text", Odd(16), batch=8)
    found.write.parquet(f"file://{tmp_path}/v")
    assert seen.get == {"rows": 200, "bad_dimension": 26, "zero_vector": 20}
    assert models.warnings(seen.get, 16) == ["26 of 200 vectors have another dimension than 16", "20 of 200 vectors are all but zero"]
    assert models.warnings({"rows": 1, "bad_dimension": 0, "zero_vector": 0}, 16) == []


class Slow:
    """Repairs by taking off a letter, and writes down how many prompts each request had."""

    def __init__(self, path: str):
        self.path = path

    def complete(self, prompts: list[str]) -> list[str]:
        with open(self.path, "a") as f:
            f.write(f"{len(prompts)}\n")
        return [p.removeprefix("Repair: ")[1:] if p.startswith("Repair: ") else f"<{p}>" for p in prompts]


def test_open_rows_are_asked_together(spark, tmp_path):
    log = f"{tmp_path}/asked"
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, '}{"a": 2}'), (3, '}}{"a": 3}'), (4, "none")], "id int, t string").coalesce(1)

    got = {r["id"]: r["s"] for r in rows.select("id", models.structured(F.col("t"), "a int", Slow(log), 3).alias("s")).collect()}
    assert got[1]["a"] == 1 and got[2]["a"] == 2 and got[3]["a"] == 3 and (got[4] is None or got[4]["a"] is None)
    assert all(int(n) <= 4 for n in open(log).read().split()) and len(open(log).read().split()) <= 3
    contexts = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d"]), (3, []), (4, None)], "id int, c array<string>").coalesce(1)
    before = len(open(log).read().split())
    got = {r["id"]: r["a"] for r in contexts.select("id", models.refined(F.col("c"), Slow(log), "F", "N", ("Z",)).alias("a")).collect()}
    assert got == {1: "<Z\n<N\n<N\n<F\na>\nb>\nc>>", 2: "<Z\n<F\nd>>", 3: None, 4: None}
    assert open(log).read().split()[before:] == ["2", "1", "1", "2"]
