"""Console pages of a CI server as a tree of stages, one page at a time in Arrow batches.

A page is a stream of spans and texts. Spans with a label open a stage; others close one, switch to the output of
another, or carry output. What a text belongs to follows from the spans before it, so a page is one ordered fold.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.flags import FAILURES
from sparkloom.functions.html import Node, parse

# What the server and the build tools print.
ISO_DATE = re.compile(r"\[\d{4}-\d{2}-\d{2}T[^\]]+\]")
CLOCK = re.compile(r"\d{2}:\d{2}:\d{2}")
CLOSE = re.compile(r"\s*\[Pipeline]\s*}\s*\Z")
SKIPPED = re.compile(r'Stage\s+"([^"]+)"\s+skipped due to [^\r\n]+', re.I)
FAILED_BRANCH = re.compile(r"Failed in branch\s+(.+)")
FINISHED = re.compile(r"Finished:\s*([A-Z]+)\Z")
TAG = re.compile(r"BUILD_TAG=(.+)")
TESTS_FAILED = re.compile(r"Failed!\s*-\s*Failed:\s*\d+,\s*Passed:\s*\d+,\s*Skipped:\s*\d+")
BUILD_FAILED = re.compile(r'Done Building Project ".*" \(.+\) -- FAILED\.\Z')
CANCELLED = ("cancelling nested steps due to timeout", "attempting to cancel the build...")
LONG_TEST = "[long running test]"

STAGE = "struct<stage_id:int,parent_id:int,name:string,is_parallel:boolean,is_finished:boolean,is_failed:boolean,is_skipped:boolean,failure_flags:int,output:string,ord:int>"
PIPELINE = f"struct<build_tag:string,finish_status:string,summary:string,failed:array<string>,skipped:array<string>,stages:array<{STAGE}>>"


@dataclass
class Stage:
    id: int
    name: str
    parent: Stage | None
    parallel: bool
    children: list[Stage] = field(default_factory=list)
    finished: bool = False
    failed: bool = False
    skipped: bool = False
    flags: int = 0
    output: list[str] = field(default_factory=list)

    def below(self, what: str) -> bool:
        return any(getattr(c, what) or c.below(what) for c in self.children)

    def title(self) -> str:
        return f'{"Parallel Stage" if self.parallel else "Stage"} "{self.name}"'

    def suffix(self) -> str:
        return f', Parent stage: "{self.parent.name}"' if self.parent else ""


class Console:
    def __init__(self) -> None:
        self.stages: dict[int, Stage] = {}
        self.by_name: dict[str, Stage] = {}
        self.enclosing: dict[int, int] = {}
        self.current: int | None = None
        self.last_line = self.status = ""
        self.tag: str | None = None
        self.summary: list[str] = []
        self.failed: list[str] = []
        self.skipped: list[str] = []

    def ancestor(self, node: int) -> Stage | None:
        """The nearest stage around a node; nothing if the nodes lead in a circle."""
        seen = set()
        while node in self.enclosing and node not in seen:
            seen.add(node)
            node = self.enclosing[node]
            if node in self.stages:
                return self.stages[node]
        return None

    def stage_at(self, node: int | None) -> Stage | None:
        return None if node is None else self.stages.get(node) or self.ancestor(node)

    def run(self, root: Node, start_as_node: bool = False) -> Console:
        """start_as_node: take a span's startId for its nodeId."""
        for node in root.walk():
            text = html.unescape(node.inner()).strip()
            if node.name not in ("", "span") or (not node.name and not text):
                continue
            kind = node.attributes.get("class", "")
            if (kind == "timestamp" and CLOCK.search(text)) or (node.attributes.get("style") == "display: none" and ISO_DATE.search(text)):
                continue
            if m := re.fullmatch(r"pipeline-node-(\d+)", kind):
                self.current = self.enclosing.get(int(m[1]), self.current)
                continue
            self.notice(text)
            if node.name:
                self.span(node, kind, text, start_as_node)
            else:
                self.text(html.unescape(node.text), text)
        return self

    def notice(self, text: str) -> None:
        if m := FINISHED.search(text):
            self.status = m[1]
        for names, found, mark in ((self.skipped, SKIPPED, "skipped"), (self.failed, FAILED_BRANCH, "failed")):
            if m := found.search(text):
                name = m[1].strip()
                names.append(name)
                if name in self.by_name:
                    setattr(self.by_name[name], mark, True)

    def span(self, node: Node, kind: str, text: str, start_as_node: bool) -> None:
        number = lambda k: int(v) if (v := node.attributes.get(k, "")).isdigit() else None
        start, around = number("startid"), number("enclosingid")
        own = start if start_as_node else number("nodeid")
        if kind == "pipeline-new-node" and own is not None and around is not None:
            self.enclosing[number("nodeid") if number("nodeid") is not None else own] = around
        if start is not None and around is not None:
            self.enclosing[start] = around
        label = node.attributes.get("label", "")
        if label and start is not None and around is not None:
            self.opened(label, start, around)
        elif start is not None and CLOSE.match(text):
            self.closed(start)
        elif start is not None:
            if start in self.stages:
                self.stages[start].output.append(text)
        elif around is not None:
            self.current = around
            if stage := self.stage_at(around):
                stage.output.append(text)

    def opened(self, label: str, start: int, around: int) -> None:
        name = label.replace("Branch: ", "")
        if start not in self.stages and name not in self.by_name:
            stage = Stage(start, name, self.ancestor(start), "Branch: " in label)
            self.stages[start] = self.by_name[name] = stage
            if stage.parent:
                stage.parent.children.append(stage)
            self.summary.append(f"{stage.title()} started{stage.suffix()}")
        self.current = around

    def closed(self, start: int) -> None:
        self.current = None
        stage = self.stages.get(start)
        if not stage:
            return
        stage.finished = True
        how = "finished with failure" if stage.failed else "skipped" if stage.skipped else "finished"
        below = [w for w in ("failed", "skipped") if stage.below(w)]
        if below:
            how += " with " + " and ".join(f"{w} child stages" for w in below)
        if stage.flags:
            names = [n for n, v in sorted(FAILURES.items(), key=lambda x: x[1]) if stage.flags & v]
            how += f" {'and' if below else 'with'} detected failures: {', '.join(names)}"
        line = f"{stage.title()} {how}{stage.suffix()}"
        stage.output.append(line)
        self.summary.append(line)

    def text(self, raw: str, text: str) -> None:
        if m := TAG.fullmatch(text):
            self.tag = m[1]
            return
        stage = self.stage_at(self.current)
        if stage:
            stage.output.append(raw)
            if TESTS_FAILED.match(text):
                stage.flags |= FAILURES["DotNetTestsRunFailure"]
            elif BUILD_FAILED.match(text):
                stage.flags |= FAILURES["DotNetBuildFailure"]
            elif text.lower() in CANCELLED:
                stage.flags |= FAILURES["CanceledDueToTimeout"]
                alone = stage.parent and not stage.children and len(stage.parent.children) == 1
                if LONG_TEST in self.last_line.lower() or (alone and stage.parent.flags & FAILURES["TimeoutDueToLongRunningTest"]):
                    stage.flags |= FAILURES["TimeoutDueToLongRunningTest"]
        if ISO_DATE.sub("", text).strip() and CLOCK.sub("", text).strip():
            self.last_line = text

    def result(self) -> dict:
        failed = list(dict.fromkeys(self.failed))
        return {
            "build_tag": self.tag,
            "finish_status": self.status,
            "summary": "\n".join(self.summary),
            "failed": failed,
            "skipped": [n for n in dict.fromkeys(self.skipped) if n not in failed],
            "stages": [
                {"stage_id": s.id, "parent_id": s.parent and s.parent.id, "name": s.name, "is_parallel": s.parallel, "is_finished": s.finished, "is_failed": s.failed, "is_skipped": s.skipped, "failure_flags": s.flags, "output": "\n".join(s.output), "ord": i}
                for i, s in enumerate(self.stages.values())
            ],
        }


def read_console(page: str | None, start_as_node: bool = False) -> dict | None:
    """A page's pipeline; nothing if the page has no element with the id out."""
    clean = re.sub(r"(?is)<(script|template|dialog|svg)\b.*?</\1>", "", page or "")
    root = next((n for n in parse(clean).walk() if n.attributes.get("id") == "out"), None)
    return root and Console().run(root, start_as_node).result()


def pipeline_of(page: Column) -> Column:
    @F.pandas_udf(PIPELINE)
    def run(pages: pd.Series) -> pd.DataFrame:
        found = [read_console(p) or {"build_tag": None, "finish_status": None, "summary": None, "failed": None, "skipped": None, "stages": None} for p in pages]
        return pd.DataFrame(found)

    return run(page)


def stage_markdown(stage: Column, path: Column) -> Column:
    """A stage's section of a report; path: names of the stages around it, null for none."""
    mark = F.when(stage["is_failed"], " [FAILED]").when(stage["is_skipped"], " [SKIPPED]").otherwise("")
    head = F.concat(F.lit("### ["), F.when(path.isNull(), "").otherwise("Child "), F.lit("Stage #"), stage["stage_id"].cast("string"), F.lit("] "), stage["name"], mark)
    where = F.when(path.isNotNull(), F.concat(F.lit("\n- **Path**: "), path, F.lit(" > "), stage["name"])).otherwise("")
    facts = F.concat_ws("\n", *(F.concat(F.lit(f"- **{n}**: "), stage[n].cast("string")) for n in ("is_parallel", "is_finished", "is_failed", "is_skipped", "failure_flags")))
    return F.concat(head, where, F.lit("\n"), facts, F.lit("\n#### **Output**:\n<details>\n<summary>Click to expand</summary>\n"), stage["output"], F.lit("\n</details>"))


def pipeline_markdown(p: Column) -> Column:
    listed = lambda c: F.array_join(F.transform(p[c], lambda n: F.concat(F.lit("- "), n)), "\n")
    stages = F.array_join(F.transform(p["stages"], lambda s: stage_markdown(s, F.lit(None).cast("string"))), "\n\n")
    return F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce(p["build_tag"], F.lit("unnamed")), F.lit(" ("), p["finish_status"], F.lit(")")), F.lit("## Failed Stages"), listed("failed"), F.lit("## Skipped Stages"), listed("skipped"), F.lit("## Summary"), p["summary"], F.lit("## Stages"), stages)


def pipeline_json(pipeline: Column) -> Column:
    """A pipeline's summary as JSON: its tag, how it finished, and the stages that failed or were skipped."""
    return F.to_json(F.struct(*(pipeline[c].alias(c) for c in ("build_tag", "finish_status", "failed", "skipped"))))
