"""Token counts, conversation repair and the filter audit against the library and plain versions, and their edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import conversations, filter_audit, queries, token_counts
from tests.compare import connection, same

DOCS = "doc_id long, text string, lang string"
CLASHES = "word texts n own size settled rest doc rows times part mask _id good toxic k x".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward() -> list[tuple]:
    rng = random.Random(7)
    some = ["the", "The", "don't", "we'LL", "naïve", "ǅ", "é", " x ", "a\x1cb", "日本語", "12345", "#$%", "😀😀", "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>", "a b", "́́", "ΑΣ", "İ", "ﬁ", "\x00", "word"]
    texts = [" ".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(40)]
    texts += [None, "", " \n\t\r\x0b\x0c ", "\n".join(some), "\x85".join(some), "x" * 30_000, "é" * 9000 + " z", " ".join(f"w{i % 5000}q" for i in range(30_000)), texts[0], texts[0]]
    return [(i if i % 9 else None, t, ("en", None, "")[i % 3]) for i, t in enumerate(texts)] + [(1, texts[1], "en")] * 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).select("*", *(F.lit("clash").alias(c) for c in CLASHES))


# 11 token counts


def library_counts(rows: list[tuple]) -> list[tuple]:
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(queries.tokenizer_bytes("word_bpe_49k.json").decode())
    out = []
    for doc, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        out.append((-1 if doc is None else doc, len((text or "").encode()), n, n > 2048))
    return sorted(out)


def counted(df) -> list[tuple]:
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


@pytest.mark.parametrize("most", [0, 5, 200_000])
def test_counts_as_library(docs, most):
    """With no, few and all pre-tokens held to be common."""
    got = token_counts.token_counts(docs, queries.tokenizer_bytes("word_bpe_49k.json"), most_rows=most)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert counted(got) == library_counts(awkward())


def test_count_query_as_library(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert counted(queries.QUERIES["op11_token_counts"](spark, sf_dir)) == library_counts(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n\x0b'sST.,́  e<|>"), st.characters(exclude_categories=["Cs"])), max_size=12), max_size=4))
def test_texts_count_as_their_words(texts):
    """What the operator rests on: white space parts a text into parts that can be counted one by one."""
    t = queries.tokenizer_bytes("word_bpe_49k.json")
    text = " <|endoftext|>".join(texts)
    parts = [w.decode() for w in text.encode().split()]
    assert sum(token_counts.count_pieces(t, parts)) == token_counts.count_pieces(t, [text])[0]


def test_words_are_counted_once(docs):
    words = token_counts.vocabulary(docs, queries.tokenizer_bytes("word_bpe_49k.json")).collect()
    texts = [set((t or "").encode().split()) for _, t, _ in awkward()]
    assert len(words) == len({bytes(r["word"]) for r in words}) == len(set().union(*texts))
    assert all(r["texts"] == sum(bytes(r["word"]) in t for t in texts) for r in words)


def test_tasks_hand_on_full_dictionaries(docs, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_counts, "HELD", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c", "d e a", None, "a"], pa.string())], names=["text"])
    total: dict[bytes, int] = {}
    for out in token_counts._gather(iter([batch])):
        for word, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            total[word] = total.get(word, 0) + n
    assert total == {b"a": 3, b"b": 1, b"c": 1, b"d": 1, b"e": 1}


def test_counts_of_an_empty_table_and_other_tokenizers(spark, docs):
    assert token_counts.token_counts(docs.limit(0), queries.tokenizer_bytes("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        token_counts.counter(queries.tokenizer_bytes("byte_bpe_50k.json"))


# 12 conversation repair


def cheapest(signature: str) -> tuple[int, str]:
    """By trying everything that costs no more than deleting all rows."""
    best = (2 * len(signature), "D" * len(signature))

    def go(i: int, cost: int, audit: str, out: str) -> None:
        nonlocal best
        if cost > best[0]:
            return
        if i == len(signature) and re.fullmatch("(s?(ua)+)?", out):
            best = min(best, (cost, audit))
        for r in "ua":
            go(i, cost + 5, audit + "I", out + r)
        if i < len(signature):
            c = signature[i]
            go(i + 1, cost + 2, audit + "D", out)
            if c != "D":
                late = 5 * c.isupper()
                go(i + 1, cost + late, audit + "K", out + c.lower())
                for r in "ua":
                    go(i + 1, cost + late + 1, audit + "R", out + r)

    go(0, 0, "", "")
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("suaoSUAOD", max_size=6))
def test_cheapest_edits(signature):
    assert conversations.solve(signature) == cheapest(signature)


def test_long_signatures():
    cost, audit = conversations.solve("s" + "ua" * 30_000)
    assert cost == 0 and audit == "K" * 60_001
    assert conversations.solve("u" * 4001) == (2002, "D" + "KR" * 2000)


def plain_repair(rows: list[tuple]) -> dict:
    """conv_id, turn, role, text -> conv_id: the report's row."""
    spaced = lambda x: " " if x is None else str(x)
    out: dict = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if kind == 4:
            role = "user"
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    report = {}
    for conv, found in out.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, sign, faults = set(), "", []
        for _, role, text in found:
            bare = WORD.findall(text)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1][-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            sign += "D" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        turns = [t for t, _, _ in found if t is not None]
        cost, audit = conversations.solve(sign) if len(sign) > 8 else cheapest(sign)
        lines, i, roles = [], 0, ""
        for edit in audit:
            after = {"": "u", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
            role, text = (found[i][1], found[i][2]) if edit != "I" else ("", "")
            i += edit != "I"
            if edit != "D":
                if edit != "K":
                    role = {"u": "user", "a": "assistant"}[after]
                roles += role[0]
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", roles)
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        report[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return report


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def broken() -> list[tuple]:
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "s"], ["Yes.", "No", "Why? ", "", None, " \t", "Fine!\n", "é€.", "x" * 20_000 + ".", "So.\x1c"]
    rows = [(c, rng.choice([None, *range(-2, 9)]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(None, t, r, "Both.") for t, r in ((0, "user"), (1, "assistant"), (None, "user"))]
    rows += [(77, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]
    return rows + [(99, 3, "user", "Same.")] * 4


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame(broken(), CONVERSATIONS).select("*", *(F.lit("clash").alias(c) for c in ("copy", "kind", "pos", "sign", "audit", "cost", "place", "edit", "signature", "id", "_h", "convs")))


def test_repairs_as_plain(talk):
    got = conversations.repair_report(talk)
    assert got.columns == ["conv_id", *REPORT]
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == plain_repair(broken())


def test_repair_query_as_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, sf_dir).collect()} == plain_repair(rows)


def test_repairs_as_sql(spark, talk):
    con = connection("/root/testdata/sf0.001")
    con.execute("DROP VIEW conversations")
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", broken())
    same(conversations.repair_report(talk), con, conversations.SQL)


def test_repaired_rows(spark):
    rows = conversations.inspected(spark.createDataFrame([(1, 0, "user", "A.", 0), (1, 1, "user", "B.", 0), (1, 2, "user", "cut", 0), (2, 0, "user", "", 0)], "conv_id long, turn long, role string, text string, copy int"))
    audits = conversations.audited(conversations.summaries(rows))
    assert {r["conv_id"]: (r["signature"], r["audit"]) for r in audits.collect()} == {1: ("uuU", "KRD"), 2: ("D", "D")}
    assert [tuple(r) for r in conversations.repaired(rows, audits).collect()] == [(1, 1, "user", "A.", "K"), (1, 2, "assistant", "B.", "R")]


def test_repair_of_an_empty_table(talk):
    assert conversations.repair_report(talk.limit(0)).count() == 0


def test_all_rows_dropped(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (row,) = conversations.repair_report(spark.createDataFrame([(5, gone, "user", "Hi.")], CONVERSATIONS)).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# 13 filter interaction audit


def plain_audit(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    first: dict[str, int] = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    failed = []
    for doc, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc is not None and first[text] < doc}
        own = [x for x in labels if x[0] is not None and x[0] == doc]
        failed.append((lang or "", "".join(f for f in "ABCDE" if fails[f]), any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {f[0] for f in failed}:
        docs, gone_by, found = [f[1:] for f in failed if f[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                gone_by[x] += len(gone)
                found.append((part, order, step, len(left), len(gone), sum(x in d[0] for d in docs) - len(gone), sum(d[0] == x for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*f, gone_by[f[1][f[2] - 1]]) for f in found]
    return sorted(out)


def corpus() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(rng.choice([20, 400]))] + ["A", "B#"][: rng.randint(0, 2)], k=rng.choice([30, 99, 100, 140]))) for _ in range(30)] + [None, "", " ", "ABC", "é" * 100]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(200)]
    rows += [(rng.randrange(100), "the same " * 60, "en") for _ in range(100)]
    labels = [(rng.choice([None, *range(120)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    return rows, labels


@pytest.fixture(scope="module")
def marked(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(5).select("*", *(F.lit("clash").alias(c) for c in CLASHES))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))


def test_audit_as_plain(marked):
    got = filter_audit.audit(*marked)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(*corpus())


def test_audit_in_small_chunks(marked, monkeypatch):
    """Texts that a task hands on early are still compared with all others."""
    docs, _ = marked
    whole = sorted(filter_audit.failures(docs).collect(), key=str)
    rows = [(r["doc_id"], r["text"], r["lang"] or "") for r in docs.collect()]
    monkeypatch.setattr(filter_audit, "CHUNK_BYTES", 500)
    parted = sorted((filter_audit._keyed(x) for at in range(0, len(rows), 37) for x in filter_audit._compared(iter(rows[at : at + 37]))), key=lambda kv: kv[0])
    assert sorted(filter_audit._resolved(iter(parted)), key=str) == whole


def test_equal_fingerprints_decide_nothing(monkeypatch):
    """All texts under one fingerprint: the chain tells them apart."""
    rows, _ = corpus()
    given_rows = [(d, t, lang or "") for d, t, lang in rows]
    keyed = lambda: sorted((filter_audit._keyed(x) for x in filter_audit._compared(iter(given_rows))), key=lambda kv: kv[0])
    want = sorted(filter_audit._resolved(iter(keyed())), key=str)
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda raw: 7)
    assert sorted(filter_audit._resolved(iter(keyed())), key=str) == want


def test_audit_of_empty_tables(marked):
    docs, labels = marked
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
