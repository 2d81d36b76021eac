"""How many tokens texts have, without encoding any text: the pieces of each distinct pre-token are counted once.

A pre-token here is what stands between ASCII white space (space, \\t, \\n, \\v, \\f, \\r). For tokenizers that drop white
space before they merge, no piece, no special string and no composition of characters reaches across it, so a text has as
many tokens as its pre-tokens together, each taken as a text of its own. ``counter`` refuses other tokenizers.

1. Every task gathers the distinct pre-tokens of its texts, with how many texts hold each; a shuffle brings them together,
   and the library counts the pieces of each once (``vocabulary``).
2. The pre-tokens that most texts hold, as many as fit COMMON_ROWS and COMMON_BYTES, go to all tasks. There they are joined
   to the frequencies of every text where it lies. Nearly all of a text is settled that way, so no frequent pre-token is
   ever a key of a shuffle.
3. The other frequencies are joined to their counts by a shuffle, and the sums come together by text.

Neither ids nor pieces are held. Every row is treated alike at any size; what is common changes the way, not the result.

Defined results: a null text counts as an empty one (no tokens). Texts without a pre-token have none. Rows with a null id
and repeated rows are counted each. Other columns of the table are not looked at, whatever their names. An empty table gives
no rows. A pre-token may be as long as its text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.llm.arrow import bounded, pieces
from sparkloom.storage import materialize

#: A task hands on its distinct pre-tokens when it holds so many of them, or so many bytes.
HELD, HELD_BYTES = 300_000, 32 << 20
#: What is sent to all tasks: at most so many pre-tokens with so many bytes together, none longer than COMMON_LENGTH.
COMMON_ROWS, COMMON_BYTES, COMMON_LENGTH = 200_000, 4 << 20, 64
#: Rows of a batch that a task gives back.
OUT = 20_000

_COUNTERS: dict[bytes, object] = {}


def counter(tokenizer: bytes):
    """The worker's tokenizer of this file, made once. An error if it does not drop white space first."""
    key = hashlib.sha256(tokenizer).digest()
    if key not in _COUNTERS:
        from tokenizers import Tokenizer

        found = Tokenizer.from_buffer(tokenizer)
        found.no_truncation()
        found.no_padding()
        probe = [len(found.encode(t, add_special_tokens=False).ids) for t in ("a", " a", "a ", " \t\n\v\f\r", "a b", "a \n\t b")]
        if probe != [probe[0]] * 3 + [0] + [2 * probe[0]] * 2:
            raise ValueError("the tokenizer gives white space tokens, so texts can't be counted by the words between it")
        _COUNTERS[key] = found
    return _COUNTERS[key]


def count_pieces(tokenizer: bytes, texts: list[str]) -> list[int]:
    """Tokens of each string, as the library gives them, without added special tokens."""
    return [len(e) for e in counter(tokenizer).encode_batch_fast(texts, add_special_tokens=False)]


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # bytes split at ASCII white space only


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        words, texts = list(held), list(held.values())
        for at in range(0, len(words), OUT):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + OUT], pa.binary()), pa.array(texts[at : at + OUT], pa.int64())], names=["word", "texts"])

    for batch in pieces(batches):
        for text in batch.column(0).to_pylist():
            before = len(held)
            found = set(_words(text))
            size += sum(map(len, found)) if len(found) > HELD else 0
            held.update(found)
            size += 12 * (len(held) - before)
            if len(held) > HELD or size > HELD_BYTES:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def vocabulary(docs: DataFrame, tokenizer: bytes, text_col: str = "text") -> DataFrame:
    """The distinct pre-tokens of all texts: word (its UTF-8 bytes), texts (how many hold it), n (its pieces). Written to a
    table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, OUT):
            words = batch.column(0).to_pylist()
            n = count_pieces(tokenizer, [w.decode() for w in words])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["word", "texts", "n"])

    # null texts have no pre-tokens
    found = bounded(docs).select(F.col(f"`{text_col}`").alias("text")).filter("text is not null").mapInArrow(_gather, "word binary, texts long")
    return materialize(found.groupBy("word").agg(F.sum("texts").alias("texts")).mapInArrow(run, "word binary, texts long, n long"), "pre-tokens")


def common(words: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """The pre-tokens that most texts hold, within the bounds: those in at least so many texts, in steps of an eighth of a
    power of two."""
    step = F.floor(F.log2("texts") * 8).cast("int")
    short = words.filter(F.length("word") <= COMMON_LENGTH)
    least, rows, size = None, 0, 0
    for r in sorted(short.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.sum(F.length("word")).alias("size")).collect(), reverse=True):  # at most 512
        rows, size = rows + r["rows"], size + r["size"]
        if rows > most_rows or size > most_bytes:
            break
        least = r["step"]
    return short.filter(step >= least) if least is not None else short.limit(0)


def _frequencies(known: object, doc_type: pa.DataType):
    """Of each text: its id and a digest of both, its bytes, the tokens of its common pre-tokens, and its other pre-tokens with
    how often it holds them."""
    other = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of = known.value.get
        for batch in pieces(batches, 64):
            own, size, sums, rest = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                settled, left = 0, []
                for word, times in Counter(raw.split()).items():
                    n = n_of(word)
                    if n is None:
                        left.append({"word": word, "times": times})
                    else:
                        settled += n * times
                # a blank first: no pre-token is like it
                own.append(b" " + hashlib.blake2b(f"{doc!r}:".encode() + raw, digest_size=16).digest())
                size.append(len(raw))
                sums.append(settled)
                rest.append([{"word": own[-1], "times": 0}, *left])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(doc_type), pa.array(own, pa.binary()), pa.array(size, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, other)], names=["doc", "own", "size", "settled", "rest"])

    return run


def token_counts(docs: DataFrame, tokenizer: bytes, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", most_rows: int = COMMON_ROWS, most_bytes: int = COMMON_BYTES) -> DataFrame:
    """Of every row: doc_id, n_bytes (of the text in UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    words = vocabulary(docs, tokenizer, text_col)
    known = spark.sparkContext.broadcast({bytes(w): n for w, n in common(words, most_rows, most_bytes).select("word", "n").toArrow().to_pandas().itertuples(index=False)})
    field = docs.schema[id_col].dataType
    texts = bounded(docs).select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    found = texts.mapInArrow(_frequencies(known, to_arrow_type(field)), f"doc {field.simpleString()}, own binary, size long, settled long, rest array<struct<word:binary,times:long>>")
    # a row for each text itself, whose word is like no pre-token, and one for each pre-token that is not common
    each = found.select("doc", "own", F.posexplode("rest").alias("k", "x"), "size", "settled").select(
        "own", F.when(F.col("k") == 0, F.struct("doc", "size")).alias("text"), F.when(F.col("k") == 0, F.col("settled")).otherwise(0).alias("settled"), F.col("x.word").alias("word"), F.col("x.times").alias("times")
    )
    counted = each.join(words.select("word", "n"), "word", "left").select("own", "text", (F.col("settled") + F.when(F.col("times") == 0, 0).otherwise(F.coalesce("n", F.raise_error(F.lit("a text changed while it was counted")).cast("long")) * F.col("times"))).alias("n"))
    # equal rows have one digest: they come out as often as they went in
    sums = counted.groupBy("own").agg(F.first("text", ignorenulls=True).alias("text"), F.count("text").alias("rows"), F.sum("n").alias("n"))
    out = sums.select("text", F.expr("n div rows").alias("n_tokens"), F.explode(F.expr("sequence(1, rows)")).alias("_"))
    return out.select(F.col("text.doc").alias("doc_id"), F.col("text.size").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
