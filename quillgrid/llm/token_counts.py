"""Token counts through a digest cache.

Each text's SHA-256 is joined, under the tokenizer's own digest, to the counts that the cache holds. Only
distinct texts that miss are encoded; their counts are appended to the cache, and the result is read from it.

Where the tokenizer cuts texts at each single space anyway (byte-level pre-tokens, no normalizer), a Python
worker encodes each distinct piece between such spaces once and sums: the same idea, a level below. It keeps
at most MOST_PIECES pieces of at most PIECE_CHARS characters each, so its memory has a bound for texts without
spaces, too; beyond, it lets the longer ones go, which are the rarer.

Cases: a null text counts as an empty one: 0 bytes, 0 tokens. Equal texts, however many, are encoded once;
repeated rows each get a row. An empty table gives an empty result and appends nothing. Texts of any length
are encoded whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"
#: Characters of text that are encoded in one call of the library.
CHUNK = 1 << 18
MOST_PIECES, PIECE_CHARS, LASTING, AT_ONCE = 200_000, 64, 7, 2048
#: A space is a sure cut where what stands on either side is a letter, digit, or printable ASCII.
CUT = re.compile(r"(?<=[\w!-~])(?= [\w!-~])")
UNSURE = re.compile(r"(?:^|[^\w!-~]) | (?:[^\w!-~]|\Z)")


def read_tokenizer(path: str) -> tuple[str, bytes, str]:
    """(library, the file's bytes, version digest) of a tokenizer file; .json: tokenizers, .model: sentencepiece."""
    with open(path, "rb") as f:
        body = f.read()
    if path.endswith(".json"):
        import tokenizers as library
    elif path.endswith(".model"):
        import sentencepiece as library
    else:
        raise ValueError(f"neither .json nor .model: {path}")
    version = hashlib.sha256(f"{library.__name__} {library.__version__} plain\n".encode() + body).hexdigest()
    return library.__name__, body, version


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizers file's pre-tokens all end before a single space between other characters, and its special tokens hold none."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return plain and not spec.get("normalizer") and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))


#: Counts of pieces, and counters, by tokenizer version, which tasks that follow in one Python worker share.
_PIECES: dict[str, dict[str, int]] = {}
_COUNTERS: dict = {}


def by_pieces(count, version: str):
    """A counter of texts by their distinct pieces, from a counter of texts."""
    known = _PIECES.setdefault(version, {})

    def run(texts: list[str]) -> list[int]:
        pieces = []
        for text in texts:
            if UNSURE.search(text):
                pieces.append(CUT.split(text))
            else:
                first, *rest = text.split(" ")
                pieces.append([first, *map(" ".__add__, rest)])
        new = list(set().union(*pieces).difference(known))
        if len(known) + sum(len(x) <= PIECE_CHARS for x in new) > MOST_PIECES:
            lasting = {p: n for p, n in known.items() if len(p) <= LASTING}
            known.clear()
            if len(lasting) <= MOST_PIECES // 2:
                known.update(lasting)
            new = list(set().union(*pieces).difference(known))
        own: dict[str, int] = {}
        for k in range(0, len(new), AT_ONCE):
            part = new[k : k + AT_ONCE]
            own.update(zip(part, count(part), strict=True))
        known.update((p, n) for p, n in own.items() if len(p) <= PIECE_CHARS)
        return [sum(own[x] if x in own else known[x] for x in p) for p in pieces]

    return run


def make_counter(library: str, body: bytes, version: str):
    """A function from a list of texts to their token counts, without added tokens, truncation or padding; one for each worker and version."""
    if version not in _COUNTERS:
        _COUNTERS.clear()
        _PIECES.clear()
        _COUNTERS[version] = new_counter(library, body, version)
    return _COUNTERS[version]


def new_counter(library: str, body: bytes, version: str):
    if library == "tokenizers":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(body.decode())
        t.no_truncation()
        t.no_padding()
        plain = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        return by_pieces(plain, version) if cuts_at_spaces(json.loads(body)) else plain
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_proto=body)
    return lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]


def encode_misses(misses: DataFrame, library: str, body: bytes, version: str) -> DataFrame:
    """Cache rows for rows of (digest, text)."""
    shared = misses.sparkSession.sparkContext.broadcast(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or make_counter(library, shared.value, version)
            out, part, size = [], [], 0
            for text in batch.column(1):
                part.append(text.as_py())
                size += len(part[-1])
                if size >= CHUNK:
                    out += count(part)
                    part, size = [], 0
            out += count(part) if part else []
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(out)), batch.column(0), pa.array(out, pa.int64())], ["version", "digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Each row's id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    ``cache``: a path that all executors see, where counts of earlier calls lie or will lie; without it, a new
    cache is made for this call.
    """
    spark = docs.sparkSession
    library, body, version = read_tokenizer(tokenizer)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    path = cache or scratch.new_path(spark, "token-cache")
    known = None
    if cache:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
            known = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version)
    misses = rows.select("digest", "text")
    if known is not None:
        misses = misses.join(known.select("digest"), "digest", "left_anti")
    distinct = misses.dropDuplicates(["digest"])
    scratch.write(encode_misses(distinct, library, body, version), path, "append")
    counts = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version).select("digest", "n_tokens")
    if cache:  # two calls at once can both have appended a text
        counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    sized = rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
