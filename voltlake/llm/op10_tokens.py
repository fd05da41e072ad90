"""Token counts with overlap resynchronisation for huge documents.

Documents of up to ``huge_chars`` characters are counted where they are read.
Longer ones are cut into chunks of ``chunk_chars`` that overlap by
``overlap_chars``, in one pass of the reading task; the chunks are encoded as
separate rows with offsets by other tasks, and a join on the offset splices
neighbours at a boundary that both encodings have.

Why such a boundary is proven stable: the pre-tokenizer scans left to right, and
what it does after a pre-token boundary depends on the text that follows alone;
no merge crosses the boundary. The left chunk is right up to ``MARGIN``
characters before its cut (look-ahead is one character, and no added token is
longer than the margin), so a boundary that both chunks have in that zone is one
of the whole text, and from there on the right chunk is right as well. If the
overlap has no such boundary (one long word), the document goes to
``count_widening``, which doubles the window until a boundary is found.

Equal huge texts, known by 128 bits of hash, are encoded once. Only offsets and
counts of the overlaps come together by document, never its text.

Edge cases: null text counts as empty (0 tokens); repeated rows give repeated
results; extra columns of the input are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import materialise, text_of

#: Characters before a cut within which a boundary isn't trusted.
MARGIN = 64
#: Fixed value: the public pre-tokenizer pattern of byte-level BPE.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_ENTRIES = 200_000


class TokenCounter:
    """Counts tokens as the tokenizer file gives them.

    For byte-level BPE without a normalizer, each distinct pre-token is encoded
    once by the library and its count kept. The pattern's classes are compared
    with the library's own for every character before it is relied on; texts
    with a character on which they differ, or with an added token's string, go
    to the library whole.
    """

    def __init__(self, path: str):
        import json
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.fast = spec.get("normalizer") is None and spec.get("post_processor") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.known: set[str] = set()
        self.odd: set[str] = set()
        self.memo: dict[str, int] = {}

    def _verify(self, new: set[str]) -> None:
        for c in new:
            for probe in (f"a{c}b", f"1{c}2", f" {c} !{c}!", f"{c}{c} {c}"):
                mine, at = [], 0
                for m in self.pattern.finditer(probe):
                    mine.append(m.span())
                if mine != [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]:
                    self.odd.add(c)
            self.known.add(c)

    def library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.fast:
            return self.library(texts)
        memo, find = self.memo, self.pattern.findall
        out, whole = [0] * len(texts), []
        for i, text in enumerate(texts):
            chars = set(text)
            if new := chars - self.known:
                self._verify(new)
            if (self.odd and chars & self.odd) or any(a in text for a in self.added):
                whole.append(i)
                continue
            words = find(text)
            try:
                out[i] = sum(map(memo.__getitem__, words))
            except KeyError:
                fresh = [w for w in set(words) if w not in memo]
                if len(memo) + len(fresh) > MEMO_ENTRIES:
                    memo.clear()
                    fresh = list(set(words))
                memo.update(zip(fresh, self.library(fresh), strict=True))
                out[i] = sum(map(memo.__getitem__, words))
        if whole:
            for i, n in zip(whole, self.library([texts[i] for i in whole]), strict=True):
                out[i] = n
        return out

    def plain(self, text: str) -> bool:
        """Whether the text can be counted by pre-tokens; that holds for its parts as well."""
        if not self.fast:
            return False
        chars = set(text)
        if new := chars - self.known:
            self._verify(new)
        return not (self.odd and chars & self.odd) and not any(a in text for a in self.added)

    def boundaries(self, text: str, plain: bool = False) -> tuple[list[int], list[int], int]:
        """Offsets at which a pre-token begins, the number of tokens before each, and all tokens. ``plain`` texts go by pre-tokens, others by the library."""
        at, before = [], []
        if plain:
            total = 0
            words, starts = [], []
            for m in self.pattern.finditer(text):
                words.append(m.group())
                starts.append(m.start())
            fresh = [w for w in set(words) if w not in self.memo]
            if len(self.memo) + len(fresh) > MEMO_ENTRIES:
                self.memo.clear()
                fresh = list(set(words))
            self.memo.update(zip(fresh, self.library(fresh), strict=True))
            for w in words:
                before.append(total)
                total += self.memo[w]
            return starts, before, total
        e = self.tokenizer.encode(text, add_special_tokens=False)
        last = object()
        for i, (word, (start, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word is None or word != last:
                at.append(start)
                before.append(i)
            last = word
        return at, before, len(e.ids)


def count_widening(counter: TokenCounter, text: str, chunk: int) -> int:
    """Sequential form: encode a window, keep it up to its last stable boundary, widen where there is none."""
    start, total = 0, 0
    while len(text) - start > chunk:
        size = chunk
        while True:
            window = text[start : start + size]
            if start + size >= len(text):
                return total + counter.library([window])[0]
            at, before, _ = counter.boundaries(window)
            stable = [(a, b) for a, b in zip(at, before, strict=True) if 0 < a <= size - MARGIN]
            if stable:
                break
            size *= 2
        start, total = start + stable[-1][0], total + stable[-1][1]
    return total + (counter.library([text[start:]])[0] if start < len(text) else 0)


def _count_small(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in batches:
            texts = batch.column("text")
            n = [c for k in range(0, len(texts), 256) for c in counter.counts(texts.slice(k, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _key(text: str) -> str:
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(text)


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([_key(t.as_py()) for t in batch.column("text")], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), keys], names=["doc_id", "n_bytes", "key"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([_key(t.as_py()) for t in batch.column("text")], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), batch.column("text"), keys], names=["doc_id", "n_bytes", "text", "key"])


def _cut(path: str, stride: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, done = TokenCounter(path), set()
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                key = _key(text)
                if key in done:
                    continue
                done.add(key)
                plain = counter.plain(text)
                chunks = range(0, max(1, len(text) - overlap), stride)
                for first in range(0, len(chunks), 64):
                    part = chunks[first : first + 64]
                    n = len(part)
                    cols = [pa.array([key] * n), pa.array([plain] * n), pa.array(range(first, first + n), pa.int64()), pa.array([text[a : a + stride + overlap] for a in part]), pa.array([first + k == len(chunks) - 1 for k in range(n)])]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "plain", "chunk", "piece", "ends"])

    return run


OFFSETS = "array<struct<at: int, before: int>>"


def _summarise(path: str, stride: int, overlap: int):
    kind = pa.list_(pa.struct([("at", pa.int32()), ("before", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in batches:
            totals, lefts, rights = [], [], []
            for text, plain in zip(batch.column("piece"), batch.column("plain").to_pylist(), strict=True):
                text = text.as_py()
                at, before, total = counter.boundaries(text, plain)
                totals.append(total)
                lefts.append([{"at": a, "before": b} for a, b in zip(at, before, strict=True) if a < overlap])
                rights.append([{"at": a - stride, "before": b} for a, b in zip(at, before, strict=True) if stride <= a <= len(text) - MARGIN])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "chunk", "ends")), pa.array(totals, pa.int64()), pa.array(lefts, kind), pa.array(rights, kind)], names=["key", "chunk", "ends", "total", "left_at", "right_at"])

    return run


def _widen(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in batches:
            n = [count_widening(counter, text, chunk) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def splice(summaries: DataFrame) -> DataFrame:
    """key, n_tokens of documents from their chunks' summaries; a null count where two neighbours have no common boundary."""
    right = summaries.where("NOT ends").select("key", (F.col("chunk") + 1).alias("chunk"), F.inline("right_at")).withColumnRenamed("before", "mine")
    left = summaries.where("chunk > 0").select("key", "chunk", F.inline("left_at")).withColumnRenamed("before", "its")
    first = right.join(left, ["key", "chunk", "at"]).groupBy("key", "chunk").agg(F.min_by(F.col("mine") - F.col("its"), "at").alias("gain"))
    gained = first.groupBy("key").agg(F.sum("gain").alias("gain"), F.count("*").alias("joints"))
    whole = summaries.groupBy("key").agg(F.max("chunk").alias("wanted"), F.max(F.when(F.col("ends"), F.col("total"))).alias("total"))
    joined = whole.join(gained, "key", "left")
    return joined.select("key", F.when(F.col("wanted") == F.coalesce("joints", F.lit(0)), F.col("total") + F.coalesce("gain", F.lit(0))).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, huge_chars: int = 16_384, chunk_chars: int = 8_192, overlap_chars: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of ``docs`` (doc_id, text).

    What is shuffled are huge documents' chunks, each once, and their summaries; a
    document's chunks are encoded by different tasks.
    """
    if not MARGIN < overlap_chars <= chunk_chars:
        raise ValueError("overlap_chars must lie between the margin and chunk_chars")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = "doc_id long, n_bytes long, n_tokens long"
    small = base.where(F.length("text") <= huge_chars).mapInArrow(_count_small(tokenizer_path), counted)

    huge = base.where(F.length("text") > huge_chars)
    pieces = huge.select("text").mapInArrow(_cut(tokenizer_path, chunk_chars, overlap_chars), "key string, plain boolean, chunk long, piece string, ends boolean")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = pieces.repartition(tasks, "key", "chunk").dropDuplicates(["key", "chunk"])  # a task has sent each text once
    summaries = materialise(once.mapInArrow(_summarise(tokenizer_path, chunk_chars, overlap_chars), f"key string, chunk long, ends boolean, total long, left_at {OFFSETS}, right_at {OFFSETS}"))
    spliced = materialise(splice(summaries))
    named = huge.mapInArrow(_name, "doc_id long, n_bytes long, key string")
    whole = named.join(spliced.where("n_tokens IS NOT NULL"), "key").select("doc_id", "n_bytes", "n_tokens")
    counts = small.unionByName(whole)
    failed = spliced.where("n_tokens IS NULL").select("key")
    if failed.first() is None:
        return counts
    keyed = huge.mapInArrow(_keyed, "doc_id long, n_bytes long, text string, key string")
    return counts.unionByName(keyed.join(failed, "key", "left_semi").mapInArrow(_widen(tokenizer_path, chunk_chars), counted))
