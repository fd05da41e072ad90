"""Line dedup by content-defined chunks, DataFrame functions only.

A rolling hash over the last ``window`` line hashes ends a chunk where it is 0
modulo ``divisor``; the boundary depends on those lines alone, so it moves with
them when lines are inserted above. A chunk of at least two lines that occurs in
more than one place stays where it comes first, by (doc_id, content hash, chunk
number), and goes everywhere else.

Those boundaries need luck: a short passage inside otherwise different documents
goes only if one falls before it and one at its end. With ``passages``, all pairs of
neighbouring lines that are not blank are judged beside the chunks, so every repeated
passage of two lines and more goes, wherever it stands; a line goes with any chunk or pair
that has come before, and its first place always stays.

Plan: chunk hashes without text are counted (partial aggregates before the
shuffle); the texts of chunks whose hash repeats are then grouped by hash and
bytes, so equal hashes alone remove nothing. Documents are shuffled once, by row
key; both joins reuse that exchange.

Edge cases: null text counts as one empty line and stays null; a document of
fewer lines than the window is one chunk; single-line chunks always stay; rows
equal in id and text are one occurrence and get equal results; a document all of
whose chunks go keeps its row with empty text; extra columns pass through
``dedupe_lines`` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import join_key, row_keys, text_of

BASE, PRIME = 1_009, 2_147_483_647


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunk_ends(lines: Column, window: int, divisor: int) -> Column:
    """1-based number of each chunk's last line."""

    def rolled(h: Column, i: Column) -> Column:
        value = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            value = (value * BASE + F.get(h, i - 1 - back)) % PRIME
        return value

    def ends(h: Column) -> Column:
        n = F.size(h)
        return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ((i >= window) & (rolled(h, i) % divisor == 0)))

    return let(F.transform(lines, line_hash), ends)


def with_chunks(text: Column, window: int, divisor: int, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the lines and of the chunks, as structs no (from 0), first (1-based), n."""

    def chunks(lines: Column) -> Column:
        def structs(ends: Column) -> Column:
            def one(end: Column, k: Column) -> Column:
                first = F.when(k == 0, F.lit(1)).otherwise(F.get(ends, k - 1) + 1)
                return F.struct(k.alias("no"), first.alias("first"), (end - first + 1).alias("n"))

            return F.transform(ends, one)

        return let(let(chunk_ends(lines, window, divisor), structs), lambda c: body(lines, c))

    return let(F.split(text, "\n", -1), chunks)


def with_passages(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the lines and of all pairs of neighbouring lines that are not blank, as structs like those of ``with_chunks``; blank lines between belong to a pair."""

    def pairs(lines: Column) -> Column:
        solid = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.trim(F.get(lines, i - 1)) != "")

        def structs(at: Column) -> Column:
            return F.transform(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda i, k: F.struct(k.alias("no"), i.alias("first"), (F.get(at, k + 1) - i + 1).alias("n")))

        return let(let(solid, structs), lambda c: body(lines, c))

    return let(F.split(text, "\n", -1), pairs)


def with_chunks_and_passages(text: Column, window: int, divisor: int, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the lines and of the chunks of ``with_chunks`` that hold more than two lines that are not blank (smaller ones are pairs), then the pairs of ``with_passages``, numbered on."""
    fields = lambda c: F.struct(c["first"].cast("int").alias("first"), c["n"].cast("int").alias("n"))
    solid = lambda lines, c: F.size(F.filter(F.slice(lines, c["first"], c["n"]), lambda line: F.trim(line) != ""))

    def with_units(lines: Column, chunks: Column) -> Column:
        large = F.transform(F.filter(chunks, lambda c: solid(lines, c) > 2), fields)
        units = F.concat(large, with_passages(text, lambda _, pairs: F.transform(pairs, fields)))
        return let(F.transform(units, lambda c, k: F.struct(k.alias("no"), c["first"].alias("first"), c["n"].alias("n"))), lambda u: body(lines, u))

    return with_chunks(text, window, divisor, with_units)


def removed_chunks(keyed: DataFrame, cut: Callable[[Column, Callable[[Column, Column], Column]], Column]) -> DataFrame:
    """k1, k2, removed (chunk numbers) for the rows of ``keyed`` (k1, k2, text) that lose chunks, as ``cut`` makes them."""
    hashed = keyed.select(
        "k1",
        "k2",
        F.explode(
            cut(F.col("text"), lambda lines, chunks: F.transform(F.filter(chunks, lambda c: c["n"] >= 2), lambda c: F.struct(c["no"].alias("no"), F.xxhash64(F.slice(lines, c["first"], c["n"])).alias("h"))))
        ).alias("chunk"),
    ).select("k1", "k2", "chunk.no", "chunk.h")
    repeated = hashed.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    suspects = hashed.withColumn("j", join_key("h")).join(repeated.select(join_key("h").alias("j")), "j", "left_semi").groupBy("k1", "k2").agg(F.collect_set("no").alias("nos"))
    texts = (
        keyed.join(suspects, ["k1", "k2"])
        .select(
            "k1",
            "k2",
            F.explode(
                cut(
                    F.col("text"),
                    lambda lines, chunks: F.transform(F.col("nos"), lambda no: let(F.get(chunks, no), lambda c: F.struct(no.alias("no"), c["n"].alias("n"), F.concat_ws("\n", F.slice(lines, c["first"], c["n"])).alias("bytes")))),
                )
            ).alias("chunk"),
        )
        .select("k1", "k2", "chunk.no", "chunk.n", "chunk.bytes")
        .withColumn("h", F.xxhash64("bytes"))
    )
    place = F.struct("k1", "k2", "no")
    firsts = texts.groupBy("h", "bytes").agg(F.min(place).alias("kept"), F.max(place).alias("last")).where("kept != last").select(join_key("h").alias("j"), "bytes", "kept")
    return texts.withColumn("j", join_key("h")).join(firsts, ["j", "bytes"]).where(place != F.col("kept")).groupBy("k1", "k2").agg(F.collect_set("no").alias("removed"))


def dedupe_lines(docs: DataFrame, window: int = 3, divisor: int = 4, prefix: str = "", passages: bool = False) -> DataFrame:
    """``docs`` with ``text`` less its repeated chunks, and n_lines, n_removed_lines, n_removed_chunks, each with the prefix.

    Input columns with the name of one of these are replaced. With ``passages``, all
    repeated passages of two lines and more go too, and pairs of lines count beside chunks.
    """

    def cut(text: Column, body: Callable[[Column, Column], Column]) -> Column:
        return with_chunks_and_passages(text, window, divisor, body) if passages else with_chunks(text, window, divisor, body)

    added = [f"{prefix}{c}" for c in ("n_lines", "n_removed_lines", "n_removed_chunks")]
    docs = docs.drop(*added)
    first, second = row_keys()
    keyed = docs.withColumn("__k1", first).withColumn("__k2", second)
    lost = removed_chunks(keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), text_of().alias("text")), cut)

    def rest(lines: Column, chunks: Column) -> Column:
        gone = F.flatten(F.transform(F.col("__removed"), lambda no: let(F.get(chunks, no), lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1))))
        kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), gone)
        return let(kept, lambda at: F.struct(F.concat_ws("\n", F.transform(at, lambda i: F.get(lines, i - 1))).alias("text"), F.size(at).alias("n")))

    lost = lost.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("removed").alias("__removed"))
    joined = keyed.join(lost, ["__k1", "__k2"], "left").withColumn("__kept", F.when(F.col("__removed").isNotNull(), cut(text_of(), rest)))
    n_lines = F.size(F.split(text_of(), "\n", -1)).cast("long")
    gone = F.col("__removed").isNotNull()
    out = joined.select(
        *(F.when(gone, F.col("__kept.text")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns),
        n_lines.alias(added[0]),
        F.when(gone, n_lines - F.col("__kept.n")).otherwise(F.lit(0)).cast("long").alias(added[1]),
        F.when(gone, F.size("__removed")).otherwise(0).cast("long").alias(added[2]),
    )
    return out
