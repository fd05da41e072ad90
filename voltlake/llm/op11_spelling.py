"""Spelling variants: words one edit apart, found through pivotal bigrams.

Bigrams are ranked by how rarely they occur in the vocabulary. The gram prefix of a
word is its three rarest bigrams (with every further place of the third one); one edit
spoils at most two overlapping bigrams. Its pivots are the two disjoint bigrams of that
prefix of the least total frequency, chosen by dynamic programming: one edit spoils at
most one of them. So, of two words one edit apart, take the one whose prefix ends
earlier in the rank order: a pivot of it is left in the other word, and as it ranks no
later than that word's prefix ends, it stands in that prefix. The edit lies before or
after that bigram, so either the text after it or the text before it is the same in both words:
its place is fixed from one end. That text and the length (the same, one less or one more) are part of
the join key; where that text is short, so is one half of the text on the other side, as the edit spares
the half it doesn't lie in. Levenshtein distance verifies each pair inside the join.

Plan: words are counted where they are read (partial sums before the shuffle). All
later steps work on the vocabulary. Bigrams have a fixed alphabet (at most 90 x 90
rows), so their counts may be broadcast. A frequent bigram's words share a key only with
equal text on one side and equal length; what is still hot, adaptive execution splits. Forms have at least twice the
count of their word, so chains are shorter than 64 and pointers double in a few joins.

Edge cases: null text has no words; a null id counts as an empty string in the hash;
repeated rows count each time; ties of count go to the smaller word; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import drop_materialised, materialise, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters beside a bigram that make a key by themselves.
ENOUGH = 4
LETTERS = "A-Za-z\u00C0-\u00FF"


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int = 97) -> DataFrame:
    """word, n: runs of letters, with one letter left out where the hash of id and run is divisible by ``every``."""
    lowered = F.translate(text_of(), UPPER, LOWER)
    long_runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{min_length},}}+"), F.lit(0))  # a shorter run can't give a word
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(long_runs).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.left("run", cut), F.substr("run", cut + 2))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def pivots(prefix: Column) -> Column:
    """Two disjoint bigrams of least total count among structs pos, times, gram in order of pos.

    A fold, one step a bigram: ``done`` is the cheapest bigram before the last one
    seen (``prev``), and ``pair`` the cheapest disjoint pair so far. ``prev`` may pair
    with the next bigram only if they don't overlap; after that step it counts as done.
    """
    gram = "struct<times:bigint,gram:string,pos:int>"
    start = F.struct(F.lit(None).cast(gram).alias("done"), F.lit(None).cast(gram).alias("prev"), F.lit(None).cast(f"struct<total:bigint,a:{gram},b:{gram}>").alias("pair"))

    def step(s: Column, x: Column) -> Column:
        one = F.struct(x["times"].alias("times"), x["gram"].alias("gram"), x["pos"].alias("pos"))
        before = F.when(s["prev"]["pos"] <= x["pos"] - 2, F.least(s["done"], s["prev"])).otherwise(s["done"])
        pair = F.when(before.isNotNull(), F.struct((before["times"] + x["times"]).alias("total"), before.alias("a"), one.alias("b")))
        return F.struct(F.least(s["done"], s["prev"]).alias("done"), one.alias("prev"), F.least(s["pair"], pair).alias("pair"))

    return F.aggregate(prefix, start, step, lambda s: F.array(s["pair"]["a"], s["pair"]["b"]))


def with_prefixes(words: DataFrame) -> DataFrame:
    """word, n, len, last (times and gram at which the gram prefix ends), prefix and pivots (structs times, gram, pos), for words of four letters and more."""
    cut = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))
    grams = words.where(F.length("word") >= 4).select("word", "n", F.posexplode(cut).alias("pos", "gram"))
    times = grams.groupBy("gram").agg(F.count("*").alias("times"))
    ranked = grams.join(F.broadcast(times), "gram")  # at most 90 x 90 rows, by the alphabet of words
    items = ranked.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("times", "gram", "pos"))).alias("items"))  # a word's own bigrams
    ends = items.select("word", "n", F.length("word").alias("len"), "items", F.struct(F.get("items", F.lit(2))["times"].alias("times"), F.get("items", F.lit(2))["gram"].alias("gram")).alias("last"))
    prefixed = ends.withColumn("prefix", F.filter("items", lambda x: F.struct(x["times"].alias("times"), x["gram"].alias("gram")) <= F.col("last")))
    by_place = F.array_sort(F.transform("prefix", lambda x: F.struct(x["pos"].alias("pos"), x["times"].alias("times"), x["gram"].alias("gram"))))
    return prefixed.select("word", "n", "len", "last", "prefix", pivots(by_place).alias("pivots"))


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of words (word, n) that one inserted, deleted or replaced letter makes equal."""
    grams = materialise(with_prefixes(words))

    def places(gram: Column, longer: int) -> Column:
        """Keys of a bigram's place in the word and in words ``longer`` by so many letters: what may be equal around it."""
        before, after = F.left("word", gram["pos"]), F.substr("word", gram["pos"] + 3)
        found = []
        for side, same, edited in (("before", before, after), ("after", after, before)):
            size = F.length(edited) + longer
            half = F.floor(size / 2).cast("int")
            key = lambda part, text: F.xxhash64(F.lit(f"{side} {part}"), gram["gram"], same, text)  # noqa: E731, B023
            halves = F.array(key("head", F.left(edited, half)), key("tail", F.right(edited, size - half)))
            found.append(F.when(size < 0, F.array().cast("array<bigint>")).when(F.length(same) >= ENOUGH, F.array(key("whole", F.lit("")))).otherwise(halves))
        return F.concat(*found)

    held = grams.select("word", "n", "last", "len", F.explode("prefix").alias("x")).select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"), "len", F.explode(places(F.col("x"), 0)).alias("k"))
    wanted = F.array(*(F.struct((F.col("len") + longer).alias("len"), places(F.col("x"), longer).alias("ks")) for longer in (-1, 0, 1)))
    sought = (
        grams.select("word", "n", "last", "len", F.explode("pivots").alias("x"))
        .select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"), F.explode(wanted).alias("w"))
        .select("a", "a_n", "a_last", "w.len", F.explode("w.ks").alias("k"))
    )
    met = (F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    keys = [F.col(f"s.{k}") == F.col(f"h.{k}") for k in ("k", "len")]
    pairs = sought.alias("s").join(held.alias("h"), [*keys, met]).select("a", "a_n", "b", "b_n")
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*").distinct()  # a pair may meet at both pivots


def roots_of(forms: DataFrame, max_rounds: int = 8) -> DataFrame:
    """word, root for the rows of ``forms`` (word, form): pointers double until none moves. A chain of under 2**max_rounds words ends; counts double along a chain."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialise(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_materialised(now.sparkSession, now)
        now = new.select("word", "root")
        if not new.where("moved").head(1):
            return now
    raise RuntimeError("chains of forms are longer than counts of 64 bits allow")


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int = 97, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text).

    ``form`` is the near word of largest count, where that is at least ``ratio`` times
    the word's own; ``root`` the end of the chain of forms.
    """
    if min_length < 4 or ratio < 2:
        raise ValueError("words need 4 letters for three bigrams, and forms twice the count for chains that end")
    words = materialise(word_counts(docs, min_length, min_count, every))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less")).withColumn("fits", F.col("form_n") >= F.col("n") * ratio)
    formed = materialise(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("best.near")).alias("form"), F.when(F.col("fits"), F.col("form_n")).alias("form_n")))
    return formed.join(roots_of(formed.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
