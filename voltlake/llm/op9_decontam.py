"""Benchmark decontamination by template canonicalisation.

Tokens become template tokens: numbers, with their currency signs, percent signs
and units, are <num>, capitalised words that are no function words <name>, other
words their lower case without punctuation. Neighbouring numbers and neighbouring
names without punctuation between are one token, so 'Rome' and 'New York' are one
each. Windows of ``window`` template tokens of the benchmark items are hash-joined
with those of the documents. Windows found at the same distance of item and
document form segments, and segments chain over shifts of up to ``window`` tokens,
so inserted and dropped words break no alignment. An alignment counts if it covers
at least ``coverage`` of the item's tokens and its slots are consistent where it
covers them: a one-to-one renaming of the item's names and units to the document's,
and equal item numbers stand for equal document numbers. A changed word at the
start of a sentence may be no name: unless the item repeats it, it isn't counted as
covered, and items shorter than the window may hold none. So a question whose
numbers and names were exchanged throughout is caught, an unrelated text of the
same shape with clashing slots isn't.

Plan, the same for any benchmark: windows of both sides are hash-joined, and the
planner picks the join's form by the benchmark's size. Before the join, documents'
windows pass a Bloom filter of ``filter_bits`` (fixed size, so what is broadcast has
a bound; a fuller one lets more windows through to the join, which decides). Windows
carry the words of their slots, so no text is shuffled for the alignment, and those
of equal texts, known by 128 bits of hash, are collapsed before it. Only hits of one
document on one item come together.

Edge cases: null and empty texts match nothing; items of fewer than ``window``
tokens are one window of all their tokens; empty items match nothing; items without
an id are reported with a null one; items with equal templates are all tried, and of
items that share an id the best counts; repeated rows give repeated results; extra
columns of either table are ignored; an empty benchmark flags nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import materialise, text_of
from voltlake.llm.op7_jaccard import _mix

#: Words that are units when a number stands before them.
UNITS = ("km", "m", "cm", "mm", "kg", "g", "mg", "l", "ml", "s", "ms", "h", "min", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "year", "miles", "mile", "feet", "foot", "inches", "pounds", "dollars", "dollar", "euros", "euro", "cents", "percent", "%", "$", "€", "°c", "°f", "mph", "kmh", "w", "kw", "v", "a", "hz", "j", "n")
NUMBER = re.compile(r"^[+-]?([$€£]?)[+-]?((?:\d[\d,.]*|\.\d+)(?:[/:–-]\d[\d,.]*)*)(%s)?$" % "|".join(re.escape(u) for u in sorted(UNITS, key=len, reverse=True)), re.IGNORECASE)
SIGNS = {"$": "dollar", "€": "euro", "£": "pound", "%": "percent"}
#: Capitalised words that begin sentences without being names.
FUNCTION = frozenset(
    "a an the if when what which who whose whom where why how is are was were do does did can could will would should may might must has have had in on at of for from to by with after before during while since as and or but so then there this that these those it its he she they we you i his her their our your my not no yes each every all some any both one two "
    "der die das den dem des ein eine einen wenn wann was welche welcher welches wer wo warum wie ist sind war im in am an auf von für aus zu mit nach vor und oder aber dann es er sie wir ihr ich nicht "
    "le la les l un une des si quand que quel quelle qui où pourquoi comment est sont dans en sur de du pour par avec après avant et ou mais il elle ils elles nous vous je ne "
    "el los las una unos si cuando qué cuál quién dónde por cómo es son en del para con después antes y o pero él ella ellos nosotros yo no".split()
)
BREAKS = ".,;:!?)]}»”"
STRIP = ".,;:!?\"'()[]{}<>«»“”„’"
MEMO_WORDS = 200_000


def _kind(word: str) -> str:
    if not word[0].isalpha() and NUMBER.match(word):
        return "<num>"
    low = word.lower()
    return "<name>" if word[0].isupper() and low not in FUNCTION else low


def template(text: str) -> tuple[list[str], list[tuple[str, bool]]]:
    """Template tokens, and for each the words it stands for and whether it begins a sentence."""
    kinds, values = [], []
    fresh, gap, last = True, True, ""
    for raw in text.split():
        word = raw.strip(STRIP)
        if word:
            kind = _kind(word)
            if not gap and (kind == last and kind in ("<num>", "<name>") or last == "<num>" and word.lower() in UNITS):
                values[-1] = (f"{values[-1][0]} {word}", values[-1][1])
            else:
                kinds.append(kind)
                values.append((word, fresh))
            last, gap = kind, False
        gap = gap or raw[-1] in BREAKS
        fresh = raw[-1] in ".!?:" or (fresh and not word)
    return kinds, values


class Canon:
    """Window hashes of texts. Words look the same wherever they stand and are hashed through a bounded memo."""

    def __init__(self, window: int):
        import xxhash

        self.window, self.hash = window, xxhash.xxh64_intdigest
        self.memo: dict[str, int] = {}
        self.word, self.flags = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)
        self.slots = {k: self.hash(k) for k in ("<num>", "<name>")}

    def _entry(self, raw: str) -> tuple[int, int]:
        """Hash (0: no token), and flags: 1 number, 2 name, 4 unit word, 8 followed by a break."""
        word, gap = raw.strip(STRIP), 8 * (raw[-1] in BREAKS)
        if not word:
            return 0, gap
        kind = _kind(word)
        return self.slots.get(kind) or self.hash(kind), (kind == "<num>") + 2 * (kind == "<name>") + 4 * (word.lower() in UNITS) + gap

    def _learn(self, words: set[str]) -> None:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        for w in words:
            if w not in self.memo:
                k = len(self.memo)
                if k == len(self.word):
                    self.word, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.word, self.flags))
                self.memo[w] = k
                self.word[k], self.flags[k] = self._entry(w)

    def hashes(self, text: str) -> np.ndarray:
        raw = text.split()
        if not raw:
            return np.zeros(0, np.uint64)
        try:
            at = np.fromiter(map(self.memo.__getitem__, raw), np.int64, len(raw))
        except KeyError:
            self._learn(set(raw))
            at = np.fromiter(map(self.memo.__getitem__, raw), np.int64, len(raw))
        h, flags = self.word[at], self.flags[at]
        token = h != 0
        if not token.all():  # breaks of words without a token count for the token before
            k = np.flatnonzero(token)
            breaks = np.r_[0, np.cumsum(flags >> 3)]
            after = np.r_[k[1:], len(raw)][: len(k)]
            h, flags = h[k], (flags[k] & 7) | ((breaks[after] > breaks[k]).astype(np.uint8) << 3)
        # a number or name goes on in the next word of its kind, a number in its unit, if no break stands between
        a, b = flags[:-1], flags[1:]
        apart = ((a & (b | b >> 2 & 1) & 3) == 0) | (a > 7)
        return h if apart.all() else np.r_[h[:1], h[1:][apart]]

    def windows(self, h: np.ndarray) -> np.ndarray:
        w = min(self.window, len(h))
        if not w:
            return np.zeros(0, np.uint64)
        out = np.full(len(h) - w + 1, w, np.uint64)
        for k in range(w):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - w + 1 + k]
        return _mix(out)


def _number(value: str) -> tuple[str, str]:
    """A number token's number and unit, in one spelling."""
    number, unit = "", ""
    for word in value.split():
        found = NUMBER.match(word)
        number += " " * bool(number) + found[2] if found else ""
        unit = (found[1] or found[3] or unit if found else word).lower()
    unit = SIGNS.get(unit, unit)
    return number.strip(".,"), unit[:-1] if len(unit) > 3 and unit.endswith("s") else unit


def _names(mine: str, other: str) -> list[tuple[str, str]]:
    """Which words of two names stand for each other: one by one, or as a whole if their numbers differ."""
    a, b = mine.lower().split(), other.lower().split()
    if len(a) == len(b):
        return list(zip(a, b, strict=True))
    while len(a) > 1 and len(b) > 1 and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while len(a) > 1 and len(b) > 1 and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return [(" ".join(a), " ".join(b))]


def consistent(item: tuple[list[str], list[tuple[str, bool]]], words: dict[int, str], pairs: dict[int, int]) -> int | None:
    """Of aligned positions (item's: document's): None if slots don't map one to one (numbers: as a function), else how many are words at sentence starts that changed and that the item doesn't repeat."""
    there: dict[tuple[str, str], str] = {}
    back: dict[tuple[str, str], str] = {}

    def fits(kind: str, mine: str, other: str) -> bool:
        return there.setdefault((kind, mine), other) == other and (kind == "<num>" or back.setdefault((kind, other), mine) == mine)

    doubtful = []
    for k, at in pairs.items():
        kind, (value, first) = item[0][k], item[1][k]
        if kind == "<num>":
            (mine, unit), (other, its) = _number(value), _number(words[at])
            if not fits(kind, mine, other) or (unit and its and not fits("<unit>", unit, its)):
                return None
        elif kind == "<name>":
            same = _names(value, words[at])
            if not all(fits(kind, *x) for x in same):
                return None
            if first and same[0][0] != same[0][1]:
                doubtful.append(same[0][0].split()[0])
    if not doubtful:
        return 0
    uses = [w for kind, (value, _) in zip(*item, strict=True) if kind == "<name>" for w in value.lower().split()]
    return sum(uses.count(w) < 2 for w in doubtful)


def alignments(hits: list[tuple[int, int]], w: int, length: int) -> list[dict[int, int]]:
    """Item's positions to the document's, by alignment, of the windows (document's, item's place) found: all of one distance, and chains over shifts."""
    runs: dict[int, list[int]] = defaultdict(list)
    for p, q in hits:
        runs[p - q].append(q)
    out, segments = [], []
    for at, qs in runs.items():
        qs = sorted(set(qs))
        out.append({x: x + at for q in qs for x in range(q, q + w)})
        start = qs[0]
        for a, b in zip(qs, [*qs[1:], None], strict=True):
            if b is None or b > a + w:
                segments.append((start + at, start, a + w - start))
                start = b
    segments.sort()
    best: list[tuple[int, int]] = []  # tokens covered by the best chain to a segment, and its segment before
    for j, (p, q, n) in enumerate(segments):
        top = (n, -1)
        for i in range(j - 1, -1, -1):
            pi, qi, ni = segments[i]
            if p - pi > length + w:
                break
            shift = (p - q) - (pi - qi)
            lost = max(0, qi + ni - q, pi + ni - p)  # a token stands for one token only
            if shift and abs(shift) <= w and qi < q and pi < p and lost < n and best[i][0] + n - lost > top[0]:
                top = (best[i][0] + n - lost, i)
        best.append(top)
    for j, (_, i) in enumerate(best):
        if i >= 0:
            chain = [j]
            while best[chain[-1]][1] >= 0:
                chain.append(best[chain[-1]][1])
            pairs: dict[int, int] = {}
            nq = np_ = -1
            for p, q, n in (segments[k] for k in reversed(chain)):
                skip = max(0, nq - q, np_ - p)
                pairs.update((q + x, p + x) for x in range(skip, n))
                nq, np_ = q + n, p + n
            out.append(pairs)
    return out


def aligned_share(item: tuple[list[str], list[tuple[str, bool]]], words: dict[int, str], hits: list[tuple[int, int]], window: int, coverage: float) -> float | None:
    """Covered share of the item by the best alignment of the windows (document's, item's place) found that its slots support. words: the document's, by place, where windows were found."""
    length, best = len(item[0]), None
    for pairs in sorted(alignments(hits, min(window, length), length), key=len, reverse=True):
        if len(pairs) < coverage * length or (best is not None and len(pairs) / length <= best):
            break
        doubtful = consistent(item, words, pairs)
        if doubtful is None or (doubtful and length < window):
            continue
        share = (len(pairs) - doubtful) / length
        if share >= coverage and (best is None or share > best):
            best = share
    return best


MATCHES = "array<struct<item_id: long, coverage: double>>"


def _bits(h: np.ndarray, filter_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each window hash in the filter of 2^filter_bits bits."""
    mask = np.uint64((1 << filter_bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _item_windows(window: int, filter_bits: int):
    """Rows of items (item, text): a row a window with hash, place and item length, and a row a 64-bit word of the filter it sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(window)
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
                tokens = canon.hashes(text.as_py())
                h = canon.windows(tokens)
                if not len(h):
                    continue
                at = np.unique(np.concatenate(_bits(h, filter_bits)))
                words, first = np.unique(at >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first).view(np.int64)
                n, m = len(h), len(words)
                pad = lambda x, before, after: pa.array([None] * before + x.tolist() + [None] * after, pa.int64())
                cols = [pa.array(np.full(n + m, item, np.int64)), pa.array(np.full(n + m, len(tokens), np.int64)), pad(h.view(np.int64), 0, m), pad(np.arange(n), 0, m), pad(words, n, 0), pad(bits, n, 0)]
                yield pa.RecordBatch.from_arrays(cols, names=["item", "length", "h", "q", "word", "bits"])

    return run


HITS = pa.schema([("k", pa.string()), ("h", pa.int64()), ("p", pa.int64()), ("words", pa.list_(pa.string()))])


def _document_windows(window: int, short: tuple[int, ...], filter_bits: int, words: dict[int, int]):
    """Windows of documents (k, text) that pass the filter, with the words that stand in their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << (filter_bits - 6), np.uint64)
        if words:
            bitmap[np.fromiter(words, np.int64, len(words))] = np.fromiter(words.values(), np.int64, len(words)).view(np.uint64)
        passes = np.unpackbits(bitmap.view(np.uint8), bitorder="little").view(bool)
        canon = Canon(window)
        widths = [canon, *(Canon(k) for k in short)]
        rows: list[tuple] = []

        def table() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(HITS)], schema=HITS)
            rows.clear()
            return got

        for batch in batches:
            for key, text in zip(batch.column("k"), batch.column("text"), strict=True):
                text = text.as_py()
                tokens = canon.hashes(text)
                slots = None
                for c in widths:
                    if len(tokens) < c.window and c is not canon:
                        continue
                    h = c.windows(tokens)
                    near, far = _bits(h, filter_bits)
                    hit = np.flatnonzero(passes[near])
                    for p in hit[passes[far[hit]]].tolist():
                        if slots is None:
                            slots = [word if kind[0] == "<" else "" for kind, (word, _) in zip(*template(text), strict=True)]
                        rows.append((key.as_py(), int(h[p].view(np.int64)), p, slots[p : p + c.window]))
                if len(rows) > 20_000:
                    yield table()
        yield table()

    return run


def _align(window: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in batch.to_pylist():
                words = {x["p"] + i: w for x in row["at"] for i, w in enumerate(x["words"])}
                share = aligned_share(template(row["question"]), words, [(x["p"], x["q"]) for x in row["at"]], window, coverage)
                if share is not None:
                    for column, value in zip(out, (row["k"], row["item_id"], share), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.float64()), strict=True)], names=["k", "item_id", "coverage"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.6, filter_bits: int = 24, keep: tuple[str, ...] = ("doc_id",), name: str = "items") -> DataFrame:
    """``keep`` columns (but for one of the list's name) and items (item_id and covered share of each benchmark item found) for every row of ``docs``."""
    if not 6 <= filter_bits <= 30:
        raise ValueError("filter_bits must lie between 6 and 30")
    keep = tuple(c for c in keep if c != name)
    kept = docs.select(*keep, text_of().alias("__text")).withColumn("__k", F.md5("__text"))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where("text != ''").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    windows = materialise(asked.select("item", "text").mapInArrow(_item_windows(window, filter_bits), "item long, length long, h long, q long, word long, bits long"))
    words = {r.word: r.bits for r in windows.where("word IS NOT NULL").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()}
    short = tuple(sorted(r.length for r in windows.where(F.col("length") < window).select("length").distinct().collect()))
    theirs = windows.where("h IS NOT NULL").select("item", "length", "h", "q")

    mine = kept.select(F.col("__k").alias("k"), F.col("__text").alias("text")).mapInArrow(_document_windows(window, short, filter_bits, words), "k string, h long, p long, words array<string>")
    pairs = mine.join(theirs, "h").groupBy("k", "item", "length").agg(F.collect_set(F.struct("p", "q", "words")).alias("at"))
    long_enough = F.size(F.array_distinct(F.transform("at", lambda x: x["q"]))) * F.least(F.col("length"), F.lit(window)) >= coverage * F.col("length")
    held = pairs.where(long_enough).join(asked.select("item", "item_id", F.col("text").alias("question")), "item")
    found = held.select("k", "item_id", "question", "at").mapInArrow(_align(window, coverage), "k string, item_id long, coverage double")
    per_item = found.groupBy("k", "item_id").agg(F.max("coverage").alias("coverage"))
    listed = materialise(per_item.groupBy(F.col("k").alias("__k")).agg(F.sort_array(F.collect_list(F.struct("item_id", "coverage"))).alias("__items")))
    none = F.array().cast("array<struct<item_id:bigint,coverage:double>>")
    return kept.join(listed, "__k", "left").select(*keep, F.coalesce("__items", none).alias(name))
