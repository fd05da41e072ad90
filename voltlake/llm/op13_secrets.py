"""Secret scans: probabilistic automata inferred from labelled credentials score every candidate by its format.

Base kinds (assign, access, hex) are found by pattern and reported as they are. What they
find are the labelled credentials, by kind (of an assignment its value); a table of
labelled credentials can add further kinds. For each kind the strings of a bounded
sample form a prefix tree with counts; its states are merged, from the root on, where
the frequencies of ending and of each next character are statistically compatible (Hoeffding's
bound, for the states and all that follows them), into a deterministic automaton with
smoothed probabilities. Two more automata are inferred from runs that are words or numbers.

Every run of at least ``shortest`` characters of keys, outside the base matches, is a candidate. Its
score is the log likelihood under the likeliest kind less that of the better of words and numbers,
plus the log of ``prior``; what is above 0 is a span of kind ``format``. So a credential without
its key word is found by its shape.

Plan: patterns run once over the texts as DataFrame functions, positions are running sums
of piece lengths; what they find is written without the texts, for training and scoring. Only candidates go to Python, as arrays, where a string is scored once a task. The
training strings are the distinct ones of least hash, ``sample`` a kind, of at most
``longest`` characters: partial sorts that bring no more than that to the driver.

Edge cases: null text counts as empty; without labelled credentials there are no format
spans; without words or numbers all characters are equally likely in them; spans of different kinds
may overlap, format spans overlap none; repeated rows give repeated results; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import materialise, text_of
from voltlake.llm.op2_lines import let
from voltlake.llm.op6_pii import joined, located

KINDS = ("assign", "access", "hex", "format")
BASE_KINDS = 3


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEY = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that must reach a length match only then: a later start in a failed run would be shorter still. An assignment is judged after it matched, as its rest may hold another.
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+"}
CANDIDATE = r"(?<![\p{{L}}\p{{N}}+/_-])[A-Za-z0-9+/_-]{{{0},}}+={{0,2}}+(?!\p{{L}})"
#: One of these is in every match.
NEEDS = {"assign": (":", "="), "access": ("AKIA",), "hex": ("",)}
#: Candidates that are no credentials by their characters: words and numbers, in parts or whole.
PLAIN = {"plain words": r"^[A-Za-z+/_-]+=*$", "plain numbers": r"^[0-9+/_-]+=*$"}
ALPHABET = 67
#: Count added to each next character of a state.
SMOOTH = 0.25
FIRST = 0


def _valid(kind: str, match: Column) -> Column:
    return F.length(F.regexp_extract(match, f"^{ASSIGN}", 2)) >= 8 if kind == "assign" else F.lit(True)


class Automaton:
    """A deterministic probabilistic automaton: next state and count by state and character, and how often a string ends there."""

    def __init__(self, strings: list[str], alpha: float = 0.01) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.times: list[dict[str, int]] = [{}]  # of each next character
        self.ends = [0]
        self.log_alpha = math.sqrt(0.5 * math.log(2 / alpha))
        for s in strings:
            self._add(s)
        self._merge_all()
        self._number()

    def _add(self, s: str) -> None:
        at = FIRST
        for c in s:
            self.times[at][c] = self.times[at].get(c, 0) + 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.times.append({})
                self.ends.append(0)
            at = self.next[at][c]
        self.ends[at] += 1

    def _seen(self, q: int) -> int:
        return self.ends[q] + sum(self.times[q].values())

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._seen(a), self._seen(b)
            if not n or not m:
                continue
            bound = self.log_alpha * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            x, y = self.times[a], self.times[b]
            if abs(self.ends[a] / n - self.ends[b] / m) > bound or any(abs(x.get(c, 0) / n - y.get(c, 0) / m) > bound for c in x.keys() | y.keys()):
                return False
            todo += [(self.next[a][c], q) for c, q in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds the tree's counts along the automaton; where that has no way on, the subtree is hung in."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.times[b].items():
                self.times[a][c] = self.times[a].get(c, 0) + n
            for c, q in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], q))
                else:
                    self.next[a][c] = q

    def _merge_all(self) -> None:
        """Settled states in order; each tree below one is merged into the first settled state it is like, or settles."""
        settled, queue = [FIRST], deque([FIRST])
        known = {FIRST}
        while queue:
            q = queue.popleft()
            again = True
            while again:  # a merge may hang new trees below q
                again = False
                for c in sorted(self.next[q]):
                    tree = self.next[q][c]
                    if tree in known:
                        continue
                    again = True
                    same = next((r for r in settled if self._alike(r, tree)), None)
                    if same is None:
                        settled.append(tree)
                        known.add(tree)
                        queue.append(tree)
                    else:
                        self.next[q][c] = same
                        self._fold(same, tree)
                        queue.extend(r for r in settled if r != q and r not in queue and any(x not in known for x in self.next[r].values()))
        self.settled = settled

    def _number(self) -> None:
        """Logarithms by settled state: (next state, log probability) by character, of any other character, of the end."""
        at = {q: k for k, q in enumerate(self.settled)}
        self.steps = []
        for q in self.settled:
            total = self._seen(q) + SMOOTH * (ALPHABET + 1)
            self.steps.append(({c: (at[r], math.log((self.times[q][c] + SMOOTH) / total)) for c, r in self.next[q].items()}, math.log(SMOOTH / total), math.log((self.ends[q] + SMOOTH) / total)))

    def log_likelihood(self, s: str) -> float:
        return log_likelihood(self.steps, s)


def log_likelihood(steps: list[tuple[dict[str, tuple[int, float]], float, float]], s: str) -> float:
    """A character that a state hasn't seen goes back to the first state."""
    total, ways = 0.0, steps[FIRST]
    for c in s:
        to, logp = ways[0].get(c, (FIRST, ways[1]))
        total += logp
        ways = steps[to]
    return total + ways[2]


def with_base(docs: DataFrame, keep: tuple[str, ...], shortest: int) -> DataFrame:
    """``keep``, base (structs start, kind_no, end, kind, match) and candidates (structs start, match) outside them."""
    found = docs.select(*keep, text_of().alias("__t"))
    none = F.array().cast("array<struct<start:bigint,match:string>>")

    def spots(pattern: str, valid: Callable[[Column], Column]) -> Column:
        at = let(F.split("__t", pattern, -1), lambda pieces: F.filter(located(pieces, F.col("__m")), lambda x: valid(x["match"])))
        return F.when(F.size("__m") > 0, F.transform(at, lambda x: F.struct(x["start"].alias("start"), x["match"].alias("match")))).otherwise(none)

    def spans(no: int, kind: str) -> Column:
        return F.transform(f"__{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), (x["start"] + F.length(x["match"])).alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match")))

    for kind in KINDS[:BASE_KINDS]:
        needed = reduce(Column.__or__, (F.contains("__t", F.lit(c)) for c in NEEDS[kind]))
        found = found.withColumn("__m", F.when(needed, F.regexp_extract_all("__t", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))).withColumn(f"__{kind}", spots(PATTERNS[kind], partial(_valid, kind)))
    found = found.withColumn("base", F.array_sort(F.concat(*(spans(no, kind) for no, kind in enumerate(KINDS[:BASE_KINDS])))))
    runs = CANDIDATE.format(shortest)
    found = found.withColumn("__m", F.regexp_extract_all("__t", F.lit(runs), F.lit(0))).withColumn("__c", spots(runs, lambda m: F.lit(True)))
    # bound by let, as the planner would compute a column named inside a lambda anew for each element
    clear = let(F.col("base"), lambda base: F.filter("__c", lambda x: ~F.exists(base, lambda b: (b["start"] < x["start"] + F.length(x["match"])) & (x["start"] < b["end"]))))
    return found.select(*keep, "base", clear.alias("candidates"))


def training_strings(scanned: DataFrame, sample: int, longest: int, labelled: DataFrame | None = None) -> dict[str, list[str]]:
    """At most ``sample`` distinct strings of a kind, those of least hash, and so of the kinds of plain candidates."""
    value = F.when(F.col("b.kind") == "assign", F.regexp_extract("b.match", ASSIGN, 2)).otherwise(F.col("b.match"))
    rows = scanned.select(F.explode("base").alias("b")).select(F.col("b.kind").alias("kind"), value.alias("value"))
    plain = [F.when(F.col("c.match").rlike(shape), kind) for kind, shape in PLAIN.items()]
    rows = rows.unionByName(scanned.select(F.explode("candidates").alias("c")).select(F.coalesce(*plain).alias("kind"), F.col("c.match").alias("value")).where("kind IS NOT NULL"))
    if labelled is not None:
        rows = rows.unionByName(labelled.select(F.col("kind").cast("string"), F.col("value").cast("string")).where("kind IS NOT NULL AND value IS NOT NULL"))
    rows = rows.where(F.length("value").between(1, longest))
    names = [*KINDS[:BASE_KINDS], *PLAIN]
    if labelled is not None:
        names += sorted({r.kind for r in labelled.select("kind").where("kind IS NOT NULL").distinct().collect()} - set(names))  # a list of formats
    least = (rows.where(F.col("kind") == name).groupBy("kind", "value").agg(F.min(F.xxhash64("value")).alias("h")).orderBy("h", "value").limit(sample) for name in names)
    found: dict[str, list[str]] = {}
    for r in reduce(DataFrame.unionByName, least).collect():
        found.setdefault(r.kind, []).append(r.value)
    return found


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), labelled: DataFrame | None = None, shortest: int = 12, sample: int = 1_024, longest: int = 128, prior: float = 1e-6) -> DataFrame:
    """``keep`` and spans: structs start, kind_no, end, kind, score (log odds of the format; of base spans null), like_kind (the likeliest kind).

    ``labelled`` (kind, value) adds labelled credentials to those that the base patterns find.
    """
    scanned = materialise(with_base(docs, keep, shortest))
    strings = training_strings(scanned, sample, longest, labelled)
    others = [Automaton(strings.pop(kind, [])).steps for kind in PLAIN]
    formats = {kind: Automaton(values).steps for kind, values in sorted(strings.items())}
    level = math.log(prior)

    @F.pandas_udf("array<struct<score:double,like_kind:string>>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, dict] = {}

        def one(s: str) -> dict:
            if s not in seen:
                if len(seen) >= 1 << 16:
                    seen.clear()
                kind = max(formats, key=lambda k: log_likelihood(formats[k], s))
                seen[s] = {"score": log_likelihood(formats[kind], s) - max(log_likelihood(steps, s) for steps in others) + level, "like_kind": kind}
            return seen[s]

        for batch in batches:
            yield batch.map(lambda found: [one(s) for s in found])

    struct = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,score:double,like_kind:string>>"
    base = F.transform("base", lambda b: F.struct(b["start"], b["kind_no"], b["end"], b["kind"], F.lit(None).cast("double"), b["kind"])).cast(struct)
    if not formats:
        return scanned.select(*keep, base.alias("spans"))
    scored = scanned.withColumn("__s", scores(F.transform("candidates", lambda c: c["match"])))
    no, kind = BASE_KINDS, KINDS[BASE_KINDS]
    spans = F.zip_with("candidates", "__s", lambda c, s: F.struct(c["start"], F.lit(no), c["start"] + F.length(c["match"]), F.lit(kind), s["score"], s["like_kind"])).cast(struct)
    return scored.select(*keep, F.array_sort(F.concat(base, F.filter(spans, lambda s: s["score"] > 0))).alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a hash of the base spans, all spans as text, and count and top log odds of the others."""
    found = find_secrets(docs.withColumn("doc_id", F.col("doc_id").cast("long")))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind_no"] < BASE_KINDS)
    return found.select("doc_id", *(count(k) for k in KINDS[:BASE_KINDS]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("format"), F.round(F.array_max(F.transform("spans", lambda s: s["score"])), 6).alias("top_score"))
