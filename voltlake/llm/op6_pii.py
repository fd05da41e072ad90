"""Personal data: proposals by pattern, checksums that confirm, context words that adjust. DataFrame functions only.

Base kinds (email, ip, card, phone) are reported as found; the added kinds
(iban, ssn) need a score of ``threshold``. A score starts from the kind's own,
which a checksum (Luhn for cards, mod 97 for IBANs) has confirmed where there is
one, and context words within 40 characters raise or lower it.

Spans have no position in regexp_extract_all, so the text is also split by the
same pattern and positions are running sums of the pieces' and matches' lengths,
folded in blocks so that many matches in a text stay cheap. Patterns are
possessive and start at run starts only (or where the last match ended), so no
text makes them quadratic. Offsets are code points, the end is exclusive.

Edge cases: null text counts as empty (no spans, the hash of an empty string);
spans of different kinds may overlap; context ends at the neighbouring match of
the same kind; repeated rows give repeated results; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import text_of
from voltlake.llm.op2_lines import let

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = 4
_START = r"(?:\G|(?<![{0}]))[{0}]++"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What the text must hold for the pattern to be tried, and the pattern.
PATTERNS = {
    "email": ("@", _START.format("A-Za-z0-9._%+-") + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", _START.format("0-9") + r"(?:\.[0-9]++){3}+"),
    "card": ("", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"),
    "phone": ("+", r"\+[0-9](?:[ ().-]*+[0-9]){9,14}+(?![ ().-]*+[0-9])"),
    "iban": ("", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
#: Words that speak for or against a kind, in the corpus's languages.
CONTEXT = {
    "email": (r"(?i)\b(?:e-?mail|contact|kontakt|correo|courriel|write|schreib)", r"(?i)\b(?:example|noreply)"),
    "ip": (r"(?i)\b(?:ip|host|server|address|adresse|direcci)", r"(?i)\b(?:version|release|section|chapter)"),
    "card": (r"(?i)\b(?:card|karte|carte|tarjeta|visa|credit|kredit)", r"(?i)\b(?:isbn|order|serial|bestell)"),
    "phone": (r"(?i)\b(?:phone|tel|call|fax|mobile|mobil|portable)", r"(?i)\b(?:isbn|order|serial)"),
    "iban": (r"(?i)\b(?:iban|bank|konto|compte|cuenta|account)", r"(?i)\b(?:serial|model)"),
    "ssn": (r"(?i)\b(?:ssn|social|security|sozial|seguridad|s.curit)", r"(?i)\b(?:phone|part|model)"),
}
NEAR, BLOCK = 40, 512


def luhn(match: Column) -> Column:
    digits = F.filter(F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), ""), lambda c: c != "")

    def worth(c: Column, i: Column) -> Column:
        twice = c.cast("int") * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(match: Column) -> Column:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, the number is 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.filter(F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(moved, F.lit(0), step) == 1)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": luhn,
    "phone": lambda m: F.lit(True),
    "iban": mod97,
    "ssn": lambda m: ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"),
}


def located(pieces: Column, matches: Column) -> Column:
    """Structs start, match, before, after: the matches with their 0-based offsets and their surroundings."""
    item = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    none = F.array().cast("array<bigint>")

    def block(items: Column, at: Column) -> Column:
        return F.aggregate(
            F.slice(items, at, F.lit(BLOCK)),
            F.struct(F.lit(0).cast("bigint").alias("n"), none.alias("starts")),
            lambda a, x: F.struct((a["n"] + F.length(x["p"]) + F.length(x["m"])).alias("n"), F.concat(a["starts"], F.array(a["n"] + F.length(x["p"]))).alias("starts")),
        )

    def starts(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(items), F.lit(BLOCK)), lambda at: block(items, at))
        summed = F.aggregate(
            blocks,
            F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<array<bigint>>").alias("all")),
            lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.concat(a["all"], F.array(F.transform(b["starts"], lambda s: s + a["n"]))).alias("all")),
        )
        return F.flatten(summed["all"])

    return let(
        item,
        lambda items: let(
            starts(items),
            lambda at: F.transform(items, lambda x, i: F.struct(F.get(at, i).alias("start"), x["m"].alias("match"), F.right(x["p"], F.lit(NEAR)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(NEAR)).alias("after"))),
        ),
    )


def _spans(text: Column, matches: Column, kind: str, threshold: float) -> Column:
    no, valid, (speaks_for, against) = KINDS.index(kind), VALID[kind], CONTEXT[kind]

    def span(x: Column) -> Column:
        around = F.concat(x["before"], F.lit(" "), x["after"])
        score = F.lit(SCORES[kind]) + F.when(around.rlike(speaks_for), 0.2).otherwise(0.0) - F.when(around.rlike(against), 0.2).otherwise(0.0)
        bounded = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)
        return F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), (x["start"] + F.length(x["match"])).alias("end"), F.lit(kind).alias("kind"), bounded.alias("score"))

    found = let(F.split(text, PATTERNS[kind][1], -1), lambda pieces: F.transform(F.filter(located(pieces, matches), lambda x: valid(x["match"])), span))
    return found if no < BASE_KINDS else F.filter(found, lambda s: s["score"] >= threshold)


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``keep`` columns and spans: structs start, kind_no, end, kind, score, in that order of sorting."""
    found = docs.select(*keep, text_of().alias("__t"))
    nothing = F.array().cast("array<string>")
    for kind in KINDS:
        needs, pattern = PATTERNS[kind]
        matches = F.regexp_extract_all("__t", F.lit(pattern), F.lit(0))
        found = found.withColumn(f"__{kind}", F.when(F.contains("__t", F.lit(needs)), matches).otherwise(nothing) if needs else matches)
    spans = [F.when(F.size(f"__{kind}") > 0, _spans(F.col("__t"), F.col(f"__{kind}"), kind, threshold)) for kind in KINDS]
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string,score:double>>")
    return found.select(*keep, F.array_sort(F.concat(*(F.coalesce(s, empty) for s in spans))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a hash of the base spans, all spans as text, and the other kinds' counts."""
    found = find_pii(docs.withColumn("doc_id", F.col("doc_id").cast("long")))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind_no"] < BASE_KINDS)
    return found.select("doc_id", *(count(k) for k in KINDS[:BASE_KINDS]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *(count(k) for k in KINDS[BASE_KINDS:]), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))
