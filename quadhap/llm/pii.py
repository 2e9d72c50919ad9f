"""Personal data in texts with column functions only: patterns propose spans, checksums confirm them, nearby words adjust a score.

A pattern's matches come from ``regexp_extract_all`` and the text between them from ``split``
with the same pattern, so offsets are running sums of their lengths and the words near a
match lie at the ends of its neighbouring pieces. Patterns use look-behinds at run starts and
possessive or bounded repeats; that keeps them linear in the text. An account number is as long
as its country's are, so the next word or number is never taken for a part of it; of a country
without a known length, the longest run that ends with a word is judged.

Defined cases: a null text counts as empty; repeated rows and ids are judged row by row; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes, ``needs`` is a cheap sign without which no match exists, ``context`` raises the score, ``base`` the score without it."""

    name: str
    pattern: str
    needs: str
    context: str
    base: float


EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Letters and digits of a country's account numbers (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_BODIES = [rf"(?:{codes})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()] + [rf"(?!{'|'.join(IBAN_LENGTHS.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"]
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(_BODIES)})(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"

KINDS = (
    Kind("email", EMAIL, "@", "(?i)mail|contact|write|schreib|correo|courriel", 0.9),
    Kind("ip", IP, ".", "(?i)\\bip\\b|server|host|address|adresse|login", 0.6),
    Kind("card", CARD, "", "(?i)card|visa|credit|karte|carte|tarjeta|payment", 0.7),
    Kind("phone", PHONE, "+", "(?i)phone|tel|call|mobil|fax|ruf", 0.6),
    Kind("iban", IBAN, "", "(?i)iban|bank|account|konto|compte|cuenta", 0.8),
    Kind("ssn", SSN, "-", "(?i)ssn|social security", 0.3),
)
BASE = ("email", "ip", "card", "phone")
WINDOW = 40
#: Score a span needs; the base kinds are kept whatever their score.
LEAST = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn check."""
    doubled = F.lit("0246813579")  # twice the digit, its figures added
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
        F.lit(0),
        lambda acc, i: acc
        + F.when((F.length(digits) - i) % 2 == 0, digits.substr(i, F.lit(1)).cast("int")).otherwise(doubled.substr(digits.substr(i, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int")),
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(value: Column) -> Column:
    """Whether an account number of up to 34 letters and digits leaves 1 when its country code and check digits are moved to the end and it is read in base ten, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when(moved.substr(i, F.lit(1)).rlike("[0-9]"), (acc * 10 + moved.substr(i, F.lit(1)).cast("int")) % 97).otherwise((acc * 100 + F.ascii(moved.substr(i, F.lit(1))) - 55) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def kind_spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind: array of struct(kind, start, end, value, score), offsets in code points, end exclusive."""
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    around = F.split(text, kind.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string,near:string>>").alias("found"))

    def place(m):
        def step(acc, i):
            left, value = F.element_at(m["around"], i), F.element_at(m["values"], i)
            begin = acc["at"] + F.length(left)
            near = F.concat_ws(" ", F.right(left, F.lit(WINDOW)), F.left(F.element_at(m["around"], i + 1), F.lit(WINDOW)))
            end = begin + F.length(value)
            return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(begin.alias("start"), end.alias("end"), value.alias("value"), near.alias("near"))).alias("found"))

        return F.aggregate(F.sequence(F.lit(1), F.size(m["values"])), start, step)["found"]

    # both arrays are bound once, as the element of a list of one; inside the fold they would be computed for every match
    placed = F.flatten(F.transform(F.array(F.struct(values.alias("values"), around.alias("around"))), place))
    spans = F.transform(
        F.filter(placed, lambda s: _confirmed(kind.name, s["value"])),
        lambda s: F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.least(F.lit(1.0), F.lit(kind.base) + F.when(s["near"].rlike(kind.context), 0.3).otherwise(0.0)).alias("score"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")
    sign = F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike("[0-9]")
    return F.when(sign & text.rlike(kind.pattern), spans).otherwise(none)


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = LEAST) -> DataFrame:
    """``doc_id, spans``: confirmed spans of every whole text by kind, then start. Kinds other than the base ones need a score of ``least``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = [kind_spans(F.col("text"), k) if k.name in BASE else F.filter(kind_spans(F.col("text"), k), lambda s: s["score"] >= least) for k in kinds]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).select("doc_id", F.concat(*found).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summarise(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`find_pii`'s spans."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.aggregate("spans", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("top_score"))


def _wanted(kind: Kind):
    return lambda s: F.lit(kind.name in BASE) | (s["score"] >= LEAST)


def _cover(kind: Kind):
    return lambda acc, s: F.replace(acc, s["value"], F.lit(f"[{kind.name}]"))


def redact(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in brackets, kinds in their order of registration."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for k in KINDS:
        wanted = F.filter(kind_spans(F.col("text"), k), _wanted(k))
        rows = rows.withColumn("text", F.aggregate(wanted, F.col("text"), _cover(k)))
    return rows
