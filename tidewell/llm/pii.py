"""Personal data: patterns propose spans, checksums confirm them, context words score them.

All of it is SQL functions. A pattern's matches are found in one pass that puts markers around
them; splitting at the markers gives the pieces in order, and sums of their lengths give each
match's place. The markers' characters are first replaced in the text by another control
character, which none of the patterns accepts either, so places and matches are unaffected.

Patterns are written with possessive quantifiers and anchors that leave the matches as they
are while a long run of letters or digits is read once and never recurses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tables import whole_text

_OPEN, _CLOSE, _PLAIN = "\x01", "\x02", "\x03"
#: Proposals by kind. The first four are the base kinds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{20,}+(?!@|\.[A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: A character that every proposal of the kind holds; texts without it are not searched.
_NEEDS = {"email": "@", "phone": "+"}
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": "mail|contact|write|address|correo|courriel",
    "ip": "ip|address|host|server|addr",
    "card": "card|visa|mastercard|credit|payment|tarjeta|carte|karte",
    "phone": "phone|tel|call|mobile|fax|cell",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
    "secret": "token|secret|key|api|auth|bearer|credential|password|passwd|pwd",
}
#: Score of a span before context: confirmed by a checksum or rich in form, or by form alone.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "secret": 0.3}
#: What a context word adds, how many characters around a span (up to the next
#: span of its kind) are looked at, and the least score of an added kind.
BOOST, NEAR, LEAST = 0.35, 40, 0.5

#: Different characters that a key or token holds at least, so words and rulers are none, and the most it holds in
#: all: longer values are data. It also needs a digit, a letter, and twelve of them in a row, unlike names of paths.
DISTINCT, MOST = 10, 512


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _mod97(text: Column) -> Column:
    """ISO 7064 remainder of an IBAN, taken four digits at a time."""
    plain = F.regexp_replace(text, r"\x20", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    numbers = F.transform(F.split(turned, "(?!^)(?!$)"), lambda c: F.when(c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string")))
    blocks = F.regexp_extract_all(F.array_join(numbers, ""), F.lit("[0-9]{1,4}"), F.lit(0))
    return F.aggregate(blocks, F.lit(0), lambda rest, b: (rest * F.pow(F.lit(10), F.length(b)).cast("int") + b.cast("int")) % 97)


def _small_part(part: Column) -> Column:
    value = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(value) <= 3) & (F.left(value, F.lit(3)).cast("int") <= 255)


#: What confirms a proposal.
CONFIRM = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small_part),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", F.left(_digits(m), F.lit(19))),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
    "iban": lambda m: F.length(F.regexp_replace(m, r"\x20", "")).between(15, 34) & (_mod97(m) == 1),
    "ssn": lambda m: F.lit(True),
    "secret": lambda m: (F.length(m) <= MOST) & F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[A-Za-z]")) & F.regexp_like(m, F.lit("[A-Za-z0-9]{12}")) & (F.size(F.array_distinct(F.split(m, ""))) >= DISTINCT),
}


def _running(values: Column, combine) -> Column:
    """Running total of an array under an associative ``combine``, by doubling steps (n log n, no growing arrays)."""
    steps = F.transform(F.sequence(F.lit(1), F.length(F.bin(F.size(values)))), lambda i: F.call_function("shiftleft", F.lit(1), i - 1))

    def double(total: Column, k: Column) -> Column:
        n = F.size(total)
        earlier = F.concat(F.array_repeat(F.lit(0), F.least(k, n)), F.slice(total, 1, F.greatest(n - k, F.lit(0))))
        return F.when(k >= n, total).otherwise(F.zip_with(total, earlier, combine))

    return F.aggregate(steps, values, double)


def _proposals(kind: str, text: Column) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost non-overlapping matches, ends exclusive, in code points."""
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, _PLAIN * 2), f"({PATTERNS[kind]})", f"{_OPEN}$1{_CLOSE}")

    def placed(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda x, i: F.length(x) - F.when(i > 0, 1).otherwise(0))
        parts = F.zip_with(pieces, _running(lengths, lambda a, b: a + b), _part)
        n = F.size(parts) - 1  # the first part is what precedes the first match
        return F.zip_with(F.slice(parts, 2, n), F.slice(parts, 1, n), _span)

    return F.element_at(F.transform(F.array(F.split(marked, _OPEN)), placed), 1)


def _part(piece: Column, end_of_piece: Column) -> Column:
    """A match with what follows it up to the next one."""
    value, rest = F.substring_index(piece, _CLOSE, 1), F.substring_index(piece, _CLOSE, -1)
    start = end_of_piece - F.length(piece) + 1
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.left(rest, F.lit(NEAR)).alias("after"), F.right(rest, F.lit(NEAR)).alias("before_next"))


def _span(part: Column, earlier: Column) -> Column:
    return F.struct(part["start"].alias("start"), part["end"].alias("end"), part["value"].alias("value"), F.concat(earlier["before_next"], F.lit(" "), part["after"]).alias("near"))


def _scored(kind: str, spans: Column) -> Column:
    def score(s: Column) -> Column:
        near = F.regexp_like(s["near"], F.lit(rf"(?i)\b(?:{CONTEXT[kind]})"))
        value = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near, BOOST).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), value.alias("score"))

    return F.transform(spans, score)


def _confirmed(kind: str, text: Column) -> Column:
    return F.filter(_proposals(kind, text), lambda s: CONFIRM[kind](s["value"]))


def detect(docs: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS), text: str = "text") -> DataFrame:
    """Add ``pii``: ``array<struct<kind, start, end, value, score>>``, by kind as listed and then start.

    Spans of base kinds stay whatever their score; those of added kinds need ``LEAST``. Null and
    empty texts have none. Proposals that fail their check are dropped without another try.
    Columns pass through, but one named ``pii`` is replaced; repeated rows are searched each;
    an empty table stays empty.
    """
    body = whole_text(text)
    none = F.array().cast("array<struct<start:int,end:int,value:string,near:string>>")
    out = docs.withColumn("_body", body)
    for kind in kinds:
        needed = F.contains(F.col("_body"), F.lit(_NEEDS[kind])) if kind in _NEEDS else F.regexp_like("_body", F.lit(PATTERNS[kind]))
        out = out.withColumn(f"_{kind}", F.when(needed, _confirmed(kind, F.col("_body"))).otherwise(none))
    scored = [_scored(k, F.col(f"_{k}")) if k in BASE else F.filter(_scored(k, F.col(f"_{k}")), lambda s: s["score"] >= LEAST) for k in kinds]
    return out.withColumn("pii", F.concat(*scored)).drop("_body", *[f"_{k}" for k in kinds])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace personal data by ``<KIND>``: each span, and together those that overlap, becomes one tag.

    The tag names the span that starts first. Needs the column ``pii`` of :func:`detect` and drops it.
    A null text without spans stays null.
    """
    body = whole_text(text)
    ordered = F.array_sort("pii", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def cleaned(spans: Column) -> Column:
        covered = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        before = F.concat(F.array(F.lit(0)), covered)  # what earlier spans cover; one entry more than spans

        def piece(s: Column, done: Column) -> Column:
            tag = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.when(s.isNull(), F.substr(body, done + 1, F.length(body))).when(s["start"] >= done, F.concat(F.substr(body, done + 1, s["start"] - done), tag)).otherwise("")

        return F.array_join(F.zip_with(spans, before, piece), "")

    clean = F.element_at(F.transform(F.array(ordered), cleaned), 1)
    return docs.withColumn(text, F.when(F.size("pii") > 0, clean).otherwise(F.col(text))).drop("pii")


def is_kind(*kinds: str):
    return lambda span: span["kind"].isin(*kinds)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
