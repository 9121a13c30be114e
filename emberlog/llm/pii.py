"""Personal data in texts: spans proposed by regular expressions and confirmed by validators.

Base kinds are e-mail addresses, IPv4 addresses (parts up to 255), payment cards (Luhn) and
international phone numbers (digit count).  More kinds come on top: IBANs, confirmed by their
remainder modulo 97, social security numbers, which no checksum covers, so that only a
word about them nearby lifts their score over the threshold, ids of access keys, and secrets that are assigned to a name
(letters and digits both confirm them).  Every span has a score: what its
kind is worth, more with a word of its kind within ``NEAR`` code points before or after it.

All of it is Spark SQL: the matches of a pattern and the pieces of text between them give the
places by running sums.  Offsets count code points; ends are exclusive.

Defined results: a null text counts as empty and has no spans; rows are taken each on its own;
columns other than id and text pass through ``redact`` untouched; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
_BLOCK = 128


@dataclass(frozen=True)
class Kind:
    name: str
    #: For Java: loops are possessive where nothing could be given back, so that they neither recurse nor retry.
    pattern: str
    trigger: str  #: a text without this expression has no match
    worth: float
    context: str  #: words that lift the score
    mask: str


_NAME = r"(?:[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)[\x20\"']{0,3}[=:][\x20\"']{0,3}"

BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, r"mail|contact|write to", "[EMAIL]"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.7, r"\bip\b|address|host|server", "[IP]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.8, r"card|visa|amex|payment", "[CARD]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, r"tel|phone|call|mobile|fax", "[PHONE]"),
)
EXTRA = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}", 0.8, r"iban|account|bank|konto", "[IBAN]"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, r"ssn|social security", "[SSN]"),
    Kind("key", r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"(?:AKIA|ASIA)", 0.8, r"key|access|credential", "[KEY]"),
    Kind("secret", rf"{_NAME}[A-Za-z0-9+/_.-]{{8,}}", _NAME, 0.6, r"login|user|credential|auth", "[SECRET]"),
)
KINDS = BASE + EXTRA
LIFT, THRESHOLD = 0.2, 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """The remainder of an IBAN, its first four characters moved to the end and letters read as numbers."""
    plain = F.replace(m, F.lit(" "))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(F.pmod(a * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))))


def confirmed(kind: str, m: Column) -> Column:
    """Whether the validator of the kind accepts a match."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.coalesce(F.call_function("luhn_check", _digits(m)), F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "))).between(15, 34) & (_mod97(m) == 1)
    if kind == "secret":
        value = F.regexp_extract(m, r"[A-Za-z0-9+/_.-]+$", 0)
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def detect(docs: DataFrame, into: str = "pii_spans") -> DataFrame:
    """Adds a column to the rows: array of (kind, start, stop, score) by kind, then start.

    Each step is one projection for all kinds: Spark goes through the whole plan again at each step that is added to it.
    """
    plus, zero = lambda a, x: a + x, F.lit(0).cast("long")
    of = lambda name, kind: F.col(f"__{name}_{kind.name}")

    def step(df: DataFrame, **made) -> DataFrame:
        return df.withColumns({f"__{name}_{k.name}": f(k) for name, f in made.items() for k in KINDS})

    def some(kind: Kind) -> Column:
        return F.col("__text").contains("@") if kind.trigger == "@" else F.col("__text").rlike(kind.trigger)

    def blocks(kind: Kind) -> Column:
        sums = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(of("step", kind)) - 1) / _BLOCK).cast("int")),
            lambda b: F.aggregate(F.slice(of("step", kind), b * _BLOCK + 1, F.lit(_BLOCK)), zero, plus),
        )
        return F.when(F.size(of("step", kind)) > 0, sums).otherwise(_none("array<bigint>"))

    def found(kind: Kind) -> Column:
        def span(m: Column, i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            stop = F.get(of("before", kind), b) + F.aggregate(F.slice(of("step", kind), b * _BLOCK + 1, i - b * _BLOCK + 1), zero, plus)
            return F.struct((stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("match"))

        return F.filter(F.transform(of("m", kind), span), lambda s: confirmed(kind.name, s["match"]))

    def kept(kind: Kind) -> Column:
        def scored(s: Column) -> Column:
            around = F.lower(F.concat(F.substr("__text", F.greatest(s["start"] - NEAR + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(NEAR)).cast("int")), F.lit(" "), F.substr("__text", (s["stop"] + 1).cast("int"), F.lit(NEAR))))
            score = F.lit(kind.worth) + F.when(around.rlike(kind.context), LIFT).otherwise(0.0)
            return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), score.alias("score"))

        spans = F.transform(of("found", kind), scored)
        return F.filter(spans, lambda s: s["score"] >= THRESHOLD) if kind in EXTRA else spans

    df = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    df = step(
        df,
        m=lambda k: F.when(some(k), F.regexp_extract_all("__text", F.lit(k.pattern), F.lit(0))).otherwise(_none("array<string>")),
        g=lambda k: F.when(some(k), F.split("__text", k.pattern, -1)).otherwise(_none("array<string>")),
    )
    # sums of gaps and matches by blocks, then within a block, so that many matches cost little more than few
    df = step(df, step=lambda k: F.zip_with(F.slice(of("g", k), 1, F.size(of("m", k))), of("m", k), lambda g, m: (F.length(g) + F.length(m)).cast("long")))
    df = step(df, block=blocks)
    df = step(df, before=lambda k: F.transform(of("block", k), lambda _, b: F.aggregate(F.slice(of("block", k), F.lit(1), b), zero, plus)))
    df = step(df, found=found)
    made = [f"__{name}_{k.name}" for name in ("m", "g", "step", "block", "before", "found") for k in KINDS]
    return df.withColumn(into, F.flatten(F.array(*[kept(k) for k in KINDS]))).drop("__text", *made)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, the hash of the base spans, all spans and their scores as text, more counts."""
    found = detect(docs.select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["kind"].isin([k.name for k in BASE]))
    counts = [_number(F.col("pii_spans"), k.name).alias(f"n_{k.name}") for k in KINDS]
    scores = F.array_join(F.transform("pii_spans", lambda s: s["score"].cast("decimal(3,2)").cast("string")), ",")
    total = F.size("pii_spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts[: len(BASE)], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"), scores.alias("scores"), *counts[len(BASE) :], total)


def redact(docs: DataFrame) -> DataFrame:
    """The rows with the spans that ``detect`` finds in ``text`` masked, and ``n_chars``, if there is one, made to fit.

    Of spans that overlap the first gives the mask for all.
    """
    columns = docs.columns
    # the rows as one column, so that no name of theirs meets a name used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), "text")
    some = F.size("pii") > 0
    three = lambda s, *more: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), *more)
    df = detect(rows, "pii").withColumn("pii", F.array_sort(F.transform("pii", lambda s: three(s))))
    before = lambda i: F.coalesce(F.array_max(F.transform(F.slice("pii", F.lit(1), i), lambda s: s["stop"])), F.lit(0).cast("long"))
    df = df.withColumn("pii", F.transform("pii", lambda s, i: three(s, before(i).alias("before"))))
    cut = lambda at, n: F.substr("text", (at + 1).cast("int"), n.cast("int"))
    mask = lambda kind: F.coalesce(*[F.when(kind == k.name, k.mask) for k in KINDS])
    pieces = F.transform("pii", lambda s: F.concat(cut(s["before"], F.greatest(s["start"] - s["before"], F.lit(0))), F.when(s["start"] >= s["before"], mask(s["kind"])).otherwise("")))
    end = F.array_max(F.transform("pii", lambda s: s["stop"]))
    df = df.withColumn("masked", F.when(some, F.concat(F.array_join(pieces, ""), F.substr("text", (end + 1).cast("int")))).otherwise(F.col("text")))
    new = {"text": F.col("masked")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(some, F.length("masked")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return df.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in columns])
