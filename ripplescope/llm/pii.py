"""Personal data by patterns, checksum validators and context, with DataFrame functions only.

Patterns propose spans, kind by kind, leftmost and without overlap within a kind; validators confirm them
(part values for ip, Luhn for card, digit counts for phone, mod-97 for iban); words nearby adjust each span's
score. Spans of the base kinds that their validator confirms stay, whatever their score; those of the added
kinds (iban; nid: a grouped national number; secret: a long mixed word that is called a token or the like) stay if
their score reaches KEEP.

The patterns are written so that they neither recurse nor try a run of characters again from its middle:
their quantifiers are possessive, and a run may begin only where the character before is not of it or where
the last match ended. Offsets count code points, end exclusive. One pass marks the matches of a kind with a
private character (that character in a text counts as another one), and sums of part lengths give offsets.

Null text counts as empty and has no spans; texts are searched whole; repeated rows give repeated results;
no rows give no rows; other columns of the input are kept by find and redact.
"""
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplescope.llm import _common as C

KEEP = 0.5
_MARK, _OTHER = "\ue000", "\ufffd"
_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


class Kind(NamedTuple):
    name: str
    pattern: str
    hint: Callable[[Column], Column]  # cheap test that a text may have matches
    valid: Callable[[Column], Column]
    score: float
    context: str  # words that raise the score by 0.4
    base: bool


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(x: Column) -> Column:
    plain = F.upper(F.replace(x, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(values, F.lit(0), lambda a, v: ((a * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int"))
    return F.length(plain).between(15, 34) & (rest == 1)


def _mixed(x: Column) -> Column:
    """Letters and digits, at least ten different ones."""
    return x.rlike("[0-9]") & x.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(x, ""))) >= 10)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HAS_DIGIT = lambda t: t.rlike("[0-9]")
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda x: F.lit(True), 0.6, "mail|contact|write|reach|correo|courriel", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", _HAS_DIGIT, lambda x: x.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), 0.5, r"\bip\b|host|server|address|from|login", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _HAS_DIGIT, lambda x: F.length(_digits(x)).between(14, 19) & F.call_function("luhn_check", _digits(x)), 0.6, "card|visa|credit|debit|pay|karte|carte|tarjeta", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda x: F.length(_digits(x)).between(10, 15), 0.5, r"phone|\btel\b|call|mobile|fax|whatsapp", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _HAS_DIGIT, _mod97, 0.6, "iban|account|bank|konto|compte|cuenta", False),
    Kind("nid", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _HAS_DIGIT, lambda x: ~x.rlike("^(?:000|666|9)|-00-|-0000$"), 0.2, r"\bssn\b|social|tax|identity|passport", False),
    Kind("secret", r"(?:(?<![A-Za-z0-9_-])|\G)[A-Za-z0-9_-]{20,}+", _HAS_DIGIT, _mixed, 0.2, r"token|secret|passw|api.?key|credential", False),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _runs(items: Column) -> Column:
    """The items in runs of about the root of their number, so that work that copies a run for each of its items stays small."""
    size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items))).cast("int"))
    return _let(size, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / n).cast("int") - 1, F.lit(0))), lambda k: F.slice(items, k * n + 1, n)))


def _before(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each value what all values before it come to."""
    start = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("out"))
    step = lambda a, v: F.struct(add(a["now"], v).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out"))
    return F.aggregate(values, start, step, lambda a: a["out"])


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    """Array of the kind's valid spans in order."""
    none = F.array().cast(f"array<{_SPAN}>")

    def run(parts: Column, first: Column) -> Column:
        """Spans of a run of parts, the first of which begins at `first`."""

        def step(a: Column, x: Column) -> Column:
            end = a["pos"] + x["size"]
            score = F.lit(kind.score) + F.when(x["near"].rlike(kind.context), 0.4).otherwise(0.0)
            span = F.struct(a["pos"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
            taken = x["near"].isNotNull() & F.coalesce(kind.valid(x["text"]), F.lit(False))
            if not kind.base:
                taken = taken & (score >= KEEP)
            return F.struct(end.alias("pos"), F.when(taken, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        return F.aggregate(parts, F.struct(first.alias("pos"), none.alias("out")), step, lambda a: a["out"])

    def described(parts: Column) -> Column:
        """Each part with its length and, for a match, what stands around it: 48 characters before, as far as two matches back, and 24 after."""
        part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        near = lambda x, i: F.lower(F.concat(F.right(F.concat(part(i - 3), part(i - 2), part(i - 1)), F.lit(48)), x, F.substring(part(i + 1), 1, 24)))
        return F.transform(parts, lambda x, i: F.struct(F.when(i % 2 == 1, x).alias("text"), F.length(x).alias("size"), F.when(i % 2 == 1, near(x, i)).alias("near")))

    def of(runs: Column) -> Column:
        sizes = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x["size"]))
        return F.flatten(F.zip_with(runs, _before(sizes, lambda a, v: a + v), run))

    parts = F.split(F.regexp_replace(text, kind.pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    found = _let(parts, lambda p: F.when(F.size(p) > 1, _let(described(p), lambda d: _let(_runs(d), of))).otherwise(none))
    return F.when(kind.hint(text), found).otherwise(none)


def find(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """All columns of `docs` (but one that is named `out_col`) and the array of spans (start, rank of kind, end, kind, score), by start, then kind."""
    text = F.translate(F.coalesce(docs[text_col].cast("string"), F.lit("")), _MARK, _OTHER)
    own = C.free(docs, "__pii_text")
    found = [_spans(F.col(own), rank, kind) for rank, kind in enumerate(KINDS)]
    return docs.withColumn(own, text).withColumn(out_col, F.array_sort(F.concat(*found))).drop(own)


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """The columns of find()'s result with [KIND] in place of each span; overlapping spans give way to the first."""
    text = F.col(text_col)

    def run(spans: Column, first: Column, following: Column) -> Column:
        """The text from `first` to `following` with the spans that begin there replaced; the text is cut once for a run."""
        own = F.substring(text, first + 1, following - first)

        def replaced(own: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                free = s["start"] >= a["pos"]
                piece = F.concat(F.substring(own, a["pos"] - first + 1, s["start"] - a["pos"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
                return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), F.when(free, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

            start = F.struct(first.alias("pos"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(own, a["pos"] - first + 1, F.length(own))))

        return _let(own, replaced)

    def of(runs: Column) -> Column:
        ends = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, s: F.greatest(a, s["end"])))

        def bounds(first: Column) -> Column:  # a run's text goes up to where the next one's begins
            stops = F.concat(F.slice(first, 2, F.size(first)), F.array(F.length(text)))
            zipped = F.arrays_zip(runs.alias("r"), first.alias("a"), stops.alias("z"))
            return F.array_join(F.transform(zipped, lambda x: run(x["r"], x["a"], F.greatest(x["a"], x["z"]))), "")

        return _let(_before(ends, F.greatest), bounds)

    spans = F.col(spans_col)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, _let(_runs(spans), of)).otherwise(text))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = len([k for k in KINDS if k.base])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    counts = [number(kind.name) for kind in KINDS if kind.base]
    return found.select("doc_id", *counts, F.sha2(said(F.filter("pii", lambda s: s["rank"] < base)).cast("binary"), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))
