"""Personal data: patterns propose spans, checksums confirm them, words on both sides of them adjust their scores.

Everything is a column expression (regular expressions, array functions), so it runs inside the JVM.

A pattern's matches are found by putting a mark around each one and splitting the text at the marks; lengths of the
pieces give positions in code points. Patterns with a repeated group are applied after the character that joins
the group's repeats (a dot between labels, a separator between digits) is itself replaced by a mark, so each
pattern is a plain run of one character class: no recursion and no second look at a long run, whatever its length.

Running positions are folded in blocks, so the time does not grow with the square of the number of spans.

Null and empty texts have no spans. Spans of different kinds may overlap. Every row is answered on its own: repeated rows
give repeated results, rows of null doc_id results of null doc_id, an empty table none. Further columns, whatever their
names, are not looked at; redact() returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE, DOT, JOIN, STAND_IN = map(chr, (0xE000, 0xE001, 0xE002, 0xF8FF))

#: Base kinds in the order in which equal starts are listed, then the kinds that this method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "local_phone")
BASE = KINDS[:4]
#: Score of a confirmed span, what a context word adds, and what is needed to be kept.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.3, "local_phone": 0.3}
CONTEXT_GAIN, KEPT = 0.3, 0.5
CONTEXT_CHARS = 40
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": "card|visa|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|fax|mobil|anruf",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "national_id": "ssn|social security",
    "local_phone": "phone|tel|call|fax|mobil|anruf",
}

_LOCAL = rf"[A-Za-z0-9._%+{DOT}-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+{DOT}[A-Za-z0-9{DOT}-]+"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = rf"[0-9][0-9{JOIN}]{{11,}}"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_LOCAL_PHONE = r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(digits)
    at = lambda k: F.substring(digits, k, F.lit(1)).cast("int")
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    values = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.when((n - k) % 2 == 1, doubled(at(k))).otherwise(at(k)))
    return (n > 0) & (F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10 == 0)


def mod97(code: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 checksum."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def add(rest: Column, k: Column) -> Column:
        c = F.substring(turned, k, F.lit(1))
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), F.lit(0), add) == 1


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        digits = _only_digits(value)
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_only_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


#: Values that _running() folds at a time. It is even: in blocks of pieces, too, the second is the first inside marks.
BLOCK = 256


def _in_blocks(values: Column) -> Column:
    last = F.greatest(F.ceil(F.size(values) / BLOCK).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))


def _running(values: Column, step) -> Column:
    """For each of some whole numbers the fold of all before it, from 0. The step is a sum or a maximum."""
    zero = F.lit(0)

    def scan(xs: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, state, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    return _let(_in_blocks(values), lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, lambda b: F.aggregate(b, zero, step)), zero), scan)))


#: Pieces on one side of a span that can hold its context: proposals, of at least five characters, and what is between them.
NEAR = 2 * (CONTEXT_CHARS // 5) + 1
_SPAN_ARRAY = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _spans(kind: str, marked: Column) -> Column:
    """Spans of a text with marks around the proposals of kind: start, rank, end, kind, score."""

    def described(pieces: Column) -> Column:
        starts = _let(F.transform(pieces, F.length), lambda v: _running(v, lambda a, b: a + b))
        parts = F.struct(pieces.alias("piece"), starts.alias("start"), F.transform(pieces, lambda x: F.right(x, F.lit(CONTEXT_CHARS))).alias("tail"), F.transform(pieces, lambda x: F.left(x, F.lit(CONTEXT_CHARS))).alias("head"))
        return F.when(F.size(pieces) > 1, _let(parts, found)).otherwise(F.array().cast(_SPAN_ARRAY))

    def found(v: Column) -> Column:
        def span(k: Column) -> Column:
            i = 2 * k  # counted from 1, every second piece is inside marks
            before = F.right(F.array_join(F.slice(v["tail"], F.greatest(i - NEAR, F.lit(1)), F.least(i - 1, F.lit(NEAR))), ""), F.lit(CONTEXT_CHARS))
            after = F.left(F.array_join(F.slice(v["head"], i + 1, F.lit(NEAR)), ""), F.lit(CONTEXT_CHARS))
            score = F.lit(SCORES[kind]) + F.when(F.lower(before).rlike(CONTEXT[kind]) | F.lower(after).rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)
            piece, start = F.get(v["piece"], i - 1), F.get(v["start"], i - 1)
            own = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(piece)).alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))
            return F.when(_confirmed(kind, piece) & (score >= KEPT), own)

        return F.filter(F.transform(F.sequence(F.lit(1), F.floor(F.size(v["piece"]) / 2).cast("int")), span), lambda x: x.isNotNull())

    return _let(F.split(marked, EDGE), described)


def _when_has(text: Column, guard: Column, kind: str, marked: Column) -> Column:
    return F.when(guard, _spans(kind, marked)).otherwise(F.array().cast(_SPAN_ARRAY))


def _mark(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, f"{EDGE}$0{EDGE}")


def find(text: Column) -> Column:
    """All spans of a text, by start and then kind: an array of (start, rank, end, kind, score) in code points."""
    text = F.coalesce(text, F.lit(""))
    own = EDGE + DOT + JOIN
    text = F.when(text.contains(EDGE) | text.contains(DOT) | text.contains(JOIN), F.translate(text, own, STAND_IN * len(own))).otherwise(text)
    dotted = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    joined = F.regexp_replace(text, "(?<=[0-9])[ -](?=[0-9])", JOIN)
    return F.array_sort(
        F.concat(
            _when_has(text, text.contains("@"), "email", _mark(dotted, _EMAIL)),
            _when_has(text, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "ip", _mark(text, _IP)),
            _when_has(text, text.rlike("[0-9](?:[ -]?[0-9]){11}"), "card", _mark(joined, _CARD)),
            _when_has(text, text.contains("+"), "phone", _mark(text, _PHONE)),
            _when_has(text, text.rlike(_IBAN), "iban", _mark(text, _IBAN)),
            _when_has(text, text.rlike(_NATIONAL), "national_id", _mark(text, _NATIONAL)),
            _when_has(text, text.rlike(_LOCAL_PHONE), "local_phone", _mark(text, _LOCAL_PHONE)),
        )
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and the spans of each row."""
    return docs.select(F.col("doc_id").cast("long"), find(F.col(column).cast("string")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""

    def cut(v: Column) -> Column:
        first = lambda x: F.struct(x["span"]["start"].alias("to"), x["span"]["kind"].alias("kind"), x["done"].alias("at"))
        ends = F.transform(v["spans"], lambda x: x["end"])
        done = _let(ends, lambda e: _running(e, lambda a, b: F.greatest(a, b)))
        heads = F.transform(F.filter(F.zip_with(v["spans"], done, lambda x, d: F.struct(x.alias("span"), d.alias("done"))), lambda x: x["span"]["start"] >= x["done"]), first)
        return F.concat(F.array_join(F.transform(_let(heads, _in_blocks), lambda b: block(v["text"], b)), ""), F.substring(v["text"], F.array_max(ends) + 1, F.length(v["text"])))

    def block(whole: Column, b: Column) -> Column:
        base = b[0]["at"]
        own = F.struct(b.alias("b"), F.substring(whole, base + 1, F.element_at(b, -1)["to"] - base).alias("text"))
        piece = lambda w, x: F.concat(F.substring(w["text"], x["at"] - w["b"][0]["at"] + 1, x["to"] - x["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return _let(own, lambda w: F.array_join(F.transform(w["b"], lambda x: piece(w, x)), ""))

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.struct(text.alias("text"), spans.alias("spans")), cut))


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text, and n_chars (where there is one) as long as the new text."""
    order = docs.columns
    text = F.col("text").cast("string")
    out = docs.withColumn("text", _let(find(text), lambda spans: redacted(text, spans)))
    if "n_chars" in order:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in order])
