"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

#: Elements of an array that are summed up at a time.
RUN = 256
#: Score from which a span of an added kind counts.
ACCEPT = 0.75
#: Characters before a span that are searched for context words.
CONTEXT = 40
#: Length of a country's account numbers, by the IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


@dataclass(frozen=True)
class Kind:
    """pattern: as the contract or format has it, written so that Java's matcher neither recurses nor
    rescans (possessive loops; a start inside a run only right after the match before). prior: score of
    a span that passes `valid`; context: words (as a pattern) that raise it by `lift`; shortest: least length of a match; base: kept whatever the score.
    """

    name: str
    pattern: str
    prior: float
    context: str
    shortest: int
    lift: float = 0.3
    base: bool = True


def _iban() -> str:
    """Numbers of their country's length; of other countries, as far as they go."""
    known = [rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()]
    other = rf"(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
    return rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(known)}|{other})\b"


#: Fixed formats and context words, in the order in which kinds are listed.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|write", 5),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server", 7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.7, r"card|visa|credit|payment", 2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, r"phone|call|tel|mobile", 4),
    Kind("iban", _iban(), 0.8, r"iban|account|bank", 15, base=False),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.5, r"ssn|social security", 11, base=False),
)


def running(lengths: Column) -> Column:
    """Running sums of an array of BIGINT, a run of RUN elements at a time."""
    none = F.array().cast("array<bigint>")
    within = lambda xs: F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")) + x)))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda k: within(F.slice(lengths, k * RUN + 1, RUN)))
    joined = F.aggregate(runs, F.struct(none.alias("ends"), F.array().cast("array<array<bigint>>").alias("out")), lambda acc, xs: F.struct(
        F.concat(acc["ends"], F.array(F.coalesce(F.get(acc["ends"], F.size(acc["ends"]) - 1), F.lit(0).cast("long")) + F.element_at(xs, -1))).alias("ends"),
        F.concat(acc["out"], F.array(F.transform(xs, lambda x: x + F.coalesce(F.get(acc["ends"], F.size(acc["ends"]) - 1), F.lit(0).cast("long"))))).alias("out"),
    ))
    return F.when(F.size(lengths) > RUN, F.flatten(joined["out"])).when(F.size(lengths) > 0, within(lengths)).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda z, x: z + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, four characters rotated to its end and letters as 10 to 35, leaves 1 on division by 97."""
    turned = F.split(F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4)), "")
    return F.aggregate(turned, F.lit(0), lambda z, c: F.when(c.rlike("[0-9]"), (z * 10 + F.ascii(c) - 48) % 97).otherwise((z * 100 + F.ascii(c) - 55) % 97)) == 1


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        plain = F.regexp_replace(match, " ", "")
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))
    return F.lit(True)


def _valid_span(kind: Kind):
    return lambda s: valid(kind.name, s["m"])


def score_of(kind: Kind, before: Column) -> Column:
    """The score of a valid match: its prior, lifted if the CONTEXT characters in front of it hold a context word."""
    lift = F.when(F.lower(F.right(before, F.lit(CONTEXT))).rlike(kind.context), F.lit(kind.lift)).otherwise(F.lit(0.0))
    return F.least(F.lit(kind.prior) + lift, F.lit(1.0))


def _scored_span(rank: int, kind: Kind, before):
    """From a struct (start, end, m, i) to a span; before(i) gives the text in front of match i."""

    def scored(s):
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), F.lit(kind.base).alias("base"), score_of(kind, before(s["i"])).alias("score"))

    return scored


def _before(kind: Kind, gaps: Column, matches: Column):
    """From a match's number to the text in front of it: its gap and as many matches before, with their gaps, as reach over CONTEXT."""
    end = lambda xs, i: F.coalesce(F.right(F.get(xs, i), F.lit(CONTEXT)), F.lit(""))
    back = -(-CONTEXT // kind.shortest)
    return lambda i: F.concat(*(x for k in range(back, 0, -1) for x in (end(gaps, i - k), end(matches, i - k))), end(gaps, i))


def _of_kind(name: str):
    return lambda s: s["kind"] == name


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `spans`: structs (start, rank, end, kind, base, score), ordered by start, then kind.

    Positions are code points, the end exclusive. Matches of a kind are the leftmost that do not
    overlap; those that fail validation are dropped without another try. A null text is empty and has
    no spans. Other columns pass through; a column `spans` is replaced. Repeated rows get their spans each.
    """
    columns = [c for c in docs.columns if c.lower() != "spans"]
    df = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    for kind in KINDS:
        df = df.withColumn(f"__m_{kind.name}", F.regexp_extract_all("__t", F.lit(kind.pattern), F.lit(0)))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean,score:double>>")
    long = "array<bigint>"
    for kind in KINDS:
        m, at = F.col(f"__m_{kind.name}"), f"__p_{kind.name}"
        gaps = F.split("__t", kind.pattern, -1)
        df = df.withColumn(f"__g_{kind.name}", F.when(F.size(m) > 0, gaps))
        df = df.withColumn(f"__n_{kind.name}", F.transform(f"__g_{kind.name}", lambda g: F.length(g).cast("long")))
        df = df.withColumn(f"__a_{kind.name}", F.when(F.size(m) > 0, running(F.col(f"__n_{kind.name}"))).otherwise(F.array().cast(long)))
        df = df.withColumn(f"__l_{kind.name}", F.transform(m, lambda x: F.length(x).cast("long")))
        df = df.withColumn(f"__b_{kind.name}", F.when(F.size(m) > 0, running(F.col(f"__l_{kind.name}"))).otherwise(F.array().cast(long)))
        a, b, lengths = F.col(f"__a_{kind.name}"), F.col(f"__b_{kind.name}"), F.col(f"__l_{kind.name}")
        found = F.transform(m, lambda x, i: F.struct((F.get(a, i) + F.get(b, i) - F.get(lengths, i)).alias("start"), (F.get(a, i) + F.get(b, i)).alias("end"), x.alias("m"), i.alias("i")))
        df = df.withColumn(at, F.when(F.size(m) > 0, F.filter(found, _valid_span(kind))))
    made = []
    for rank, kind in enumerate(KINDS):
        before = _before(kind, F.col(f"__g_{kind.name}"), F.col(f"__m_{kind.name}"))
        own = F.transform(F.col(f"__p_{kind.name}"), _scored_span(rank, kind, before))
        if not kind.base:
            own = F.filter(own, lambda s: s["score"] >= ACCEPT)
        made.append(F.coalesce(F.when(F.size(f"__p_{kind.name}") > 0, own), none))
    return df.withColumn("spans", F.array_sort(F.concat(*made))).select(*columns, "spans")


def written_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: key, the number of spans of each base kind, base_sha256, spans as text and their scores in hundredths.

    A null text is empty. Repeated rows and null keys keep their rows; other columns play no part. An empty
    table gives an empty result.
    """
    found = spans(docs.select(key, text), text)
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _of_kind(k.name))).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    return found.select(key, *counts, F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"))


def _without_kind(kind: Kind, text: Column) -> Column:
    def joined(t: Column, m: Column) -> Column:
        def shown(gaps: Column) -> Column:
            before = _before(kind, gaps, m)

            def one(x: Column, i: Column) -> Column:
                sure = valid(kind.name, x) if kind.base else valid(kind.name, x) & (score_of(kind, before(i)) >= ACCEPT)
                return F.when(sure, F.lit(f"[{kind.name.upper()}]")).otherwise(x)

            return F.array_join(F.zip_with(gaps, F.concat(F.transform(m, one), F.array(F.lit(""))), lambda g, x: F.concat(g, x)), "")

        return bound(F.split(t, kind.pattern, -1), shown)

    def replaced(t: Column) -> Column:
        return bound(F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, joined(t, m)).otherwise(t))

    return bound(text, replaced)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with each span that spans() finds in `text` replaced by its kind in brackets.

    Added kinds go first, those that context decides before the others, so all are judged on the text as given;
    then base kinds, one after the other, over what is left. A null text stays null, repeated rows stay, other
    columns pass through.
    """
    out = F.col(text)
    for kind in sorted(KINDS, key=lambda k: (k.base, k.prior >= ACCEPT)):
        out = _without_kind(kind, out)
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), out))
