"""Personal data by weak supervision (native).

Base spans come from strict patterns and always stay.  Wider patterns propose more candidates.  Three labelers vote
(-1, 0, 1) on each candidate: a regex labeler on its form, a gazetteer labeler on its parts, a context labeler on the
words between the match before and it.  The votes of all documents are counted by pattern of votes, a table with a fixed number of rows
(kinds x 27 x shapes), so the expectation-maximisation that estimates each labeler's reliabilities, and the logistic span
classifier trained on its posteriors, see the whole corpus without gathering it.  Candidates that the classifier accepts
are added to the base spans.

The patterns only use possessive loops over disjoint classes and look-behinds at the start of a run, so long runs of
letters or digits cost linear time and no stack.  Positions are code points, rebuilt from the gaps between matches.

Defined cases: null text is empty; documents without matches have no spans; a text may have any length and any number of
matches, whose lists grow in blocks; of wide candidates at one place all stay; repeated rows each get a result; an empty
table gives an empty result; other columns may have any names, ``pii`` and ``pii_spans`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, read, spliced, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind: (a character that each match holds, strict pattern).  Each equals the contract's pattern; a match starts where a
#: run starts or where the last match ended, which leaves the leftmost match as it is.
BASE = {
    "email": ("@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[ -]?[0-9]){15,}+"),
    "phone": ("+", r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: kind: wider pattern
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[a-z0-9-]{1,63}+(?: ?(?:\.|[\[(]dot[\])]) ?[a-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9+])(?<![0-9)][ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])(?![ .-][0-9])",
}
#: Words of the context labeler, in the 40 characters before a candidate, since the match before.
CONTEXT = {"email": "mail|contact|write|reach", "ip": "ip|address|host|server|login", "card": "card|visa|credit|payment|pay", "phone": "phone|tel|call|mobile|fax|contact"}
#: Gazetteers: endings of mail domains, prefixes of card issuers, ranges of area codes, prefixes of global addresses.
GAZETTEER = {"email": r"(?i)(com|org|net|edu|gov|io|de|fr|es|uk)$", "ip": r"(?i)^(2[0-9a-f]{3}|3[0-9a-f]{3}|fe80|fc|fd)|^[1-9]", "card": r"^(4|5[1-5]|2[2-7]|3[47]|36|6011|65)", "phone": r"^(\+[1-9]|\(?[2-9][0-9]{2})"}
_SPAN = "struct<start:int,end:int,m:string,before:string>"
_CAND = "array<struct<kind:string,start:int,end:int,base:boolean,key:string>>"
_PLACED = "struct<start:int,wide:boolean,c:struct<kind:string,start:int,end:int,base:boolean,key:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total, i):
        x = F.ascii(F.substr(back, i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _found(text: Column, matches: Column, pattern: str) -> Column:
    """Spans of the matches: the text's gaps give the places.  Each comes with the end of the gap before it."""
    sized = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("gap"), matches.alias("m"))

    def step(at, x):
        start = at + F.char_length(x["gap"])
        end = start + F.char_length(x["m"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["gap"], F.lit(40)).alias("before")))

    return F.when(F.size(matches) > 0, fold(sized, F.lit(0), _SPAN, step)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.substring(part(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _shape(kind: str, m: Column) -> Column:
    return F.concat(F.when(m.rlike("[ .()-]"), F.lit("s")).otherwise(F.lit("j")), F.least(F.length(_digits(m)) / 4, F.lit(4)).cast("int").cast("string"))


def _candidate(kind: str, base: bool, x: Column) -> Column:
    m, before = x["m"], F.lower(x["before"])
    form = F.lit(1)
    if not base:
        form = {"email": F.when(m.rlike(r"(?i)dot|\."), 1).otherwise(-1), "ip": F.lit(1), "card": F.when(luhn(_digits(m)), 1).otherwise(-1), "phone": F.when(m.rlike(r"^\(?[2-9]"), 1).otherwise(-1)}[kind]
    votes = [form, F.when(m.rlike(GAZETTEER[kind]), 1).otherwise(-1), F.when(before.rlike(rf"\b({CONTEXT[kind]})"), 1).otherwise(0)]
    key = F.concat_ws("|", F.lit(kind), *[v.cast("string") for v in votes], _shape(kind, m))
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), key.alias("key"))


def _checker(kind: str):
    return lambda x: _valid(kind, x["m"])


def _proposer(kind: str, base: bool):
    return lambda x: _candidate(kind, base, x)


def _free(base: Column, wide: Column) -> Column:
    """The wide candidates that no base span overlaps: one walk by falling, one by rising place."""
    placed = F.array_sort(F.transform(F.concat(base, wide), lambda c: F.struct(c["start"].alias("start"), (~c["base"]).alias("wide"), c.alias("c"))))
    some = lambda keep, x: F.when(keep, F.array(x)).otherwise(F.array().cast(f"array<{_PLACED}>"))

    def right(end, x):
        return F.when(x["wide"], end).otherwise(F.greatest(end, x["c"]["end"])), some(~x["wide"] | (x["start"] >= end), x)

    def left(start, x):
        return F.when(x["wide"], start).otherwise(F.least(start, x["start"])), some(~x["wide"] | (x["c"]["end"] <= start), x)

    clear = fold(F.reverse(fold(placed, F.lit(0), _PLACED, right)), F.lit(2**31 - 1), _PLACED, left)
    found = F.transform(F.filter(F.reverse(clear), lambda x: x["wide"]), lambda x: x["c"])
    return F.when(F.size(wide) > 0, found).otherwise(F.array().cast(_CAND))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows and columns plus ``pii``, the candidates of each row."""
    df = docs.drop("pii", "pii_spans").withColumn("__t", text_or_empty(text_col))
    text, none = F.col("__t"), F.array().cast("array<string>")
    # most texts have no digit and no @: one scan settles them
    df = df.withColumn("__d", text.rlike("[0-9]"))
    digit, at, plus = F.col("__d"), F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    asks = {("email", True): at, ("ip", True): digit, ("card", True): digit, ("phone", True): digit & plus, ("email", False): F.lower(text).rlike(r"[\[(]at[\])]"), ("ip", False): digit & F.contains(text, F.lit(":")), ("card", False): digit, ("phone", False): digit}
    patterns = {(k, b): (BASE[k][1] if b else WIDE[k]) for k, b in asks}
    name = lambda k, b: f"__{k}_{int(b)}"
    df = df.withColumns({name(*x): F.when(asks[x], F.regexp_extract_all(text, F.lit(patterns[x]), F.lit(0))).otherwise(none) for x in asks})
    df = df.withColumns({name(*x): _found(text, F.col(name(*x)), patterns[x]) for x in asks})
    df = df.withColumns({name(k, True): F.filter(name(k, True), _checker(k)) for k in KINDS})
    base = F.concat(*[F.transform(name(k, True), _proposer(k, True)) for k in KINDS]).cast(_CAND)
    df = df.withColumn("__base", base)
    wide = F.concat(*[F.transform(name(k, False), _proposer(k, False)) for k in KINDS]).cast(_CAND)
    df = df.withColumn("__wide", wide)
    return df.withColumn("pii", F.concat("__base", _free(F.col("__base"), F.col("__wide")))).drop("__t", "__d", "__base", "__wide", *[name(*x) for x in asks])


def vote_counts(found: DataFrame) -> dict[tuple[str, ...], int]:
    """How often each pattern of votes occurs: at most kinds x 27 x shapes rows, whatever the input's size."""
    rows = found.select(F.explode("pii.key").alias("key")).groupBy("key").count().collect()
    return {tuple(r["key"].split("|")): r["count"] for r in rows}


def reliabilities(counts: dict, rounds: int = 50) -> tuple[dict, dict]:
    """Expectation-maximisation for two classes: each labeler's P(vote | kind, class) and the posterior of each pattern."""
    post = {k: 1 / (1 + math.exp(-sum(map(int, k[1:4])))) for k in counts}
    table: dict = {}
    for _ in range(rounds):
        table = {}
        for kind in KINDS:
            own = {k: n for k, n in counts.items() if k[0] == kind}
            for y in (0, 1):
                mass = {k: n * (post[k] if y else 1 - post[k]) for k, n in own.items()}
                whole = sum(mass.values())
                table[kind, "prior", y] = whole + 1
                for j in (1, 2, 3):
                    for v in ("-1", "0", "1"):
                        agrees = 2.0 if (v == "1") == bool(y) else 0.5  # a labeler is taken to be better than chance
                        table[kind, j, v, y] = (sum(m for k, m in mass.items() if k[j] == v) + agrees) / (whole + 3)
        new = {}
        for k in counts:
            p = [math.log(table[k[0], "prior", y]) + sum(math.log(table[k[0], j, k[j], y]) for j in (1, 2, 3)) for y in (0, 1)]
            new[k] = 1 / (1 + math.exp(max(-500.0, min(500.0, p[0] - p[1]))))
        moved = max((abs(new[k] - post[k]) for k in counts), default=0)
        post = new
        if moved < 1e-9:
            break
    return table, post


def span_classifier(counts: dict, post: dict, rounds: int = 200) -> dict[tuple[str, ...], float]:
    """Logistic model of kind, votes and shape, fitted to the posteriors; gives each pattern's probability."""
    names = sorted({(j, x) for k in counts for j, x in enumerate(k)})
    place = {f: i for i, f in enumerate(names)}
    w = [0.0] * len(names)
    rows = [([place[j, x] for j, x in enumerate(k)], post[k], math.log1p(n)) for k, n in sorted(counts.items())]
    whole = sum(n for *_, n in rows) or 1
    prob = lambda at: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in at)))))
    for _ in range(rounds):
        step = [-1e-3 * x for x in w]
        for at, y, n in rows:
            e = n / whole * (y - prob(at))
            for i in at:
                step[i] += e
        w = [x + 2.0 * s for x, s in zip(w, step)]
    return {k: prob(r[0]) for k, r in zip(sorted(counts), rows)}


def detect(docs: DataFrame, text_col: str = "text", *, carry_text: bool = True, threshold: float = 0.5) -> DataFrame:
    """The input's rows and columns (without the text if not ``carry_text``) plus ``pii_spans``: array of (kind, start, end, base)."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = candidates(docs, text_col)
    found = scratch.keep(found if carry_text else found.drop(text_col))
    counts = vote_counts(found)
    _, post = reliabilities(counts)
    accepted = ["|".join(k) for k, p in span_classifier(counts, post).items() if p >= threshold]
    keys = F.array(*[F.lit(k) for k in accepted]).cast("array<string>")
    spans = F.filter("pii", lambda c: c["base"] | F.array_contains(keys, c["key"]))
    order = F.transform(spans, lambda c: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base")))
    return found.withColumn("pii_spans", F.transform(F.array_sort(order), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))).drop("pii")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one counts."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    piece = "struct<since:int,start:int,end:int,by:string>"

    def step(at, s):
        one = F.array(F.struct(at.alias("since"), s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
        return F.when(s["start"] >= at, s["end"]).otherwise(at), F.when(s["start"] >= at, one).otherwise(F.array().cast(f"array<{piece}>"))

    return F.when(F.size(spans) > 0, spliced(text, fold(order, F.lit(0), piece, step))).otherwise(text)


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark, sf_dir):
    out = detect(read(spark, sf_dir, "documents").select("doc_id", "text"), carry_text=False)
    base = F.filter("pii_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("pii_spans")).alias("spans"))
