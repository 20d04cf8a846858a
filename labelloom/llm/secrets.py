"""Secret scans: fixed patterns, and a battery of randomness tests for what they miss.

Candidates are runs of key characters (20 or more, with a digit and a letter) that overlap no pattern match.
For each, the encoding is inferred (hex, base 32, base 36, base 62, base 64) and its characters become
numbers of that alphabet. Three tests ask whether these are uniform and independent:

* chi-squared over equal parts of the alphabet (4, 8 or 16 parts, as the length allows),
* the number of runs above and below the middle of the alphabet,
* the serial correlation of neighbours.

Fisher's method combines the three p-values. Ordinary identifiers fail, keys don't. Per band of lengths,
a histogram of p-values gives the Benjamini-Hochberg threshold below which a candidate counts as not
random (false discovery rate ``rate``); long strings carry more evidence and don't share a threshold
with short ones. Candidates that are not rejected are reported as ``random`` spans.

All steps are DataFrame functions. Texts are scanned where they are read; candidates, about one in a
hundred documents, are what is shuffled.

Cases: null and empty texts have no spans. Positions are code points. A match too short for its kind still
uses up its text. Every row is reported, repeated ones too; a null doc_id too. Equal candidates are
tested each. Spans with equal starts are ordered by kind. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions.text import once
from labelloom.llm.common import quoted, stored

# The kinds in their order, their patterns, and the least length of what counts.
ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs of fewer are dropped anyway, and a run is taken whole
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
SPANS = "array<struct<start:int,kind:int,stop:int,token:string>>"
# Alphabets in the order of their numbers, narrowest first.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^.*$", UPPER + LOWER + DIGITS + "-_+/"),
)
STEPS_PER_DECADE = 4
LAST_BIN = 80


def matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the leftmost matches that don't overlap; ``keep`` judges the matched string.

    The pieces between matches and the matches themselves alternate, which gives the positions.
    """

    def placed(found: Column, gaps: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            token = F.get(found, i)
            start = acc["at"] + F.length(F.get(gaps, i))
            stop = start + F.length(token)
            span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), token.alias("token")))
            return F.struct(
                stop.alias("at"), F.when(keep(token), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
            )

        none = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), none, step, lambda acc: acc["spans"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = once(F.struct(found.alias("f"), F.split(text, pattern, -1).alias("g")), lambda m: placed(m["f"], m["g"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))


def scanned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, base, candidates) of every text."""
    whole = F.coalesce(quoted(text), F.lit(""))
    value = F.regexp_extract
    mixed = lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]")
    found = docs.select(
        quoted(doc_id).alias("doc_id"),
        matches(whole, ASSIGN, 0, lambda t: F.length(value(t, ASSIGN, 1)) >= 6).alias("assign"),
        matches(whole, ACCESS, 1, lambda t: F.length(t) >= 20).alias("access"),
        matches(whole, HEX, 2, lambda t: F.length(t) >= 24).alias("hex"),
        matches(whole, CANDIDATE, 3, mixed).alias("loose"),
    ).select("doc_id", F.concat("assign", "access", "hex").alias("base"), "loose")
    apart = F.filter(
        "loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    )
    return found.select("doc_id", "base", apart.alias("candidates"))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable; a logistic form within 0.0002, and of the right order far out."""
    x = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * x + 0.070565 * x * x * x))


def randomness(token: Column) -> Column:
    """The combined p-value of the three tests for one candidate."""
    body = F.regexp_replace(token, "=+$", "")
    alphabet = F.coalesce(*[F.when(body.rlike(p), F.lit(a)) for p, a in ENCODINGS])

    def tested(t: Column) -> Column:
        v, n, k = t["v"], F.size(t["v"]).cast("double"), t["k"].cast("double")
        parts = F.when(n < 40, 4.0).when(n < 80, 8.0).otherwise(16.0)
        index = F.sequence(F.lit(0), F.size(v) - 2)

        def cell(b: Column) -> Column:
            share = (F.ceil((b + 1) * k / parts) - F.ceil(b * k / parts)) / k
            seen = F.size(F.filter(v, lambda x: F.floor(x * parts / k) == b))
            return (seen - n * share) * (seen - n * share) / (n * share)

        chi = F.aggregate(F.sequence(F.lit(0), parts.cast("int") - 1), F.lit(0.0), lambda acc, b: acc + cell(b))
        spread = 2 / (9 * (parts - 1))
        z_chi = (F.pow(chi / (parts - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        high = F.size(F.filter(v, lambda x: 2 * x >= k)).cast("double")
        changes = F.size(F.filter(index, lambda i: (2 * F.get(v, i) >= k) != (2 * F.get(v, i + 1) >= k)))
        both = 2 * high * (n - high)
        expected = both / n + 1
        variance = F.greatest(F.lit(1e-9), both * (both - n) / (n * n * (n - 1)))
        z_runs = F.abs(changes + 1 - expected) / F.sqrt(variance)
        mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n
        power = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        lagged = F.aggregate(index, F.lit(0.0), lambda acc, i: acc + (F.get(v, i) - mean) * (F.get(v, i + 1) - mean))
        z_serial = F.abs(lagged / F.greatest(power, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        p_values = (upper_tail(z_chi), 2 * upper_tail(z_runs), 2 * upper_tail(z_serial))
        half = -sum(F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-30), p))) for p in p_values)
        # the upper tail of chi-squared with six degrees of freedom
        fisher = F.exp(-half) * (1 + half + half * half / 2)
        return F.when((high == 0) | (high == n), F.lit(0.0)).otherwise(fisher)

    numbers = once(
        F.struct(F.split(body, "").alias("c"), alphabet.alias("a")),
        lambda s: F.struct(
            F.transform(s["c"], lambda c: F.instr(s["a"], c).cast("double") - 1).alias("v"), F.length(s["a"]).alias("k")
        ),
    )
    return once(numbers, tested)


def unrejected(candidates: DataFrame, rate: float) -> DataFrame:
    """The candidates whose p-value lies above their length band's false-discovery threshold."""
    band = F.least(F.lit(5), F.floor(F.log2(F.col("stop") - F.col("start")) * 2 - 8)).cast("int")
    decade = F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) * STEPS_PER_DECADE)
    tested = candidates.withColumn("band", band).withColumn("bin", F.least(F.lit(LAST_BIN), decade).cast("int"))
    # bins run from the smallest p-values down; a bin's largest p-value stands for it
    run = W.partitionBy("band").orderBy(F.desc("bin"))
    whole = W.partitionBy("band")
    counts = tested.groupBy("band", "bin").count()
    limit = F.pow(F.lit(10.0), -F.col("bin") / F.lit(STEPS_PER_DECADE))
    cut = (
        counts.withColumn("upto", F.sum("count").over(run))
        .withColumn("all", F.sum("count").over(whole))
        .filter(limit <= rate * F.col("upto") / F.col("all"))
        .groupBy("band")
        .agg(F.min("bin").alias("cut"))
    )
    never = F.coalesce("cut", F.lit(LAST_BIN + 1))
    # a single strong failure needs no company to be believed
    return tested.join(cut, "band", "left").filter((F.col("bin") < never) & (F.col("p") > rate))


def joined(spans: Column) -> Column:
    """kind:start:stop, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def find_secrets(docs: DataFrame, rate: float = 0.01, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row."""
    rows = stored(scanned(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    loose = rows.filter(F.size("candidates") > 0).select("row", F.inline("candidates"))
    tested = stored(loose.withColumn("p", randomness(F.col("token"))), "secret-candidates")
    extra = (
        unrejected(tested, rate)
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "stop", "token")).cast(SPANS).alias("extra"))
    )
    none = F.array().cast(SPANS)
    full = rows.join(extra, "row", "left").withColumn("extra", F.coalesce("extra", none))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return full.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.size("extra").cast("long").alias("n_random"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "extra")).alias("spans"),
    )
