"""Quality rules: learned decision lists over text statistics.

Statistics of every text are row expressions. A decision list is learned from labelled rows by sequential
covering: a rule for bad texts is a conjunction of thresholds, grown on two thirds of the labelled rows by
FOIL's gain, then pruned on the last third, where it must also prove itself; the rows it covers are
set aside before the next rule is grown. The list is returned as readable rules and applied as one
ordered conditional expression.

Growing and pruning look only at counts per statistic and interval (``CUTS`` intervals, cut at
quantiles over all texts), so a step is one aggregate over the labelled rows, whatever their number.

Cases: a null or empty text has no words, statistics of 0, and fails the base rule. Rows without label
teach nothing; labels repeated for an id count once, as bad if any is bad. Without labels, or without bad
ones, the list is empty and the base rule alone decides. Repeated rows are judged each. Equal gains
go to the first statistic and the lowest threshold. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import once
from labelloom.llm.common import SPACES, quoted, release, stored, word_array

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MARKS = "!?.,;:"
CUTS = 24
MOST_RULES = 8
MOST_CONDITIONS = 3
LEAST_COVER = 3
LEAST_PRECISION = 0.75


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """How many words lie in an n-word window that occurs twice or more in the text.

    Windows are hashed. Only a text with equal hashes is looked at further: hashes are sorted with
    their positions, equal neighbours give the positions of repeated windows, and what these cover is summed.
    """

    def covered(s: Column) -> Column:
        """``s``: sorted (h, i)."""
        equal = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: equal(k, k + 1) | equal(k - 1, k))
        places = F.array_sort(F.transform(again, lambda k: F.get(s, k)["i"]))
        return once(
            places,
            lambda p: F.aggregate(
                p,
                F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("last")),
                lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(n), i - acc["last"])).alias("sum"), i.alias("last")),
                lambda acc: acc["sum"],
            ),
        )

    def judged(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(once(pairs, covered))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)])
    )
    return F.when(F.size(words) > n, once(windows, judged)).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of whole-text statistics per document."""
    whole = F.coalesce(quoted(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        )

    def of_chars(t: Column) -> Column:
        dense = F.length(F.translate(t, SPACES, ""))
        return F.struct(
            dense.cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.length(t) - F.length(F.translate(t, MARKS, ""))).cast("long").alias("n_marks"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        )

    return docs.select(
        quoted(doc_id).alias("doc_id"),
        once(word_array(whole), of_words).alias("w"),
        once(lines, of_lines).alias("l"),
        once(whole, of_chars).alias("c"),
    ).select("doc_id", "w.*", "l.*", "c.*")


def features() -> dict[str, Column]:
    """What rules may ask about."""

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {
        "words": F.col("n_words").cast("double"),
        "chars per word": share("word_chars", "n_words"),
        "symbols per character": share("n_symbols", "word_chars"),
        "marks per character": share("n_marks", "word_chars"),
        "capitals per character": share("n_upper", "word_chars"),
        "share of repeated lines": share("n_dup_lines", "n_lines"),
        "share of words in repeated windows": share("n_repeat_words", "n_words"),
        "share of different words": share("n_distinct", "n_words"),
    }


def bin_name(feature: str) -> str:
    return "bin_" + feature.replace(" ", "_")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float
    place: int = 0  # of the limit among its feature's cuts

    def on_bins(self) -> Column:
        """The same over interval numbers: a value lies above cut k when its interval's number does."""
        number = F.col(bin_name(self.feature))
        return number > self.place if self.above else number <= self.place

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.limit if self.above else value <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def all_of(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.on_bins()
    return out


def binned(labelled: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """(bad, grow) and for each feature the number of cuts that a row's value exceeds."""
    numbers = [
        sum(((features()[name] > x).cast("int") for x in cuts[name]), F.lit(0)).alias(bin_name(name)) for name in cuts
    ]
    return labelled.select("bad", "grow", *numbers)


def gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """FOIL's gain of a narrower rule."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, int, int] | None:
    """The condition with the highest gain over binned rows, with the rows it leaves."""
    bins = [F.struct(F.lit(name).alias("name"), F.col(bin_name(name)).alias("bin")) for name in cuts]
    counts = rows.select("bad", F.inline(F.array(*bins))).groupBy("name", "bin").agg(
        F.sum("bad").alias("bad"), F.count("*").alias("n")
    )
    table: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts.collect():  # at most CUTS + 1 rows for each feature
        table.setdefault(r.name, {})[r.bin] = (r.bad, r.n - r.bad)
    best = (1e-9, None)
    for name in cuts:
        own = table.get(name, {})
        bad_all, good_all = (sum(x[k] for x in own.values()) for k in (0, 1))
        if not bad_all or not good_all:
            continue
        for k, limit in enumerate(cuts[name]):
            low = [sum(own.get(b, (0, 0))[j] for b in range(k + 1)) for j in (0, 1)]
            for above, (bad, good) in ((False, low), (True, [bad_all - low[0], good_all - low[1]])):
                worth = gain(bad, good, bad_all, good_all)
                if worth > best[0]:
                    best = (worth, (Condition(name, above, limit, k), bad, good))
    return best[1]


def learn(labelled: DataFrame, cuts: dict[str, list[float]]) -> list[Rule]:
    """The decision list for ``labelled(bad, grow, statistics)``: rules for bad texts, in order."""
    rules: list[Rule] = []
    rows = left = stored(binned(labelled, cuts), "quality-bins")
    while len(rules) < MOST_RULES:
        rule: Rule = ()
        while len(rule) < MOST_CONDITIONS:
            found = best_condition(left.filter("grow").filter(covers(rule)), cuts)
            if found is None:
                break
            rule += (found[0],)
            if not found[2]:
                break
        if not rule:
            break
        # pruning: the beginning of the rule that does best where it wasn't grown
        sums = []
        for k in range(1, len(rule) + 1):
            hit = covers(rule[:k]).cast("int")
            sums += [F.sum(hit * F.col("bad")).alias(f"bad{k}"), F.sum(hit).alias(f"n{k}")]
        r = left.filter("NOT grow").agg(*sums).first()
        worth = {k: (2 * (r[f"bad{k}"] or 0) - (r[f"n{k}"] or 0)) / max(r[f"n{k}"] or 0, 1) for k in range(1, len(rule) + 1)}
        k = max(worth, key=lambda k: (worth[k], -k))
        bad, n = r[f"bad{k}"] or 0, r[f"n{k}"] or 0
        if bad < LEAST_COVER or bad < LEAST_PRECISION * n:
            break
        rules.append(rule[:k])
        left = left.filter(~covers(rule[:k]))
    release(rows)
    return rules


def quantile_cuts(stats: DataFrame) -> dict[str, list[float]]:
    """Thresholds to choose from: the middles between neighbouring quantiles over all texts."""
    shares = [(k + 1) / (CUTS + 1) for k in range(CUTS)] + [0.001, 0.005, 0.99, 0.995, 0.999]
    named = features()
    row = stats.agg(*[F.percentile_approx(c, sorted(shares), 2000) for c in named.values()]).first()
    values = {name: sorted(set(row[k] or [])) for k, name in enumerate(named)}
    return {name: [(a + b) / 2 for a, b in zip(v, v[1:])] for name, v in values.items()}


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        out = out.when(all_of(rule), F.lit(k))
    return out.otherwise(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[Rule]]:
    """Per row the statistics, base_failed, rule (0: none) and kept; and the learned list."""
    stats = stored(statistics(docs, doc_id, text), "quality-stats")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    bad = known.agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    # thirds by a hash of the id
    grow = F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2
    labelled = stored(stats.join(bad, "doc_id").withColumn("grow", grow), "quality-labelled")
    rules = learn(labelled, quantile_cuts(stats))
    release(labelled)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed).withColumn("rule", decision(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
