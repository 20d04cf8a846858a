"""Labeling functions: which criteria hold for which text, and the votes that follow.

The working form is a *ballot*: one row per item with ``fired ARRAY<INT>`` (numbers of
the criteria that hold) and ``votes ARRAY<STRUCT<lf, c>>`` (those of them that map to a
class). It comes straight out of the text scan, so everything that only looks at one
item at a time (majority vote, posteriors, vote rows) needs no shuffle at all. The long
form (item_id, criterion, class_idx) is an explode away.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.text import (
    contains_all,
    keywords_of,
    once,
    parse_answer,
)
from labelloom.operators.classes import ClassList
from labelloom.operators.criteria import last_wins
from labelloom.operators.rule_index import rules_that_hold
from labelloom.session import release, stored
from labelloom.sizing import compute_once, constant, local_frame, rows_within
from labelloom.sources.writers import dense_row

ABSTAIN = -1
# Up to this many keyword criteria are tested one by one on every text; more are looked up in an
# index of their rarest grams. Both ways give the same verdicts.
PLANNED_CRITERIA = 400
# Up to this many criteria are written into the plan one by one, which spares a lookup per text.
LITERAL_CRITERIA = 64
# Fixed value: how many criteria one model request carries.
CRITERIA_PER_REQUEST = 300

VOTES = "array<struct<lf:int,c:int>>"
ANSWER = "found_criteria array<string>, _bad string"


class LabelingFunction(NamedTuple):
    lf: int
    criterion: str
    description: str | None
    class_idx: int


@dataclass(frozen=True)
class LabelingSet:
    """Numbered labeling functions of one run."""

    functions: tuple[LabelingFunction, ...]

    def __len__(self) -> int:
        return len(self.functions)

    @property
    def names(self) -> list[str]:
        return [f.criterion for f in self.functions]

    @property
    def class_of(self) -> list[int]:
        return [f.class_idx for f in self.functions]

    def frame(self, spark: SparkSession) -> DataFrame:
        return local_frame(
            spark, list(self.functions), "lf int, criterion string, description string, class_idx int"
        )

    def only(self, criteria: Iterable[str]) -> LabelingSet:
        """The given criteria, order preserved, renumbered."""
        kept = set(criteria)
        left = [f for f in self.functions if f.criterion in kept]
        return LabelingSet(tuple(f._replace(lf=i) for i, f in enumerate(left)))


def ordered_criteria(criteria: DataFrame) -> list[Row]:
    """The distinct criteria in order. They are the columns of a model, so a run holds their list."""
    return sorted(last_wins(criteria).collect(), key=lambda r: r.ord)


def labeling_set(criteria: DataFrame, classes: ClassList) -> LabelingSet:
    """Functions of a criteria table; a class outside the list always abstains."""
    rows = ordered_criteria(criteria)
    index = {name: i for i, name in enumerate(classes.names)}
    return LabelingSet(
        tuple(
            LabelingFunction(i, r.criterion, r.description, index.get(r["class"], ABSTAIN))
            for i, r in enumerate(rows)
        )
    )


# --- keyword criteria ----------------------------------------------------------------


def lowered_pieces(descriptions: list[str]) -> list[list[str]]:
    """The '+'-separated pieces of each description, lower-cased by the engine that lower-cases the texts.

    A local relation: the driver evaluates it without a job.
    """
    spark = SparkSession.active()
    rows = local_frame(spark, [(d,) for d in descriptions], "d string").select(keywords_of(F.col("d")).alias("k"))
    return [r.k for r in rows.collect()]


def fired_by_keywords(text: Column, lfs: LabelingSet) -> Column:
    """Numbers of the keyword criteria that hold for a text, ascending.

    A criterion holds when the lower-cased text contains each of its '+'-separated
    pieces. A null text or description holds for nothing. Built-in functions are the only
    matcher, whatever the number of keywords: another one could lower-case differently.
    """
    described = [f for f in lfs.functions if f.description is not None]
    pieces = lowered_pieces([f.description for f in described])
    none = F.array().cast("array<int>")
    if not described:
        return none
    if len(described) <= LITERAL_CRITERIA:

        def held(t: Column) -> Column:
            rules = [F.when(all_of([F.contains(t, F.lit(k)) for k in kws]), F.lit(f.lf)) for f, kws in zip(described, pieces)]
            return F.array_compact(F.array(*rules))

        return F.when(text.isNotNull(), once(F.lower(text), held)).otherwise(none)
    rules = [{"lf": f.lf, "kws": k} for f, k in zip(described, pieces)]
    table = constant(rules, "array<struct<lf:int,kws:array<string>>>")
    held_rules = once(F.lower(text), lambda t: F.filter(table, lambda rule: contains_all(t, rule["kws"])))
    return F.when(text.isNotNull(), held_rules["lf"]).otherwise(none)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def votes_of(fired: Column, lfs: LabelingSet) -> Column:
    """Votes of the criteria that hold; a criterion without a class never votes."""
    class_of = constant(lfs.class_of, "array<int>")
    voted = F.transform(fired, lambda lf: F.struct(lf.alias("lf"), F.get(class_of, lf).alias("c")))
    return F.filter(voted, lambda v: v["c"] >= 0)


def _ballot(items: DataFrame, keep: tuple[str, ...], fired: Column, lfs: LabelingSet) -> DataFrame:
    """Ballots whose criteria are judged exactly once per row, whatever is done with them later."""
    once_fired = compute_once(items, "item_id", *keep, fired=fired)
    return compute_once(once_fired, "item_id", *keep, "fired", votes=votes_of(F.col("fired"), lfs))


def keyword_ballots(
    items: DataFrame, lfs: LabelingSet, keep: tuple[str, ...] = (), planned: int = PLANNED_CRITERIA
) -> DataFrame:
    """Ballots (item_id, kept columns, fired, votes).

    Up to ``planned`` criteria are tested in one scan of the texts. More of them are looked up in an
    index of grams, and the numbers of those that hold come back by item_id, which has to be unique.
    """
    if len(lfs) <= planned:
        return _ballot(items, keep, fired_by_keywords(F.col("text"), lfs), lfs)
    found = rules_that_hold(items, keyword_rules(lfs.frame(items.sparkSession), F.col("lf"), "lf"))
    # an item has each function once at most
    per_item = found.groupBy("item_id").agg(F.sort_array(F.collect_list("lf")).alias("fired"))
    joined = items.select("item_id", *keep).join(per_item, "item_id", "left")
    fired = F.coalesce("fired", F.array().cast("array<int>"))
    return compute_once(joined.withColumn("fired", fired), "item_id", *keep, "fired", votes=votes_of(F.col("fired"), lfs))


def keyword_rules(criteria: DataFrame, order: Column, *columns: str) -> DataFrame:
    """Rules (ord, columns, kws) of criteria with a description."""
    described = criteria.filter("description IS NOT NULL")
    return described.select(order.cast("long").alias("ord"), *columns, keywords_of(F.col("description")).alias("kws"))


def with_votes(fired: DataFrame, lfs: LabelingSet) -> DataFrame:
    return fired.withColumn("votes", votes_of(F.col("fired"), lfs))


def expression_ballots(
    items: DataFrame, lfs: LabelingSet, conditions: dict[str, Column], keep: tuple[str, ...] = ()
) -> DataFrame:
    """Ballots of user-supplied functions: one boolean column expression per criterion."""
    held = [F.when(conditions[f.criterion], F.lit(f.lf)) for f in lfs.functions]
    return _ballot(items, keep, F.array_compact(F.array(*held)), lfs)


def keyword_votes_long(
    items: DataFrame, criteria: DataFrame, classes: ClassList, planned: int = PLANNED_CRITERIA
) -> DataFrame:
    """Votes (item_id, criterion, class_idx) for criteria tables of any size.

    Up to ``planned`` criteria go into the plan. A bigger table stays a table: its rules are filed
    under their rarest grams, see ``rule_index``. Criteria of classes outside the list never vote.
    """
    merged = stored(last_wins(criteria), "criteria")
    if rows_within(merged.select("ord"), planned) is not None:
        lfs = labeling_set(merged, classes)
        release(merged)
        return votes_long(keyword_ballots(items, lfs, planned=planned), lfs)
    voting = merged.join(classes.frame(items.sparkSession), F.col("class") == F.col("class_name"))
    held = rules_that_hold(items, keyword_rules(voting, F.xxhash64("criterion"), "criterion", "class_idx"))
    release(merged)
    return held.select("item_id", "criterion", "class_idx")


# --- criteria judged by a model ------------------------------------------------------


def request_chunks(
    criteria: DataFrame, domain_info: str | None = None, per_request: int = CRITERIA_PER_REQUEST
) -> list[str]:
    """Instruction texts, each covering the next ``per_request`` criteria in order."""
    listed = [(r.criterion, r.description) for r in ordered_criteria(criteria)]
    return [
        request_chunk_text(listed[start : start + per_request], domain_info)
        for start in range(0, len(listed), per_request)
    ]


def request_chunk_text(criteria: list[tuple[str, str]], domain_info: str | None) -> str:
    """The instruction for one request, with the domain section only if there is one."""
    domain = f"## Domain\n{domain_info}\n\n" if domain_info else ""
    listed = "\n".join(f"- {name}: {description}" for name, description in criteria)
    return (
        f"{domain}Decide which of the criteria below hold for the text you are given. Answer with a JSON "
        'object with the keys "thoughts" (your reasoning) and "found_criteria" (names of the criteria '
        f"that hold).\n\n## Criteria\n{listed}"
    )


def model_requests(items: DataFrame, chunks: list[str]) -> DataFrame:
    """One request per item and chunk: item_id, chunk, prompt, text."""
    table = constant(chunks, "array<string>")
    return items.select("item_id", F.posexplode(table).alias("chunk", "prompt"), "text")


def read_answers(answers: DataFrame, on_unreadable: str = "fail", keep: tuple[str, ...] = ()) -> DataFrame:
    """Answers (item_id, chunk, content, failed) as item_id, kept columns, failed and the names ``found``.

    An unreadable answer counts as a failed request (``"fail"``), or has no names (``"skip"``).
    """
    if on_unreadable not in ("skip", "fail"):
        raise ValueError(f"unknown on_unreadable: {on_unreadable}")
    parsed = answers.select(
        "item_id",
        *keep,
        F.coalesce("failed", F.lit(False)).alias("failed"),
        F.from_json(
            F.regexp_extract("content", r"(?s)\{.*\}", 0),
            ANSWER,
            {"allowUnquotedControlChars": "true", "columnNameOfCorruptRecord": "_bad"},
        ).alias("a"),
    )
    failed = F.col("failed")
    if on_unreadable == "fail":
        failed = failed | F.col("a").isNull() | F.col("a._bad").isNotNull()
    return parsed.select("item_id", *keep, failed.alias("failed"), F.col("a.found_criteria").alias("found"))


def fired_by_answers(
    answers: DataFrame, lfs: LabelingSet, on_unreadable: str = "fail", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Ballots from model answers (item_id, chunk, content, failed).

    The names found are united over the chunks of an item. ``fired`` is null, not empty,
    when nothing at all was found or when a request failed for good: the item was not
    judged. Unknown names match nothing. An unreadable answer counts as a failed request
    (``on_unreadable="fail"``), or adds nothing (``"skip"``).
    """
    parsed = read_answers(answers, on_unreadable, keep)
    united = parsed.groupBy("item_id", *keep).agg(
        F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"),
        F.max("failed").alias("failed"),
    )
    names = constant(lfs.names, "array<string>")
    numbers = F.filter(
        F.transform(names, lambda n, i: F.when(F.array_contains("found", n), i)), lambda i: i.isNotNull()
    )
    judged = ~F.col("failed") & (F.size("found") > 0)
    return united.select("item_id", *keep, F.when(judged, numbers).alias("fired"))


def answer_schema(lfs: LabelingSet) -> dict:
    """JSON schema of a judging answer: reasoning, and names among the known criteria."""
    listed = {"type": "array", "items": {"type": "string", "enum": lfs.names}}
    return {
        "type": "object",
        "properties": {"thoughts": {"type": "string"}, "found_criteria": listed},
        "required": ["thoughts", "found_criteria"],
        "additionalProperties": False,
    }


def answer_problems(answers: DataFrame, lfs: LabelingSet) -> DataFrame:
    """Answers that break the response contract: unreadable, or naming unknown criteria."""
    known = constant(lfs.names, "array<string>")
    parsed = answers.withColumn("found", parse_answer(F.col("content"), "found_criteria array<string>")["found_criteria"])
    unknown = F.array_except("found", known)
    return parsed.select("item_id", "chunk", F.col("found").isNull().alias("unreadable"), unknown.alias("unknown")).filter(
        F.col("unreadable") | (F.size("unknown") > 0)
    )


def model_ballots(
    items: DataFrame,
    lfs: LabelingSet,
    chunks: list[str],
    model: Callable[[DataFrame], DataFrame],
    keep: tuple[str, ...] = (),
    on_unreadable: str = "fail",
) -> DataFrame:
    """Ballots through a caller's model.

    ``model`` maps requests (item_id, chunk, prompt, text) to answers (item_id, chunk,
    content, failed). Items without any answer count as not judged.
    """
    fired = fired_by_answers(model(model_requests(items, chunks)), lfs, on_unreadable)
    joined = items.select("item_id", *keep).join(fired, "item_id", "left")
    return with_votes(joined, lfs).withColumn("votes", F.coalesce("votes", F.array().cast(VOTES)))


def ballots(
    items: DataFrame,
    lfs: LabelingSet,
    mode: str = "keywords",
    chunks: list[str] | None = None,
    model: Callable[[DataFrame], DataFrame] | None = None,
    keep: tuple[str, ...] = (),
    on_unreadable: str = "fail",
) -> DataFrame:
    """Judge the criteria by keywords, or by a model (any other mode)."""
    if mode == "keywords":
        return keyword_ballots(items, lfs, keep)
    if model is None or chunks is None:
        raise ValueError("model mode needs request chunks and a model")
    return model_ballots(items, lfs, chunks, model, keep, on_unreadable)


# --- other forms ---------------------------------------------------------------------


def verdict_map(fired: Column, lfs: LabelingSet) -> Column:
    """MAP<criterion, BOOLEAN> of an item; all values null when it was not judged."""
    names = constant(lfs.names, "array<string>")
    return once(fired, lambda f: F.map_from_arrays(names, F.transform(names, lambda n, i: F.array_contains(f, i))))


def verdicts(ballot_table: DataFrame, lfs: LabelingSet, keep: tuple[str, ...] = ()) -> DataFrame:
    return ballot_table.select("item_id", *keep, verdict_map(F.col("fired"), lfs).alias("labels"))


def ballots_from_verdicts(verdict_table: DataFrame, lfs: LabelingSet, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ballots of stored verdicts (item_id, labels)."""
    names = constant(lfs.names, "array<string>")
    hits = F.transform(names, lambda n, i: F.when(F.try_element_at("labels", n), i))
    fired = verdict_table.select("item_id", *keep, F.filter(hits, lambda i: i.isNotNull()).alias("fired"))
    return with_votes(fired, lfs)


def votes_long(ballot_table: DataFrame, lfs: LabelingSet) -> DataFrame:
    """One row per vote: item_id, criterion, class_idx. Abstains are absent."""
    names = constant(lfs.names, "array<string>")
    flat = ballot_table.select("item_id", F.explode("votes").alias("v"))
    return flat.select("item_id", F.get(names, F.col("v.lf")).alias("criterion"), F.col("v.c").alias("class_idx"))


def ballots_from_votes(items: DataFrame, votes: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Ballots of a long vote table; items without a vote stay, with an empty ballot.

    An item has at most one vote per function, so a collected group is bounded.
    """
    number = F.array_position(constant(names, "array<string>"), F.col("criterion")) - 1
    cast = votes.select("item_id", F.struct(number.cast("int").alias("lf"), F.col("class_idx").cast("int").alias("c")).alias("v"))
    grouped = cast.filter("v.lf >= 0 and v.c >= 0").groupBy("item_id").agg(F.sort_array(F.collect_list("v")).alias("votes"))
    return items.select("item_id", *keep).join(grouped, "item_id", "left").withColumn(
        "votes", F.coalesce("votes", F.array().cast(VOTES))
    )


def vote_matrix(ballot_table: DataFrame, lfs: LabelingSet) -> DataFrame:
    """Wide votes: one INT column per function, -1 for abstain. Prefer the JSON sink for many functions."""
    dense = ballot_table.select("item_id", dense_row(F.col("votes"), len(lfs)).alias("_dense"))
    return dense.select("item_id", *[F.col("_dense")[i].alias(n) for i, n in enumerate(lfs.names)])


def patterns(ballot_table: DataFrame, *also: str) -> DataFrame:
    """Distinct ballots with the number of items that share them.

    Items with the same votes get the same posterior, so the iterative models run on
    patterns: the rows are combined before the shuffle and once for all iterations.
    """
    return ballot_table.groupBy("votes", *also).agg(F.count("*").alias("n"))
