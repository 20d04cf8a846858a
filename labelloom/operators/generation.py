"""What a criteria-writing model is shown: per class the texts to cover and to avoid.

Texts are joined into *fragments*, each covering one fixed range of item ids. Ids are
unique, so a fragment holds at most that many texts even for a class with most of the
rows, and fragments read in order give the texts of a class in item order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import prompt, section
from labelloom.sizing import constant, local_frame, rows_within

IDS_PER_FRAGMENT = 64
MAX_PROMPT_CHARS = 4_000_000
MAX_REQUESTS = 10_000

_NAME = {"type": "string"}
# JSON schemas a model can be held to when it answers.
CRITERIA_SCHEMA = {
    "type": "object",
    "properties": {
        "criteria": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {"criterion": _NAME, "description": _NAME, "class": _NAME},
                "required": ["criterion", "description", "class"],
                "additionalProperties": False,
            },
        }
    },
    "required": ["criteria"],
    "additionalProperties": False,
}
DEDUP_SCHEMA = {
    "type": "object",
    "properties": {"unique_criteria": {"type": "array", "items": _NAME}},
    "required": ["unique_criteria"],
    "additionalProperties": False,
}


def context_fragments(judged: DataFrame, ids_per_fragment: int = IDS_PER_FRAGMENT) -> DataFrame:
    """Joined texts per class, outcome and id range.

    ``judged(item_id, text, label, outcome)`` has outcome 'wrong' for texts the criteria
    still have to cover and 'correct' for texts they already do.
    """
    ranged = judged.filter("text is not null and label is not null").withColumn(
        "fragment", F.expr(f"item_id div {int(ids_per_fragment)}")
    )
    return (
        ranged.groupBy("label", "outcome", "fragment")
        .agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("rows"))
        .select(
            "label",
            "outcome",
            "fragment",
            F.size("rows").cast("bigint").alias("n_texts"),
            F.array_join("rows.text", "\n\n").alias("body"),
        )
    )


def context_sizes(judged: DataFrame) -> DataFrame:
    """Per class: texts to cover, to avoid, and already covered.

    To avoid are all texts of the other classes, of either outcome; they are counted as
    the total minus the own ones instead of being listed per class.
    """
    per_label = (
        judged.filter("text is not null and label is not null")
        .groupBy("label")
        .agg(
            F.count_if(F.col("outcome") == "wrong").alias("n_positive"),
            F.count_if(F.col("outcome") == "correct").alias("n_correct"),
        )
    )
    # one row per class
    gathered = per_label.agg(
        F.sum(F.col("n_positive") + F.col("n_correct")).alias("everything"),
        F.collect_list(F.struct("label", "n_positive", "n_correct")).alias("rows"),
    )
    return gathered.select("everything", F.inline("rows")).select(
        "label",
        "n_positive",
        "n_correct",
        (F.col("everything") - F.col("n_positive") - F.col("n_correct")).alias("n_negative"),
    )


def generation_requests(
    judged: DataFrame,
    dataset: str,
    wanted: int = 5,
    existing: DataFrame | None = None,
    domain_info: str | None = None,
    keyword_rules: bool = True,
    max_chars: int = MAX_PROMPT_CHARS,
) -> DataFrame:
    """One model request per class with texts to cover: request_no, label, prompt.

    A prompt is one string and has to fit a model, so the gold sample behind it must be
    small; for anything bigger work with ``context_fragments``.
    """
    fragments = context_fragments(judged)
    chars = fragments.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    if chars > max_chars:
        raise ValueError(f"{chars} characters of examples do not fit a prompt; use context_fragments")

    wrong = fragments.filter("outcome = 'wrong'")
    labels = rows_within(wrong.groupBy("label").agg(F.min("fragment").alias("at")).orderBy("at", "label"), MAX_REQUESTS)
    if labels is None:
        raise ValueError("too many classes for model requests")
    targets = constant([r.label for r in labels], "array<string>")
    place = F.coalesce(F.nullif(F.array_position(targets, F.col("label")), F.lit(0)), F.lit(len(labels) + 1))
    aimed = fragments.withColumn("place", place).select("*", F.posexplode(targets).alias("request_no", "target"))
    own = F.col("label") == F.col("target")
    role = (
        F.when(own & (F.col("outcome") == "wrong"), F.lit("cover"))
        .when(own, F.lit("covered"))
        .otherwise(F.lit("avoid"))
    )
    # texts still wrong come before those already right, then classes in order, then ids
    piece = F.struct((F.col("outcome") == "correct").alias("late"), "place", "label", "fragment", "body")
    grouped = aimed.groupBy("request_no", F.col("target").alias("label")).agg(
        *[F.sort_array(F.collect_list(F.when(role == r, piece))).alias(r) for r in ("cover", "covered", "avoid")]
    )

    def texts(column: str):
        return F.when(F.size(column) > 0, F.array_join(F.col(f"{column}.body"), "\n\n"))

    task, known, answer = request_frame(F.col("label"), dataset, wanted, existing, keyword_rules)
    return grouped.select(
        F.col("request_no").cast("int").alias("request_no"),
        "label",
        prompt(
            task,
            section("Domain", F.lit(domain_info)),
            section("Texts to cover", texts("cover")),
            section("Texts already covered", texts("covered")),
            section("Texts to avoid", texts("avoid")),
            section("Existing criteria", known),
            answer,
        ).alias("prompt"),
    )


def request_frame(
    label: Column, dataset: str, wanted: int, existing: DataFrame | None, keyword_rules: bool
) -> tuple[Column, Column, Column]:
    """What a request says around its examples: the task, the existing criteria and the form of the answer."""
    known = _existing_text(existing)
    form = (
        "a list of substrings joined by '+', all of which have to occur in the lower-cased text"
        if keyword_rules
        else "a statement that is either true or false for a text"
    )
    task = F.concat(
        F.lit(
            f"Texts of the dataset {dataset} are labelled with weak labeling functions. Write exactly {wanted} new "
            "criteria that hold for the texts to cover and for none of the texts to avoid. Class: "
        ),
        label,
    )
    answer = F.concat(
        F.lit(
            'Answer with a JSON object {"criteria": [{"criterion": name, "description": '
            f'{form}, "class": class}}]}}. The class is always '
        ),
        label,
    )
    return task, F.lit(known), answer


def _existing_text(existing: DataFrame | None) -> str | None:
    """Existing criteria as one JSON object, names to descriptions."""
    if existing is None:
        return None
    named = {r.criterion: r.description for r in existing.orderBy("ord").collect()}
    return json.dumps(named, ensure_ascii=False, indent=2) if named else None


def dedup_request(criteria: DataFrame) -> DataFrame:
    """The request that asks a model which criteria say something of their own.

    The whole list is sent, in order, with classes and with names that occur more than once.
    """
    rows = criteria.orderBy("ord").collect()
    fields = [f for f in ("criterion", "description", "class") if f in criteria.columns]
    listed = json.dumps([{f: r[f] for f in fields} for r in rows], ensure_ascii=False, indent=2)
    text = (
        "Some of the criteria below say the same. Answer with a JSON object "
        '{"unique_criteria": [names]} that names each distinct criterion once.\n\n## Criteria\n' + listed
    )
    return local_frame(criteria.sparkSession, [(0, text)], "request_no int, prompt string")
