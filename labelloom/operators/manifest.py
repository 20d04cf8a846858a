"""Requests for criteria as references to a shared store of texts.

A request for a class shows texts to cover (its own that are still wrong), texts already covered and texts to
avoid (all of the other classes). Written out, the texts to avoid are copied once per class. Here all texts
are laid out once, in the order every request shows them: first the wrong ones, then the correct ones, in both by
class and item. The order is cut into blocks of about ``block_chars`` characters of one class and outcome. A
request is then at most five ranges of blocks, whatever the number of texts: its own two groups, and what lies
before, between and after them. ``rendered`` writes prompts out when a model is to read them, one block each.

Rows without text or label can't be shown; the manifest counts them. Empty texts are shown. Block numbers
ascend but may have gaps: a fragment longer than ``block_chars`` passes over some. Item ids have to be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions.text import prompt, section
from labelloom.operators.generation import IDS_PER_FRAGMENT, context_fragments, request_frame
from labelloom.session import release, stored

BLOCK_CHARS = 200_000
# Fragments whose sizes are summed before the sums of a whole class are.
FRAGMENTS_PER_SPAN = 4_096
_GROUP = ("outcome", "label")
_GAP = len("\n\n")


def block_store(
    judged: DataFrame, block_chars: int = BLOCK_CHARS, ids_per_fragment: int = IDS_PER_FRAGMENT
) -> tuple[DataFrame, DataFrame]:
    """Blocks (outcome, label, part, n_texts, n_chars, body) of ``judged``, and their groups.

    Sizes are summed per span of fragments, then over the spans of a class, so that a class with most
    of the texts isn't summed in one task. Only sizes are windowed; bodies meet their block by key. Both
    are stored tables that the caller may ``release``.
    """
    fragments = stored(
        context_fragments(judged, ids_per_fragment).withColumn("n_chars", F.length("body") + F.lit(_GAP)), "fragments"
    )
    sizes = fragments.select(*_GROUP, "fragment", "n_chars", F.expr(f"fragment div {FRAGMENTS_PER_SPAN}").alias("span"))
    spans = sizes.groupBy(*_GROUP, "span").agg(F.sum("n_chars").alias("chars"))
    earlier = W.partitionBy(*_GROUP).orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(*_GROUP, "span", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("span_start"))
    inside = W.partitionBy(*_GROUP, "span").orderBy("fragment").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("span_start") + F.coalesce(F.sum("n_chars").over(inside), F.lit(0))
    placed = sizes.join(spans, [*_GROUP, "span"]).select(
        *_GROUP, "fragment", F.floor(start / F.lit(int(block_chars))).cast("bigint").alias("part")
    )
    rows = F.sort_array(F.collect_list(F.struct("fragment", "body")))
    blocks = stored(
        fragments.join(placed, [*_GROUP, "fragment"])
        .groupBy(*_GROUP, "part")
        .agg(F.sum("n_texts").alias("n_texts"), F.sum("n_chars").cast("bigint").alias("n_chars"), rows.alias("rows"))
        .select(*_GROUP, "part", "n_texts", "n_chars", F.array_join("rows.body", "\n\n").alias("body")),
        "blocks",
    )
    first_wrong = fragments.filter("outcome = 'wrong'").groupBy("label").agg(F.min("fragment").alias("first_wrong"))
    groups = stored(context_groups(blocks, first_wrong), "groups")
    release(fragments)
    return blocks, groups


def context_groups(blocks: DataFrame, first_wrong: DataFrame) -> DataFrame:
    """One row per class and outcome: its place, its range of blocks, its texts and those before it.

    Classes come in the order of their first wrong fragment, those without one last. The windows run over one or two rows per class.
    """
    groups = blocks.groupBy(*_GROUP).agg(
        (F.max("part") + 1).alias("size"), F.sum("n_texts").alias("n_texts"), F.sum("n_chars").alias("n_chars")
    )
    placed = groups.join(first_wrong, "label", "left")
    order = W.orderBy(F.col("outcome") == "correct", F.col("first_wrong").asc_nulls_last(), "label")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)

    def before(column: str):
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    return placed.select(
        *_GROUP,
        (F.row_number().over(order) - 1).alias("place"),
        before("size").alias("first_block"),
        (before("size") + F.col("size")).alias("end_block"),
        before("n_texts").alias("texts_before"),
        "n_texts",
        before("n_chars").alias("chars_before"),
        "n_chars",
        *[F.sum(c).over(W.partitionBy()).alias(f"all_{c}") for c in ("size", "n_texts", "n_chars")],
    )


def request_manifest(groups: DataFrame, judged: DataFrame) -> DataFrame:
    """Ranges (request_no, label, role, range_no, first_block, end_block, n_texts, n_chars, n_unusable), ends exclusive.

    One request per class with texts to cover. ``n_unusable`` are the judged rows without text or label.
    """
    unusable = judged.agg(F.count_if(F.col("text").isNull() | F.col("label").isNull())).first()[0]
    marks = ("first_block", "end_block", "texts_before", "n_texts", "chars_before", "n_chars")
    own = groups.filter("outcome = 'wrong'")
    covered = groups.filter("outcome = 'correct'").select("label", F.struct(*marks).alias("covered"))
    both = own.join(covered, "label", "left")
    end = F.struct(
        F.col("all_size").alias("first_block"),
        F.col("all_size").alias("end_block"),
        F.col("all_n_texts").alias("texts_before"),
        F.lit(0).cast("bigint").alias("n_texts"),
        F.col("all_n_chars").alias("chars_before"),
        F.lit(0).cast("bigint").alias("n_chars"),
    )
    both = both.withColumn("covered", F.coalesce("covered", end)).withColumn("cover", F.struct(*marks))

    def point(group: str, after: bool) -> dict:
        if not after:
            return {"block": F.col(f"{group}.first_block"), "texts": F.col(f"{group}.texts_before"), "chars": F.col(f"{group}.chars_before")}
        return {
            "block": F.col(f"{group}.end_block"),
            "texts": F.col(f"{group}.texts_before") + F.col(f"{group}.n_texts"),
            "chars": F.col(f"{group}.chars_before") + F.col(f"{group}.n_chars"),
        }

    start = {k: F.lit(0).cast("bigint") for k in ("block", "texts", "chars")}
    stop = {"block": F.col("all_size"), "texts": F.col("all_n_texts"), "chars": F.col("all_n_chars")}
    cover, covered_range = (point("cover", False), point("cover", True)), (point("covered", False), point("covered", True))
    ranges = [
        ("cover", 0, *cover),
        ("covered", 0, *covered_range),
        ("avoid", 0, start, cover[0]),
        ("avoid", 1, cover[1], covered_range[0]),
        ("avoid", 2, covered_range[1], stop),
    ]
    listed = [
        F.struct(
            F.lit(role).alias("role"),
            F.lit(number).alias("range_no"),
            low["block"].cast("bigint").alias("first_block"),
            high["block"].cast("bigint").alias("end_block"),
            (high["texts"] - low["texts"]).cast("bigint").alias("n_texts"),
            (high["chars"] - low["chars"]).cast("bigint").alias("n_chars"),
        )
        for role, number, low, high in ranges
    ]
    exploded = both.select(F.col("place").alias("request_no"), "label", F.inline(F.array(*listed)))
    return exploded.filter("n_texts > 0").withColumn("n_unusable", F.lit(unusable).cast("bigint"))


def numbered_blocks(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """Blocks under the numbers that the manifest uses: block, outcome, label, n_texts, n_chars, body."""
    starts = groups.select(*_GROUP, "first_block")
    number = (F.col("first_block") + F.col("part")).cast("bigint").alias("block")
    return blocks.join(starts, list(_GROUP)).select(number, *_GROUP, "n_texts", "n_chars", "body")


def rendered(
    manifest: DataFrame,
    numbered: DataFrame,
    dataset: str,
    wanted: int = 5,
    existing: DataFrame | None = None,
    domain_info: str | None = None,
    keyword_rules: bool = True,
) -> DataFrame:
    """Prompts (request_no, label, role, block, prompt), one per request and block, none longer than a block and its frame.

    Every class reads every block, so this grows with classes times texts; filter the manifest to the requests to send.
    """
    wide = manifest.select(
        "request_no", F.col("label").alias("target"), "role", F.explode(F.sequence("first_block", F.col("end_block") - 1)).alias("block")
    )
    task, known, answer = request_frame(F.col("target"), dataset, wanted, existing, keyword_rules)
    titles = {"cover": "Texts to cover", "covered": "Texts already covered", "avoid": "Texts to avoid"}
    shown = [section(title, F.when(F.col("role") == role, F.col("body"))) for role, title in titles.items()]
    text = prompt(task, section("Domain", F.lit(domain_info)), *shown, section("Existing criteria", known), answer)
    joined = wide.join(numbered.select("block", "body"), "block")
    return joined.select("request_no", F.col("target").alias("label"), "role", "block", text.alias("prompt"))
