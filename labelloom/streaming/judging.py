"""Criteria judged by a caller's model, for a table or for a growing folder of texts.

``model`` maps requests (item_id, chunk, attempt, prompt, text) to answers (item_id, chunk, content,
failed). A request that fails, or that gets no answer, is sent once more; if it fails again its item
is not judged: ``fired`` is null even if other requests of the item went well. Names are united over
the requests of an item; ``fired`` is null too when no name was found at all.

A table is asked in two passes. A stream asks the failed requests of a batch again together with the next
batch, and those of the last batch when nothing new is left; ballots do not depend on how texts
arrive. ``item_id`` must not be null and should be unique: rows of one pass that share an id share their
answers, later ones are judged anew. Null and empty texts are sent as they are. Without chunks nothing is
sent and nothing is judged.

What moves in a shuffle are ids, criterion numbers and kept columns. Texts move only for items that
wait for their second try. Answers are stored before they are used, so a batch that is run again asks nothing twice
once they are all there; a task that is lost while it asks sends its own requests again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.labeling import LabelingSet, read_answers
from labelloom.session import delete_path, numbered_folders, path_exists, release, stored
from labelloom.sizing import constant, local_frame

# Fixed value: how often a request is sent before its item counts as not judged.
ATTEMPTS = 2
_INTS = "array<int>"
_STATE = ("attempt", "open", "fired", "named")
_RESERVED = {"item_id", "text", "chunk", "prompt", "batch", "last", "votes", *_STATE}

Model = Callable[[DataFrame], DataFrame]


def none_yet() -> Column:
    return F.array().cast(_INTS)


def fresh_items(items: DataFrame, n_chunks: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items nobody was asked about: all their requests are open."""
    if clash := _RESERVED.intersection(keep):
        raise ValueError(f"kept columns need other names: {sorted(clash)}")
    known_id = F.when(F.col("item_id").isNull(), F.raise_error(F.lit("item_id is null"))).otherwise(F.col("item_id"))
    return items.select(
        known_id.alias("item_id"),
        "text",
        *keep,
        F.lit(0).alias("attempt"),
        constant(list(range(n_chunks)), _INTS).alias("open"),
        none_yet().alias("fired"),
        F.lit(False).alias("named"),
    )


def ask(
    pending: DataFrame, lfs: LabelingSet, chunks: list[str], model: Model, keep: tuple[str, ...], on_unreadable: str
) -> DataFrame:
    """The state of each item after its open requests were sent, without its text."""
    each = pending.select("item_id", F.explode("open").alias("chunk"), "attempt", "text")
    prompt = F.get(constant(chunks, "array<string>"), F.col("chunk"))
    answers = model(each.select("item_id", "chunk", "attempt", prompt.alias("prompt"), "text"))
    read = read_answers(answers, on_unreadable, ("chunk",))
    usable = F.when(~F.col("failed"), F.col("found"))
    names = read.select(
        "item_id",
        F.when(F.col("failed"), F.col("chunk")).alias("bad"),
        F.when(~F.col("failed"), F.col("chunk")).alias("good"),
        F.coalesce(F.size(usable) > 0, F.lit(False)).alias("some"),
        F.explode_outer(usable).alias("criterion"),
    )
    # a name is looked up by a hash join; unknown ones match nothing
    known = lfs.frame(pending.sparkSession).select("criterion", "lf")
    per_item = names.join(known, "criterion", "left").groupBy("item_id").agg(
        F.collect_set("lf").alias("more"),
        F.array_except(F.collect_set("good"), F.collect_set("bad")).alias("answered"),
        F.max("some").alias("some"),
    )
    joined = pending.select("item_id", *keep, *_STATE).join(per_item, "item_id", "left")
    return joined.select(
        "item_id",
        *keep,
        (F.col("attempt") + 1).alias("attempt"),
        F.array_except("open", F.coalesce("answered", none_yet())).alias("open"),
        F.sort_array(F.array_union("fired", F.coalesce("more", none_yet()))).alias("fired"),
        (F.col("named") | F.coalesce("some", F.lit(False))).alias("named"),
    )


def ended(asked: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Ballots (item_id, kept columns, fired) of the items that nothing is asked about any more."""
    complete = F.size("open") == 0
    over = asked.filter(complete | (F.col("attempt") >= ATTEMPTS))
    return over.select("item_id", *keep, F.when(complete & F.col("named"), F.col("fired")).alias("fired"))


def waiting(asked: DataFrame, pending: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Items with requests to send again, with their texts."""
    left = asked.filter((F.size("open") > 0) & (F.col("attempt") < ATTEMPTS))
    state = left.select("item_id", *_STATE).dropDuplicates(["item_id"])
    return pending.select("item_id", "text", *keep).join(state, "item_id").select("item_id", "text", *keep, *_STATE)


def judge(
    items: DataFrame,
    lfs: LabelingSet,
    chunks: list[str],
    model: Model,
    keep: tuple[str, ...] = (),
    on_unreadable: str = "fail",
) -> DataFrame:
    """Ballots (item_id, kept columns, fired) of a table; stored, the caller may ``release`` them."""
    fresh = fresh_items(items, len(chunks), keep)
    first = stored(ask(fresh, lfs, chunks, model, keep, on_unreadable), "asked")
    again = stored(waiting(first, fresh, keep), "waiting")
    second = ask(again, lfs, chunks, model, keep, on_unreadable)
    out = stored(ended(first, keep).unionByName(ended(second, keep)), "judged")
    release(first, again)
    return out


class JudgedStream:
    """Model verdicts of a growing folder, in one folder of their own.

    ``ballots/batch=N/last=0`` what batch N ended, ``last=1`` what was left when the stream ran dry;
    ``waiting/N`` items to ask again after batch N; ``asked/N`` its answers, kept until the next batch so that a batch
    run again after a lost driver asks nothing twice; ``progress`` the checkpoint of the stream. A folder is
    written by its batch alone and overwritten when the batch is run again, so nothing is stored twice. A folder belongs
    to one list of criteria and prompts; another list is refused.
    """

    def __init__(
        self,
        folder: str,
        lfs: LabelingSet,
        chunks: list[str],
        model: Model,
        keep: tuple[str, ...] = (),
        on_unreadable: str = "fail",
    ):
        self.folder, self.lfs, self.chunks, self.model = folder.rstrip("/"), lfs, chunks, model
        self.keep, self.on_unreadable = keep, on_unreadable

    def run(self, items: DataFrame) -> DataFrame:
        """Judge everything the stream ``items`` holds now, and return all ballots stored so far."""
        spark = items.sparkSession
        self._claim(spark)
        shape = fresh_items(items, len(self.chunks), self.keep).schema
        query = (
            items.select("item_id", "text", *self.keep)
            .writeStream.foreachBatch(lambda rows, number: self._batch(rows, number, shape))
            .option("checkpointLocation", f"{self.folder}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        self._run_dry(spark, shape)
        return self.ballots(items)

    def ballots(self, items: DataFrame) -> DataFrame:
        """All stored ballots (item_id, kept columns, fired); ``items`` gives the types of the columns."""
        spark = items.sparkSession
        shape = ended(fresh_items(items, len(self.chunks), self.keep), self.keep).schema
        if not path_exists(spark, f"{self.folder}/ballots"):
            return local_frame(spark, [], shape)
        return spark.read.schema(shape).parquet(f"{self.folder}/ballots").select(*shape.names)

    def finish(self, spark: SparkSession) -> None:
        """Keep the ballots only: nothing more will come."""
        for done in ("asked", "waiting", "progress", "criteria"):
            delete_path(spark, f"{self.folder}/{done}")

    def _claim(self, spark: SparkSession) -> None:
        """Note criteria and prompts in a new folder, compare them in an old one."""
        told = json.dumps([self.lfs.names, self.chunks, self.on_unreadable])
        mark = hashlib.sha256(told.encode()).hexdigest()
        path = f"{self.folder}/criteria"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            local_frame(spark, [(mark,)], "mark string").write.mode("overwrite").parquet(path)
        elif spark.read.parquet(path).first().mark != mark:
            raise ValueError(f"{self.folder} holds verdicts of other criteria or prompts")

    def _left(self, spark: SparkSession, number: int, shape) -> DataFrame:
        """Items that batch ``number`` left to ask again."""
        path = f"{self.folder}/waiting/{number}"
        if not path_exists(spark, f"{path}/_SUCCESS") or path_exists(spark, f"{self._ended(number, 1)}/_SUCCESS"):
            return local_frame(spark, [], shape)
        return spark.read.schema(shape).parquet(path)

    def _ended(self, number: int, last: int) -> str:
        return f"{self.folder}/ballots/batch={number}/last={last}"

    def _ask_once(self, pending: DataFrame, name: str) -> DataFrame:
        """The answers stored under ``name``, asked for if they are not there yet."""
        spark, path = pending.sparkSession, f"{self.folder}/asked/{name}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            state = ask(pending, self.lfs, self.chunks, self.model, self.keep, self.on_unreadable)
            state.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def _batch(self, rows: DataFrame, number: int, shape) -> None:
        spark = rows.sparkSession
        left = self._left(spark, number - 1, shape)
        if not path_exists(spark, f"{self._ended(number - 1, 1)}/_SUCCESS"):
            # a last round that broke off is taken over by this batch
            delete_path(spark, self._ended(number - 1, 1))
        pending = fresh_items(rows, len(self.chunks), self.keep).unionByName(left)
        asked = self._ask_once(pending, str(number))
        waiting(asked, pending, self.keep).write.mode("overwrite").parquet(f"{self.folder}/waiting/{number}")
        ended(asked, self.keep).write.mode("overwrite").parquet(self._ended(number, 0))
        # the batch before is committed, or this one would not run
        for done in (f"asked/{number - 1}", f"asked/{number - 1}-last", f"waiting/{number - 2}"):
            delete_path(spark, f"{self.folder}/{done}")

    def _run_dry(self, spark: SparkSession, shape) -> None:
        """Send what the last batch left to send again; nothing is open afterwards."""
        numbers = numbered_folders(spark, f"{self.folder}/waiting")
        if not numbers:
            return
        number = max(numbers)
        left = self._left(spark, number, shape)
        if not left.isEmpty():
            asked = self._ask_once(left, f"{number}-last")
            ended(asked, self.keep).write.mode("overwrite").parquet(self._ended(number, 1))
        for done in (f"asked/{number}", f"asked/{number}-last"):
            delete_path(spark, f"{self.folder}/{done}")
