"""Work over pages in rounds: retries, the deterministic pass and the loop of gate and fixes. Outcomes are rows, so a lost run resumes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout_json import coverage


def retried(todo: DataFrame, key: list[str], worker: Callable[[DataFrame], DataFrame], retries: int = 1, save: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """key, status, retry_count, error of every row of todo after at most 1 + retries rounds of worker.

    worker: rows to (key, ok, error), any number at a time. Those that fail go to the end of the queue, which is the next
    round; rows that it returns nothing for count as failed. save keeps a round, by a table where executors may be lost.
    """
    queue, done = todo, None
    for k in range(retries + 1):
        answers = worker(queue).select(*key, "ok", "error")
        round_ = save(queue.select(*key).join(answers, key, "left").withColumn("ok", F.coalesce("ok", F.lit(False))))
        failed = round_.filter("not ok")
        ended = round_ if k == retries else round_.filter("ok")
        status = F.when(F.col("ok"), "completed").otherwise("failed")
        part = ended.select(*key, status.alias("status"), F.when(F.col("ok"), k).otherwise(k + 1).alias("retry_count"), F.when(~F.col("ok"), F.col("error")).alias("error"))
        done = part if done is None else done.unionByName(part)
        if k == retries or not failed.limit(1).count():
            break
        queue = todo.join(failed.select(*key), key, "left_semi")
    return done


def page_states(attempts: DataFrame, key: list[str], order: str, retries: int = 1) -> DataFrame:
    """key, status, retry_count, attempts of the state machine over attempts (order, ok): pending again after a failure until retries are used up.

    Attempts after a page is completed or failed count for nothing.
    """
    seen = attempts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, "ok"))).alias("all"))
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("retry_count"))

    def step(a, x):
        over = F.when(x["ok"], F.struct(F.lit("completed").alias("status"), a["retry_count"].alias("retry_count"))).otherwise(F.struct(F.when(a["retry_count"] + 1 <= retries, "pending").otherwise("failed").alias("status"), (a["retry_count"] + 1).alias("retry_count")))
        return F.when(a["status"] == "pending", over).otherwise(a)

    return seen.select(*key, F.aggregate("all", start, step).alias("s"), F.size("all").alias("attempts")).select(*key, "s.*", "attempts")


def deterministic_pass(pages: DataFrame, key: list[str], least: float = 0.6, llm: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(manifests, worklist) of pages (mode, reason, has_vector, original, rebuilt, done).

    Pages done before are in neither. A text page with fills or a frame, or whose rebuilt text covers too few of the original's words, goes to the
    worklist, unless llm is none; so do pages routed to it. A page without rebuilt text where one is needed fails.
    """
    vector = (F.col("mode") == "text") & F.col("has_vector") & (F.lit(llm) == "auto")
    share = coverage(F.col("original"), F.col("rebuilt"))
    rows = pages.filter("not done").select(*key, "mode", "reason", "original", vector.alias("vector"), share.alias("coverage"))
    thin = (F.col("mode") == "text") & ~F.col("vector") & (F.col("coverage") < least)
    reason = F.when(F.col("vector"), F.concat(F.lit("vector fills/frame present ("), "reason", F.lit(")"))).when(thin, F.concat(F.lit("low fidelity: "), F.round(F.col("coverage") * 100).cast("int"), F.lit("%"))).otherwise(F.col("reason"))
    rows = rows.select(*key, "mode", reason.alias("reason"), "coverage", (thin | F.col("vector") | (F.col("mode") == "llm")).alias("hard"), F.length("original").cast("long").alias("chars"))
    hard = F.col("hard") & (F.lit(llm) != "none")
    made = rows.filter(~hard).select(*key, F.lit("completed").alias("status"), F.lit("text").alias("mode"), F.when(F.col("hard"), F.concat("reason", F.lit(" (unverified)"))).otherwise(F.col("reason")).alias("reason"), "chars", "coverage")
    work = rows.filter(hard).select(*key, F.lit("needs_llm").alias("status"), "reason", "chars", "coverage")
    return made, work


def fixed(pages: DataFrame, gate: Callable[[DataFrame], DataFrame], fix: Callable[[DataFrame, DataFrame], DataFrame], rounds: int = 2, save: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> tuple[DataFrame, DataFrame]:
    """(pages, hints left) of the loop: gate tells pages to hints, fix tells pages and hints to pages, until no hint is left or the rounds are over."""
    hints = save(gate(pages))
    for _ in range(rounds):
        if not hints.limit(1).count():
            break
        pages = save(fix(pages, hints))
        hints = save(gate(pages))
    return pages, hints
