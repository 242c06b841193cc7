"""From ratings to preference pairs and training examples, and the routing of generated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.rules import RulePack, augment_reason, first_reason
from corvane.operators.corpus import first_wins, last_wins, replicate


def rated_pairs(ratings: DataFrame, generations: DataFrame, poison: str, spam: str, exclude_held_out: bool = False) -> DataFrame:
    """Every rating with `reason`: null where it makes a pair (prompt, chosen, rejected), else the first of
    tie, missing_gen, identical, poison_context, poison_chosen, poison_rejected, duplicate and, if asked for,
    held_out.

    ratings: pos, version_a, version_b, prompt_id, winner, category, tier.  generations: version, id, pos,
    context, response, held_out; of several with one id the last counts.  Any winner but A and tie is B's."""
    last = last_wins(generations.withColumn("__k", F.concat_ws("\x00", "version", "id")), "__k").drop("__k", "pos")
    side = lambda s: last.select(F.col("version").alias(f"version_{s}"), F.col("id").alias("prompt_id"), F.col("response").alias(f"response_{s}"), F.col("context").alias(f"context_{s}"), F.col("held_out").alias(f"held_out_{s}"))
    rows = ratings.join(side("a"), ["version_a", "prompt_id"], "left").join(side("b"), ["version_b", "prompt_id"], "left")
    a_wins = F.col("winner") == "A"
    rows = rows.withColumn("chosen", F.when(a_wins, F.col("response_a")).otherwise(F.col("response_b")))
    rows = rows.withColumn("rejected", F.when(a_wins, F.col("response_b")).otherwise(F.col("response_a")))
    rows = rows.withColumn("context", F.coalesce("context_a", "context_b"))
    bad = lambda c: c.rlike(poison) | c.rlike(spam)
    cases = [
        (F.col("winner") == "tie", "tie"),
        (F.col("response_a").isNull() | F.col("response_b").isNull(), "missing_gen"),
        (F.col("chosen") == F.col("rejected"), "identical"),
        (F.exists("context", bad), "poison_context"),
        (bad(F.col("chosen")), "poison_chosen"),
        (bad(F.col("rejected")), "poison_rejected"),
    ]
    if exclude_held_out:
        cases.insert(1, (F.coalesce("held_out_a", "held_out_b"), "held_out"))
    return _mark_duplicates(rows.withColumn("reason", first_reason(*cases)), F.struct("prompt_id", "chosen", "rejected"))


def _mark_duplicates(rows: DataFrame, key: Column, order: str = "pos") -> DataFrame:
    """reason 'duplicate' for the later rows of a key among those without a reason."""
    w = Window.partitionBy(F.col("reason").isNull(), key).orderBy(order)
    n = F.row_number().over(w)
    return rows.withColumn("__n", n).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("__n") > 1), "duplicate").otherwise(F.col("reason"))).drop("__n")


def reasons(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows each reason took, 'kept' among them."""
    return rows.groupBy(*by, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def candidate(candidates: str, idx: Column) -> Column:
    """The candidate of that idx, null if none."""
    return F.try_element_at(F.filter(candidates, lambda c: c["idx"] == idx), F.lit(1))


def best_vs_rest(ratings: DataFrame, generations: DataFrame, poison: str) -> DataFrame:
    """One row per rating and other candidate, with reason as in rated_pairs (no_winner, missing_gen,
    missing_best, poison_context, poison_chosen, poison_rejected, identical, duplicate); ratings that fail have one row.

    ratings: pos, prompt_id, best_candidate_idx, decision; generations: id, pos, context, candidates."""
    last = last_wins(generations, "id").select(F.col("id").alias("prompt_id"), "context", "candidates")
    rows = ratings.join(last, "prompt_id", "left").withColumn("best", candidate("candidates", F.col("best_candidate_idx")))
    bad = lambda c: F.coalesce(c.rlike(poison), F.lit(False))
    rows = rows.withColumn(
        "reason",
        first_reason(
            (F.coalesce("decision", F.lit("best")) != "best", "no_winner"),
            (F.col("candidates").isNull(), "missing_gen"),
            (F.col("best").isNull(), "missing_best"),
            (F.exists("context", bad), "poison_context"),
            (bad(F.col("best.response")), "poison_chosen"),
        ),
    )
    others = F.filter("candidates", lambda c: c["idx"] != F.col("best_candidate_idx"))
    rows = rows.withColumn("other", F.explode_outer(F.when(F.col("reason").isNull(), others)))
    later = first_reason((F.col("other").isNull(), "no_other"), (bad(F.col("other.response")), "poison_rejected"), (F.col("other.response") == F.col("best.response"), "identical"))
    rows = rows.withColumn("reason", F.coalesce("reason", later)).withColumn("chosen", F.col("best.response")).withColumn("rejected", F.col("other.response"))
    return _mark_duplicates(rows, F.struct("prompt_id", "chosen", "rejected"), order="pos").drop("best", "other", "candidates")


def preference_rows(pairs: DataFrame, source: str) -> DataFrame:
    """Kept pairs as {prompt, chosen, rejected} message lists."""
    message = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    return pairs.where("reason IS NULL").select(
        message("user", F.array_join("context", "\n")).alias("prompt"), message("assistant", F.col("chosen")).alias("chosen"),
        message("assistant", F.col("rejected")).alias("rejected"), "prompt_id", "category", F.coalesce("tier", F.lit("normal")).alias("tier"), F.lit(source).alias("source"),
    )


def augment(pairs: DataFrame, poison: str, spam: str, repeats: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(training examples, all pairs with reason) from preference pairs (pos, prompt, chosen, tier): filtered by
    the first reason, deduplicated, and repeated by tier (1 where a tier is not named)."""
    said = F.element_at("chosen", 1)["content"]
    all_of = F.array_join(F.transform(F.concat("prompt", "chosen"), lambda m: m["content"]), "\n")
    rows = pairs.withColumn("reason", augment_reason(said, all_of.rlike(poison), spam))
    rows = _mark_duplicates(rows, X.message_key(F.concat("prompt", "chosen")))
    times = F.lit(1)
    for tier, n in repeats.items():
        times = F.when(F.col("tier") == tier, F.lit(n)).otherwise(times)
    kept = rows.where("reason IS NULL").withColumn("messages", F.concat("prompt", "chosen"))
    return replicate(kept, times), rows


def unrated(generations: DataFrame, ratings: DataFrame, key: str = "prompt_id", generated: str = "id") -> DataFrame:
    done = ratings.where(F.col(key).isNotNull()).select(F.col(key).alias(generated)).distinct()
    return generations.join(done, generated, "left_anti")


def rateable(multi: DataFrame, bestof: DataFrame, ratings: DataFrame) -> DataFrame:
    """Prompts that both runs have and that are not rated."""
    return unrated(multi.join(bestof.select("id"), "id", "left_semi"), ratings)


def resume(prompts: DataFrame, accepted: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Prompts that no accepted row (prompt_id, or _meta.prompt_id) is for."""
    done = accepted.select(F.coalesce(F.col("_meta.prompt_id"), F.col("prompt_id")).alias(key)).where(F.col(key).isNotNull()).distinct()
    return prompts.join(done, key, "left_anti")


def grid(prompts: DataFrame, *choices: DataFrame) -> DataFrame:
    """Prompts with every combination of literal choices (models, efforts, candidate numbers, parameters).  Each
    choice is a configuration table of a handful of rows; over CHOICES of them is refused."""
    for c in choices:
        if c.limit(CHOICES + 1).count() > CHOICES:
            raise ValueError(f"a choice has over {CHOICES} rows: join tables by key instead")
        prompts = prompts.crossJoin(F.broadcast(c))
    return prompts


CHOICES = 1000


def route(generated: DataFrame, rules: RulePack) -> DataFrame:
    """Generated rows (content, error) with cleaned, changes, status and reject_reason.  A null content is a
    failure (empty_content), as is an error; '' and what the rules name is rejected; the rest is accepted."""
    rows = generated.withColumn("__n", X.normalize_response(F.col("content")))
    rows = rows.withColumn("cleaned", F.col("__n.cleaned")).withColumn("changes", F.col("__n.changes")).drop("__n")
    failed = first_reason((F.col("error").isNotNull(), "error"), (F.col("content").isNull(), "empty_content"))
    reject = F.when(failed.isNull(), rules.reason(F.col("cleaned")))
    status = F.when(failed.isNotNull(), "failures").when(reject.isNotNull(), "rejected").otherwise("accepted")
    return rows.withColumn("failure", failed).withColumn("reject_reason", reject).withColumn("status", status)


def settle_attempts(routed: DataFrame, key: list[str], order: str = "attempt") -> DataFrame:
    """Of several attempts at a key the first accepted one, else the last."""
    good = F.col("status") == "accepted"
    w = Window.partitionBy(*key).orderBy(F.when(good, 0).otherwise(1), F.when(good, F.col(order)).otherwise(-F.col(order)))
    return routed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def promote(rejected: DataFrame, accepted: DataFrame, allowed: list[str], order: str = "pos") -> DataFrame:
    """Rejected rows of an allowed reason to append to the accepted: not for a prompt that is there, and once
    for each prompt; rows without a prompt_id are never duplicates."""
    rows = rejected.where(F.col("reject_reason").isin(allowed))
    rows = rows.join(accepted.where("prompt_id IS NOT NULL").select("prompt_id").distinct(), "prompt_id", "left_anti")
    return first_wins(rows.where("prompt_id IS NOT NULL"), "prompt_id", order).union(rows.where("prompt_id IS NULL"))


def retry_prompts(failures: DataFrame, order: str = "pos") -> DataFrame:
    """The first row for each prompt to try again, the id being the prompt's without a candidate suffix; a row
    without one gets a hash of its text."""
    key = F.coalesce("_retry_prompt_id", "prompt_id", F.concat(F.lit("distill_"), F.substring(F.md5(F.col("user_context").cast("binary")), 1, 12)))
    return first_wins(failures.withColumn("retry_id", F.regexp_replace(key, r"(_cand\d+)+\z", "")), "retry_id", order)


def last_exchange(conversation_messages: Column) -> Column:
    """{context, original}: the user turn before the last assistant turn, and that turn."""
    n = F.size(conversation_messages)
    at = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(F.try_element_at(conversation_messages, i)["role"] == "assistant", i)))
    before = F.when(at > 1, F.element_at(conversation_messages, F.greatest(at - 1, F.lit(1)))["content"])
    return F.struct(before.alias("user_context"), F.when(at.isNotNull(), F.try_element_at(conversation_messages, at)["content"]).alias("original_assistant"))
