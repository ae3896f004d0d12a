"""Prompts for a language model, in bounded batches, and what becomes of the answers. The model itself is a function that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import bands
from tallyloom.operators import ordered, textguard

# fixed values: prompts in a request, characters of one, tokens of an answer
BATCH, CHARACTERS, TOKENS = 16, 8000, 1024


def identity(theme: Column, code: Column, parent_code: Column, description: Column, parent_description: Column, skill: Column) -> Column:
    """What an outcome is, for search: its useful parts joined by " - ", equal descriptions once."""
    said = F.array_distinct(F.array(description, parent_description))
    every = F.concat(F.array(theme, code, parent_code), said, F.array(skill))
    return F.array_join(F.filter(every, lambda x: F.coalesce(x, F.lit("")) != ""), " - ")


def weak(outcomes: DataFrame) -> DataFrame:
    """Outcomes to ask about, with severity: rate below WEAK, a program and a theme are there."""
    asked = outcomes.where((F.col("rate") < bands.WEAK) & F.col("program").isNotNull() & (F.coalesce("theme", F.lit("")) != ""))
    return asked.withColumn("severity", bands.severity(F.col("rate")))


def anomaly_prompt(questions: DataFrame) -> DataFrame:
    """exam, prompt: question-level results of exams with three questions or more; no student's row is in it."""
    note = F.when(F.coalesce("cells", F.lit(0)) > 0, F.format_string(", düzeltme: %d", F.col("cells").cast("int"))).otherwise(F.lit(""))
    line = F.concat(F.format_string("- Soru %d: azami %s puan, başarı oranı %%%d", F.col("question").cast("int"), F.col("max_score").cast("string"), F.bround(F.col("rate") * 100, 0).cast("int")), note)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("question", line.alias("line")))), lambda x: x["line"])
    return questions.groupBy("exam").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("prompt")).where("n >= 3").drop("n")


def rejected(prompts: DataFrame) -> DataFrame:
    """name, reason of prompts(name, system, user) that aren't sent: empty or too long ones."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(blank("system") | blank("user"), "empty").when((F.length("system") > CHARACTERS) | (F.length("user") > CHARACTERS), "too long")
    return prompts.withColumn("reason", reason).where("reason is not null").select("name", "reason")


def answered(prompts: DataFrame, model: Callable[[list[tuple[str, str]]], list[str]], batch: int = BATCH) -> DataFrame:
    """name, answer of prompts(name, system, user): the model gets lists of at most batch prompts and must answer each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                said = model(list(zip(part["system"], part["user"], strict=True)))
                if len(said) != len(part):
                    raise ValueError(f"{len(said)} answers for {len(part)} prompts")
                yield pd.DataFrame({"name": part["name"].to_numpy(), "answer": said})

    fine = prompts.join(rejected(prompts).select("name"), "name", "left_anti")
    return fine.select("name", "system", "user").mapInPandas(run, "name string, answer string")


def queued(prompts: DataFrame, batch: int = BATCH, cap: int = TOKENS) -> DataFrame:
    """name, system, user, batch and place (both from 0) and batch_tokens of prompts(name, system, user, tokens) that rejected() lets through.

    The queue is in the order of name and user; each batch but the last is full, whatever the partitions. batch_tokens is what the batch may answer with: the most that one of it asks for, up to
    cap. The numbering is of all rows, without one task for them.
    """
    why = rejected(prompts.select("name", "system", "user")).select("name")
    fine = prompts.join(why, "name", "left_anti").select("name", "system", "user", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    rows = ordered.running(fine, [], ["name", "user", "system", "tokens"], F.lit(1), "n").withColumn("n", F.col("n") - 1)
    rows = rows.withColumns({"batch": F.floor(F.col("n") / batch), "place": (F.col("n") % batch).cast("int")})
    most = F.max("tokens").over(Window.partitionBy("batch"))
    return rows.select("name", "system", "user", "batch", "place", F.least(F.lit(cap), most).alias("batch_tokens"))


def flushed(queue: DataFrame, model: Callable[[list[tuple[str, str]], int], list[str]]) -> DataFrame:
    """name, batch, place, answer, error of queued() prompts: the model gets each batch in one call, with its tokens, and must answer each of its prompts in their order.

    A call that fails, or answers another number of prompts, leaves its batch without answers and with the error; other batches have theirs.
    """

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        try:
            said, error = list(model(list(zip(rows["system"], rows["user"], strict=True)), int(rows["batch_tokens"].iloc[0]))), None
            if len(said) != len(rows):
                raise ValueError(f"{len(said)} answers for {len(rows)} prompts")
        except Exception as failure:  # of one batch: told in its rows
            said, error = [None] * len(rows), f"{type(failure).__name__}: {failure}"[:200]
        return pd.DataFrame({"name": rows["name"], "batch": rows["batch"], "place": rows["place"], "answer": said, "error": error})

    return queue.groupBy("batch").applyInPandas(ask, f"name {dict(queue.dtypes)['name']}, batch long, place int, answer string, error string")


def returned(owners: DataFrame, answers: DataFrame) -> DataFrame:
    """owners(owner, name) with answer and error by name: owners of prompts that weren't sent or answered have null; rounds' counts are a groupBy away."""
    return owners.join(answers.select("name", "answer", "error"), "name", "left")


def published(owners: DataFrame, answers: DataFrame, hits: DataFrame, refusal: str) -> DataFrame:
    """owners(name, rate, codes, component, description) with answer and reason: published, no result, no source, refused, prescribes or scope.

    Answers without sources in hits(name), that open with the refusal or break the contract are left out; sentences that prescribe are cut.
    """
    sourced = hits.select("name").distinct().withColumn("sourced", F.lit(True))
    rows = owners.join(answers, "name", "left").join(sourced, "name", "left")
    kept, dropped = textguard.without_sentences(F.col("answer"))
    rows = rows.withColumns({"kept": kept, "dropped": dropped})
    scope = textguard.in_scope(F.col("kept"), F.col("rate"), F.col("codes"), F.col("component"), F.col("description"))
    reason = F.when(F.col("answer").isNull(), "no result").when(F.col("sourced").isNull(), "no source").when(F.trim("answer").startswith(refusal), "refused").when(F.col("kept") == "", "prescribes").when(~scope, "scope").otherwise(F.lit("published"))
    return rows.withColumn("reason", reason).select("name", F.when(F.col("reason") == "published", F.col("kept")).otherwise(F.lit("")).alias("answer"), "reason", "dropped")


def tokens(requested: Column, cap: int = TOKENS) -> Column:
    """Tokens that a batch of prompts may answer with: the most that one asks for, up to cap."""
    return F.least(F.lit(cap), F.max(requested))
