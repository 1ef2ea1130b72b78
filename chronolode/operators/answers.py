"""Answers: dated prices, gates, validation of citations, transcripts, traces, graded cases."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolode.functions import numbers as nm
from chronolode.functions import text as tx
from chronolode.operators.temporal import contains

MIN_SCORE = 0.02
SNIPPET = 400
HISTORY = 6


class UnknownRate(LookupError):
    """A model without a rate on the day of its use."""


class Completer(ABC):
    """A language model behind one call; answers come back as (text, refused, cited ids and quotes)."""

    @abstractmethod
    def complete(self, system: str, prompt: str) -> dict: ...


class Reranker(ABC):
    @abstractmethod
    def rerank(self, hits: DataFrame, k: int) -> DataFrame: ...


class Passthrough(Reranker):
    """The first k as they are."""

    def rerank(self, hits: DataFrame, k: int) -> DataFrame:
        return hits.filter(F.col("rank") <= k)


def priced(usage: DataFrame, rates: DataFrame, *, strict: bool = True) -> DataFrame:
    """Adds cost to usage(model, day, fresh, cache_write, cache_read, output) by rates(model, input_rate, output_rate,
    effective_from, effective_to); of several that cover a day the earliest. strict: a use without a rate is an error
    when the row is computed; otherwise its cost is null."""
    r = rates.select(F.col("model").alias("r_model"), "input_rate", "output_rate", F.col("effective_from").alias("r_from"), F.col("effective_to").alias("r_to"))
    rows = usage.withColumn("_row", F.monotonically_increasing_id()) if "usage_id" not in usage.columns else usage.withColumn("_row", F.col("usage_id"))
    joined = rows.join(r, (F.col("model") == F.col("r_model")) & contains(F.col("day"), F.col("r_from"), F.col("r_to")), "left")
    one = joined.groupBy("_row", *usage.columns).agg(F.min_by(F.struct("input_rate", "output_rate"), "r_from").alias("rate"))
    cost = nm.price(F.col("fresh"), F.col("cache_write"), F.col("cache_read"), F.col("output"), F.col("rate.input_rate"), F.col("rate.output_rate"))
    if strict:
        cost = F.when(F.col("rate").isNull(), F.raise_error(F.concat(F.lit("no rate for "), F.col("model"), F.lit(" on "), F.col("day").cast("string"))).cast("decimal(18,6)")).otherwise(cost)
    return one.withColumn("cost", cost).drop("rate", "_row")


def ledger(costs: DataFrame, key: str) -> DataFrame:
    """Cost by run, and of all under null."""
    return costs.rollup(key).agg(F.sum("cost").alias("total"))


def gate(hits: DataFrame, queries: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """(qid, passed, reason): refused without a hit, or if the best score is too low."""
    best = hits.groupBy("qid").agg(F.max("score").alias("top"))
    reason = F.when(F.col("top").isNull(), "no_admissible_source").when(F.col("top") < least, "low_confidence").otherwise("")
    return queries.select("qid").join(best, "qid", "left").select("qid", (reason == "").alias("passed"), reason.alias("reason"))


def validate(refs: DataFrame, retrieved: DataFrame, admissible: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(answer, id, check): each cited id of refs(answer, pos, id, quote) once, its first mention, with the first check
    that it fails, or ok: exists (in corpus, where given), retrieved (answer, id, text), admissible (id), quote."""
    first = Window.partitionBy("answer", "id").orderBy("pos")
    r = refs.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    r = r.join(retrieved.select("answer", "id", F.col("text").alias("_text"), F.lit(True).alias("_shown")), ["answer", "id"], "left")
    r = r.join(admissible.select("id").distinct().withColumn("_adm", F.lit(True)), "id", "left")
    known = F.lit(True)
    if corpus is not None:
        r, known = r.join(corpus.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left"), F.col("_known").isNotNull()
    check = (F.when(~known, "exists").when(F.col("_shown").isNull(), "retrieved").when(F.col("_adm").isNull(), "admissible")
             .when(F.coalesce(tx.quotes(F.col("_text"), F.col("quote")), F.lit(False)), "ok").otherwise("quote"))
    return r.select("answer", "id", check.alias("check"))


def answers_hold(checks: DataFrame) -> DataFrame:
    """(answer, ok, cited): one failed citation fails the whole answer."""
    return checks.groupBy("answer").agg(F.bool_and(F.col("check") == "ok").alias("ok"), F.count(F.lit(1)).alias("cited"))


def status(text: Column, gate_reason: Column, refused: Column, malformed: Column, kind: Column, cited: Column, valid: Column) -> Column:
    """Where a question ends, in the order in which it is decided."""
    return (F.when(tx.intent(text) == "greeting", "greeting").when(gate_reason != "", gate_reason).when(refused, "provider_refusal").when(malformed, "malformed")
            .when(kind == "out_of_scope", "out_of_scope").when((kind == "insufficient") | (cited == 0), "insufficient_evidence").when(~valid, "citation_failed").otherwise("answered"))


def ruptures(turns: DataFrame) -> DataFrame:
    """Adds to turns(conv_id, turn, as_of) whether the date is the previous turn's, else the way it moved."""
    before = F.lag("as_of").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = turns.withColumn("previous", before)
    same = F.coalesce(F.col("previous") == F.col("as_of"), F.lit(False))
    moved = F.when(F.col("previous").isNull() | same, "").when(F.col("as_of") < F.col("previous"), "earlier").otherwise("later")
    return t.withColumns({"continuation": same, "rupture": moved})


def rupture_label(n: Column, moved: Column) -> Column:
    some = F.concat(F.lit("· "), n.cast("string"), F.when(n == 1, " amendment ").otherwise(" amendments "), moved)
    return F.when(moved == "", "").when(n == 0, "· no amendments in between").otherwise(some)


def latest(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """The n newest turns of each conversation, oldest first by place."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)
    return t.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("back")


def next_turn(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, next): one beyond the last turn, 0 without any."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return conversations.select("conv_id").distinct().join(last, "conv_id", "left").select("conv_id", F.coalesce(F.col("last") + 1, F.lit(0)).alias("next"))


def history(turns: DataFrame) -> DataFrame:
    """(conv_id, history): the lines of a conversation in order."""
    line = F.concat(F.lit("["), F.col("as_of").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.col("text"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def hydrate(hits: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Hits with citation, text and dates; ids that are gone are dropped, order is by rank."""
    c = chunks.select("id", "version_id", "citation_path", "text")
    v = versions.select("version_id", "effective_from", "effective_to")
    out = hits.join(c, "id").join(v, "version_id")
    return out.select("qid", "rank", "id", "citation_path", nm.in_force_label(F.col("effective_from"), F.col("effective_to")).alias("in_force"), F.substring("text", 1, SNIPPET).alias("snippet")).orderBy("qid", "rank")


def grade(cases: DataFrame, candidates: DataFrame, cited: DataFrame) -> DataFrame:
    """(case, retrieved, temporal_ok, leaked) of cases(case, as_of, expected array, forbidden array), candidates(case,
    rank, citation_path) and cited(case, citation_path, effective_from, effective_to)."""
    seen = candidates.filter(F.col("rank") <= 5).groupBy("case").agg(F.collect_list("citation_path").alias("seen"))
    used = cited.groupBy("case").agg(F.collect_list(F.struct("citation_path", "effective_from", "effective_to")).alias("used"))
    t = cases.join(seen, "case", "left").join(used, "case", "left")
    some = F.coalesce("seen", F.array().cast("array<string>"))
    own = F.coalesce("used", F.array().cast("array<struct<citation_path:string,effective_from:date,effective_to:date>>"))
    return t.select("case", ((F.size("expected") == 0) | F.exists("expected", lambda e: F.exists(some, lambda p: tx.same_branch(p, e)))).alias("retrieved"),
                    F.forall(own, lambda c: contains(F.col("as_of"), c["effective_from"], c["effective_to"])).alias("temporal_ok"),
                    F.exists("forbidden", lambda b: F.exists(own, lambda c: tx.same_branch(c["citation_path"], b))).alias("leaked"))
