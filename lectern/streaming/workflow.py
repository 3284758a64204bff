"""The two session state machines: a quiz's workflow and a topic's choice, folded from events.

A step is a function of Columns, so a batch fold is one aggregate over a session's ordered events. The streaming form,
an extension, keeps the same state by key with the same transitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event: the stage it needs (None: any), and the stage it leads to.
TRANSITIONS = {
    "begin": ("CREATE", "GENERATING"),
    "complete": ("GENERATING", "ATTEMPT"),
    "record": ("ATTEMPT", "ATTEMPT"),
    "submit": ("ATTEMPT", "REVIEW"),
    "reset": (None, "CREATE"),
}


def next_stage(stage: str, event: str) -> str | None:
    """The stage after an event; None if the event isn't allowed there or not known."""
    need, to = TRANSITIONS.get(event, ("", ""))
    return to if need is None or need == stage else None


def _next(stage: Column, event: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (need, to) in TRANSITIONS.items():
        allowed = event == name if need is None else (event == name) & (stage == need)
        out = F.when(allowed, to).otherwise(out)
    return out


def fold(events: DataFrame) -> DataFrame:
    """session_id, stage, answers, steps, rejected of (session_id, seq, event, payload). An event that isn't allowed changes nothing but the count of the rejected; answers are those last recorded or submitted."""
    listed = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event", "payload"))).alias("e"))
    start = F.struct(F.lit("CREATE").alias("stage"), F.lit(None).cast("string").alias("answers"), F.lit(0).alias("steps"), F.lit(0).alias("rejected"))

    def step(s: Column, e: Column) -> Column:
        to = _next(s["stage"], e["event"])
        answers = F.when(to.isNull(), s["answers"]).when(e["event"].isin("record", "submit"), e["payload"]).when(e["event"] == "reset", F.lit(None).cast("string")).otherwise(s["answers"])
        return F.struct(F.coalesce(to, s["stage"]).alias("stage"), answers.alias("answers"), (s["steps"] + to.isNotNull().cast("int")).alias("steps"), (s["rejected"] + to.isNull().cast("int")).alias("rejected"))

    return listed.select("session_id", F.aggregate("e", start, step).alias("s")).select("session_id", "s.*")


ANSWERS = "map<string,struct<text:string,flag:boolean>>"
#: What the events of a whole session carry.
PAYLOAD = f"struct<source_type:string,text:string,configuration:map<string,string>,seed:bigint,quiz_id:string,question_ids:array<string>,answers:{ANSWERS}>"


def fold_sessions(events: DataFrame) -> DataFrame:
    """The whole state of each session, of (session_id, seq, event, payload: PAYLOAD).

    begin keeps the source's identity, the configuration and the seed; complete the quiz and its questions' ids; record
    and submit the answers to these questions, others are dropped; reset clears all. An event that isn't allowed changes
    nothing but the count of the rejected.
    """
    from ..functions.text import source_identity

    listed = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event", F.to_json("payload").alias("p")))).alias("e"))
    kinds = {"stage": "string", "source_identity": "string", "configuration": "map<string,string>", "seed": "bigint", "quiz_id": "string", "question_ids": "array<string>", "answers": ANSWERS}
    clean = F.struct(F.lit("CREATE").alias("stage"), *(F.lit(None).cast(k).alias(n) for n, k in kinds.items() if n != "stage"), F.lit(0).alias("steps"), F.lit(0).alias("rejected"))

    def step(s: Column, e: Column) -> Column:
        p, kind, to = F.from_json(e["p"], PAYLOAD), e["event"], _next(s["stage"], e["event"])
        own = F.map_filter(F.coalesce(p["answers"], F.create_map().cast(ANSWERS)), lambda k, _: F.coalesce(F.array_contains(s["question_ids"], k), F.lit(False)))
        set_by = {
            "source_identity": ("begin", source_identity(p["source_type"], p["text"])), "configuration": ("begin", p["configuration"]), "seed": ("begin", p["seed"]),
            "quiz_id": ("complete", p["quiz_id"]), "question_ids": ("complete", p["question_ids"]),
        }
        fields = [F.coalesce(to, s["stage"]).alias("stage")]
        for name in kinds:
            if name != "stage":
                new = F.when(kind.isin("record", "submit"), own).otherwise(s[name]) if name == "answers" else F.when(kind == set_by[name][0], set_by[name][1]).otherwise(s[name])
                fields.append(F.when(to.isNull(), s[name]).when(kind == "reset", F.lit(None).cast(kinds[name])).otherwise(new).alias(name))
        return F.struct(*fields, (s["steps"] + to.isNotNull().cast("int")).alias("steps"), (s["rejected"] + to.isNull().cast("int")).alias("rejected"))

    return listed.select("session_id", F.aggregate("e", clean, step).alias("s")).select("session_id", "s.*")


def results(sessions: DataFrame, questions: DataFrame) -> DataFrame:
    """session_id and the score of each session that was submitted: its answers against its quiz's questions (with quiz_id)."""
    from ..operators import grading

    done = sessions.where("stage = 'REVIEW'")
    asked = done.select("session_id", "quiz_id").join(questions, "quiz_id").withColumn("quiz_id", F.col("session_id").cast("string"))
    answers = done.select(F.col("session_id").cast("string").alias("quiz_id"), F.explode("answers").alias("question_id", "a")).select("quiz_id", "question_id", F.col("a.text").alias("answer_text"), F.col("a.flag").alias("answer_bool"))
    return grading.quiz_scores(grading.graded(asked, answers)).withColumnRenamed("quiz_id", "session_id")


def fold_topics(events: DataFrame) -> DataFrame:
    """session_id, query, page_ids, selected, document and rejected of (session_id, seq, event, payload).

    Events: query (payload: its text), results (query text, a tab, page ids with commas), select (page id), document
    (source type, a tab, identity), reset. A new query clears all; results clear the choice; a choice clears the
    document; a choice outside the results, and a document without a choice or not from a topic, are rejected.
    """
    from ..functions.text import collapse

    listed = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event", "payload"))).alias("e"))
    no_ids, no_text = F.array().cast("array<string>"), F.lit(None).cast("string")
    clean = F.struct(F.lit("").alias("query"), no_ids.alias("page_ids"), no_text.alias("selected"), no_text.alias("document"), F.lit(0).alias("rejected"))

    def state(query, ids, selected, document, rejected) -> Column:
        return F.struct(query.alias("query"), ids.alias("page_ids"), selected.alias("selected"), document.alias("document"), rejected.alias("rejected"))

    def step(s: Column, e: Column) -> Column:
        kind, p = e["event"], F.coalesce(e["payload"], F.lit(""))
        first, rest = F.split_part(p, F.lit("\t"), F.lit(1)), F.split_part(p, F.lit("\t"), F.lit(2))
        wanted = collapse(first)
        bad = state(s["query"], s["page_ids"], s["selected"], s["document"], s["rejected"] + 1)
        return (
            F.when(kind == "query", F.when(collapse(p) == s["query"], s).otherwise(state(collapse(p), no_ids, no_text, no_text, s["rejected"])))
            .when(kind == "results", F.when(wanted == "", bad).otherwise(state(wanted, F.filter(F.split(rest, ","), lambda x: x != ""), no_text, no_text, s["rejected"])))
            .when(kind == "select", F.when(F.array_contains(s["page_ids"], p), state(s["query"], s["page_ids"], p, no_text, s["rejected"])).otherwise(bad))
            .when(kind == "document", F.when(s["selected"].isNotNull() & (first == "topic"), state(s["query"], s["page_ids"], s["selected"], rest, s["rejected"])).otherwise(bad))
            .when(kind == "reset", state(F.lit(""), no_ids, no_text, no_text, s["rejected"]))
            .otherwise(bad)
        )

    return listed.select("session_id", F.aggregate("e", clean, step).alias("s")).select("session_id", "s.*")


def stream(events: DataFrame) -> DataFrame:
    """The workflow's fold over a stream of (session_id, seq, event): session_id, stage, steps, rejected after each batch that has events of the session."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stage, steps, rejected = state.get if state.exists else ("CREATE", 0, 0)
        for frame in frames:
            for event in frame.sort_values("seq")["event"]:
                to = next_stage(stage, event)
                stage, steps, rejected = to or stage, steps + (to is not None), rejected + (to is None)
        state.update((stage, steps, rejected))
        yield pd.DataFrame([(key[0], stage, steps, rejected)], columns=["session_id", "stage", "steps", "rejected"])

    kind = events.schema["session_id"].dataType.simpleString()
    return events.groupBy("session_id").applyInPandasWithState(update, f"session_id {kind}, stage string, steps int, rejected int", "stage string, steps int, rejected int", "update", "NoTimeout")
