"""Prompt texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions.text import list_text


def answer_prompt(context: Column, question: Column) -> Column:
    return F.concat(
        F.lit("Use only these remembered notes to answer.\n\nNotes:\n"),
        context,
        F.lit("\n\nQuestion: "),
        question,
        F.lit("\n\nGive the answer itself, short and without reasons:"),
    )


def analysis_prompt(content: Column) -> Column:
    return F.concat(
        F.lit(
            "Read the note and describe it as a JSON object with these fields:\n"
            "keywords: list of its key terms, the most telling first;\n"
            "context: one sentence on topic, main points and purpose;\n"
            "tags: list of broad labels for sorting it.\n\nNote:\n"
        ),
        content,
    )


def evolution_prompt(
    content: Column, context: Column, keywords: Column, neighbors: Column, count: Column
) -> Column:
    return F.concat(
        F.lit("A new note joins a collection of notes.\nContext: "),
        context,
        F.lit("\nContent: "),
        content,
        F.lit("\nKeywords: "),
        list_text(keywords),
        F.lit("\nIts nearest notes:\n"),
        neighbors,
        F.lit(
            "\nDecide whether the collection should change. The action 'strengthen' links "
            "the new note to others and sets its tags; the action 'update_neighbor' gives "
            "each nearest note new tags and a new context, in the order shown. "
            "Number of nearest notes: "
        ),
        count.cast("string"),
        F.lit(
            "\nReply with a JSON object holding should_evolve, actions, "
            "suggested_connections, tags_to_update, new_context_neighborhood and "
            "new_tags_neighborhood."
        ),
    )
