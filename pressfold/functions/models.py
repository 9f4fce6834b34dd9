"""Calls to language and embedding models: prompts as columns, a provider as an Arrow function, parsed answers.

A provider is any function from a pandas Series of prompts to a Series of answers (strings, or lists of floats for
embeddings). It runs inside tasks; a prompt it fails on should give null. Without a provider answers are null, and
the parsers give what they give for a missing answer.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pressfold.functions import text as tx

Provider = Callable[[pd.Series], pd.Series]


def ask(prompt: Column, provider: Provider | None, kind: str = "string") -> Column:
    """The provider's answers to prompts; null prompts are not asked."""
    if provider is None:
        return F.lit(None).cast(kind)

    def answers(prompts: pd.Series) -> pd.Series:
        there = prompts.notna()
        out = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
        if there.any():
            out[there] = pd.Series(list(provider(prompts[there])), index=prompts.index[there], dtype=object)
        return out

    return F.pandas_udf(answers, kind)(prompt)


def embedding(title: Column, content: Column, provider: Provider | None) -> Column:
    return ask(tx.embedding_text(title, content), provider, "array<float>")


def topics(title: Column, content: Column, provider: Provider | None) -> Column:
    """Topic labels of an article, by its title and the first 200 characters."""
    names = "\n".join(tx.TOPICS)
    prompt = F.concat(F.lit(f"Name every topic of this list that the article belongs to, one a line:\n{names}\n\nTitle: "), tx_or(title), F.lit("\nText: "), F.left(tx_or(content), F.lit(200)))
    return tx.topic_labels(ask(prompt, provider))


def outlet_bias(name: Column, provider: Provider | None) -> Column:
    prompt = F.concat(F.lit("Rate the political leaning of this news outlet from 1 (left) to 5 (right). Answer with the number, or unknown.\nOutlet: "), name)
    return tx.bias_score(ask(prompt, provider))


def article_bias(title: Column, content: Column, provider: Provider | None) -> Column:
    """Rating by the title and the first 600 characters."""
    prompt = F.concat(F.lit("Rate the political leaning of this article from 1 (left) to 5 (right). Answer with the number, or unknown.\nTitle: "), tx_or(title), F.lit("\nText: "), F.left(tx_or(content), F.lit(600)))
    return tx.bias_score(ask(prompt, provider))


def same_story(title: Column, content: Column, story_title: Column, story_content: Column, provider: Provider | None) -> Column:
    """Whether an article belongs to a story, by titles and snippets; no answer is a no."""
    side = lambda t, c: F.concat(tx_or(t), F.lit("\n"), tx.snippet(c))
    prompt = F.concat(F.lit("Do both report the same event? Answer 1 if so, else 0.\n\nArticle: "), side(title, content), F.lit("\n\nStory 1: "), side(story_title, story_content))
    return F.coalesce(tx.match_choice(ask(prompt, provider), 1) == 1, F.lit(False))


def story_headline(context: Column, provider: Provider | None) -> Column:
    prompt = F.concat(F.lit("Write one neutral headline of at most 15 words for the story that these titles report:\n"), context)
    return tx.headline(ask(prompt, provider))


def story_summary(kind: Column, context: Column, provider: Provider | None) -> Column:
    """Summary in four labelled sections, from the context of a story's articles."""
    layout = "Use exactly these sections:\nThe big picture:\nWhy it matters:\nWhat's happening:\nWhat's next:\n\nArticles:\n"
    return tx.blank_to_null(ask(F.concat(F.lit("You are a "), tx.persona(kind), F.lit(f". Summarise this story. {layout}"), context), provider))


def article_summary(title: Column, content: Column, provider: Provider | None) -> Column:
    prompt = F.concat(F.lit("Summarise this article in bullets that begin with •.\nTitle: "), tx_or(title), F.lit("\nText: "), F.left(tx.strip_html(content), F.lit(3000)))
    return tx.blank_to_null(ask(prompt, provider))


# The sections of a report by its kind.
REPORT_SECTIONS = {
    "politics": ("The story:", "How the left is covering it:", "Why it matters:"),
    "science": ("The discovery or development:", "What the research shows:", "What experts are saying:", "Why it matters:"),
    "gaming": ("What happened:", "What's the game or company:", "Why it matters:"),
    "sports": ("What happened:", "Key performances:", "The bigger picture:"),
    "business": ("What happened:", "Market impact:", "What experts are saying:"),
    "default": ("The story:", "Key details:", "Different perspectives:", "Why it matters:"),
}


def deep_report(kind: Column, context: Column, provider: Provider | None) -> Column:
    """A longer report whose sections depend on the story's kind."""
    cases = [F.when(kind == k, "\n".join(v)) for k, v in REPORT_SECTIONS.items()]
    sections = F.coalesce(*cases, F.lit("\n".join(REPORT_SECTIONS["default"])))
    return tx.blank_to_null(ask(F.concat(F.lit("You are a "), tx.persona(kind), F.lit(". Compare how the sources cover this story. Use these sections:\n"), sections, F.lit("\n\nArticles:\n"), context), provider))


def tx_or(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
