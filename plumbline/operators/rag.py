"""Retrieval-augmented answers: context, prompt, language-model providers, the ReAct loop."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.embed import post_json

LEAD, ASK, CLOSE = "Excerpts retrieved for your question:\n\n", "\n\nQuestion: ", "\n\nAnswer from these excerpts and what you know."
NOTHING_FOUND = "No relevant passages found."


def context_column(rank: str, text: str) -> Column:
    """Aggregate: lines ``[rank] text`` in order of rank, joined by a blank line."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).cast("long").alias("rank"), F.col(text).alias("text"))))
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), r["text"])), "\n\n")


def context(hits: DataFrame, rank: str = "rank", text: str = "text") -> DataFrame:
    """One row with the context of the hits, which are bounded by top_k."""
    return hits.agg(context_column(rank, text).alias("context"))


def prompt_column(context_: str | Column, question: str | Column) -> Column:
    c = F.col(context_) if isinstance(context_, str) else context_
    q = F.lit(question) if isinstance(question, str) else question
    return F.concat(F.lit(LEAD), c, F.lit(ASK), q, F.lit(CLOSE))


@dataclass
class SimulatedModel:
    """Canned answers for tests: one form for prompts that mention passages or a context, one for others.

    The frame of the prompt mentions neither, so the form depends on the retrieved text.
    """

    model: str = "simulated"

    def generate(self, prompt: str) -> str:
        found = re.search(r"Question:([^\n]*)", prompt)
        question = found[1].strip() if found else "your question"
        if "Context:" in prompt or "passages" in prompt:
            return f'From the passages given, about "{question}": they cover this topic. (Simulated answer of {self.model}.)'
        return f'You ask about "{question}". (Simulated answer of {self.model}.)'


@dataclass
class OpenAiModel:
    model: str = "gpt-4o-mini"
    api_key: str = ""
    base_url: str = "https://api.openai.com/v1"
    max_tokens: int = 1000

    def generate(self, prompt: str) -> str:
        payload = {"model": self.model, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": prompt}]}
        return post_json(f"{self.base_url.rstrip('/')}/chat/completions", payload, {"Authorization": f"Bearer {self.api_key}"})["choices"][0]["message"]["content"]


@dataclass
class OllamaModel:
    model: str = "llama3.2"
    host: str = "http://localhost:11434"

    def generate(self, prompt: str) -> str:
        return post_json(f"{self.host.rstrip('/')}/api/generate", {"model": self.model, "prompt": prompt, "stream": False})["response"]


@dataclass
class MessagesModel:
    """Servers with the messages interface (x-api-key header)."""

    model: str
    api_key: str = ""
    base_url: str = "https://api.anthropic.com/v1"
    max_tokens: int = 1000

    def generate(self, prompt: str) -> str:
        payload = {"model": self.model, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": prompt}]}
        reply = post_json(f"{self.base_url}/messages", payload, {"x-api-key": self.api_key, "anthropic-version": "2023-06-01"})
        return "".join(part.get("text", "") for part in reply["content"])


MODELS = {"simulated": SimulatedModel, "openai": OpenAiModel, "ollama": OllamaModel, "anthropic": MessagesModel}


def ask(question: str, find: Callable[[str], DataFrame], model) -> str:
    """Searches, builds the prompt from the hits (at most top_k rows) and asks the model."""
    hits = find(question)
    rows = hits.agg(context_column("rank", "text").alias("context"), F.count("*").alias("n")).select("n", prompt_column("context", question).alias("prompt")).first()
    return model.generate(rows["prompt"]) if rows["n"] else NOTHING_FOUND


def parse_action(reply: str) -> tuple[str, str] | None:
    """("search" | "finish", argument) of a reply: search(…) up to the first bracket, else finish(…) up to the last."""
    strip = lambda s: s.strip().strip('"').strip("'")
    if m := re.search(r"search\((.*?)\)", reply, re.S):
        return "search", strip(m[1])
    if m := re.search(r"finish\((.*)\)", reply, re.S):
        return "finish", strip(m[1])
    for line in reply.splitlines():
        if m := re.match(r"\s*Action:\s*(search|finish)[^(]*\((.*)", line):
            inner = m[2].partition(")")[0] if m[1] == "search" else m[2].rpartition(")")[0]
            if ")" in m[2]:
                return m[1], strip(inner)
    return None


SYSTEM = """You answer questions with two tools, one per step:
search(query) looks the query up in the knowledge base; finish(answer) ends with the answer.
Write a line "Thought: ..." and then a line "Action: tool(argument)". Results come back as "Observation: ...".
Search before you answer, search again with other words if needed, and keep the answer short."""


def react(question: str, find: Callable[[str], DataFrame], model, max_steps: int = 5, say: Callable[[str], None] | None = None) -> str:
    """The ReAct loop: each step is one small search; after max_steps one last answer is asked for.

    ``say`` is told the steps, the model's replies and the searches.
    """
    say = say or (lambda _: None)
    history = f"{SYSTEM}\n\nQuestion: {question}\n\n"
    for step in range(max_steps):
        say(f"Step {step + 1}")
        reply = model.generate(history)
        say(reply)
        history += reply + "\n"
        action = parse_action(reply)
        if action and action[0] == "finish":
            return action[1]
        if action:
            say(f"Searching: {action[1]}")
            history += f"Observation: {observation(find(action[1]))}\n\n"
        elif re.search(r"(?i)final answer|the answer is", reply):
            return reply
        else:
            history += "Use search(query) or finish(answer).\n"
    reply = model.generate(history + "No steps are left: give the final answer with finish(answer).\n")
    action = parse_action(reply)
    return action[1] if action and action[0] == "finish" else reply


def snippet(text: str, size: int = 300) -> str:
    """At most ``size`` bytes, cut at a whole character, then an ellipsis."""
    raw = text.encode()
    return text if len(raw) <= size else raw[:size].decode("utf-8", "ignore") + "..."


def observation(hits: DataFrame) -> str:
    rows = hits.select("rank", "text").orderBy("rank").collect()  # at most top_k rows
    return "".join(f"[{r['rank']}] {snippet(r['text'] or '')}\n" for r in rows) or "No relevant results found."
