"""Prompt and chat templates."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats of each model family, by role.
TEMPLATES: dict[str, dict[str, str]] = {
    "llama": {
        "system": "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{content}<|eot_id|>",
        "user": "<|start_header_id|>user<|end_header_id|>\n\n{content}<|eot_id|>",
        "assistant": "<|start_header_id|>assistant<|end_header_id|>\n\n{content}<|eot_id|>",
    },
    "llama-2": {
        "system": "<s>[INST] <<SYS>>\n{content}\n<</SYS>>\n\n",
        "user": "{content} [/INST] ",
        "assistant": "{content} </s><s>[INST] ",
    },
    "qwen": {
        "system": "<|im_start|>system\n{content}<|im_end|>\n",
        "user": "<|im_start|>user\n{content}<|im_end|>\n",
        "assistant": "<|im_start|>assistant\n{content}<|im_end|>\n",
    },
    "qwen2": {
        "system": "<|im_start|>system\n{content}<|im_end|>\n",
        "user": "<|im_start|>user\n{content}<|im_end|>\n",
        "assistant": "<|im_start|>assistant\n{content}<|im_end|>\n",
    },
    "gemma": {
        "system": "<start_of_turn>model\n{content}<end_of_turn>\n",
        "user": "<start_of_turn>user\n{content}<end_of_turn>\n",
        "assistant": "<start_of_turn>model\n{content}<end_of_turn>\n",
    },
    "gemma-2": {
        "system": "<start_of_turn>model\n{content}<end_of_turn>\n",
        "user": "<start_of_turn>user\n{content}<end_of_turn>\n",
        "assistant": "<start_of_turn>model\n{content}<end_of_turn>\n",
    },
    "phi": {
        "system": "<|system|>\n{content}<|end|>\n",
        "user": "<|user|>\n{content}<|end|>\n",
        "assistant": "<|assistant|>\n{content}<|end|>\n",
    },
    "phi-3": {
        "system": "<|system|>\n{content}<|end|>\n",
        "user": "<|user|>\n{content}<|end|>\n",
        "assistant": "<|assistant|>\n{content}<|end|>\n",
    },
    "mistral": {
        "system": "<s>[INST] {content}\n\n",
        "user": "{content} [/INST] ",
        "assistant": "{content} </s><s>[INST] ",
    },
    "mixtral": {
        "system": "<s>[INST] {content}\n\n",
        "user": "{content} [/INST] ",
        "assistant": "{content} </s><s>[INST] ",
    },
    "chatml": {
        "system": "<|im_start|>system\n{content}<|im_end|>\n",
        "user": "<|im_start|>user\n{content}<|im_end|>\n",
        "assistant": "<|im_start|>assistant\n{content}<|im_end|>\n",
    },
    "default": {
        "system": "System: {content}\n\n",
        "user": "User: {content}\n",
        "assistant": "Assistant: {content}\n",
    },
}
#: Patterns of model names, in order of trial.
FAMILIES = [
    (r"llama-?3.*instruct", "llama"),
    (r"llama-?2.*chat", "llama-2"),
    (r"qwen-?2", "qwen2"),
    (r"qwen", "qwen"),
    (r"gemma-?2", "gemma-2"),
    (r"gemma", "gemma"),
    (r"phi-?3", "phi-3"),
    (r"phi", "phi"),
    (r"mistral", "mistral"),
    (r"mixtral", "mixtral"),
]
#: Where generation stops, by template.
STOPS: dict[str, list[str]] = {
    "llama": ["<|eot_id|>", "<|end_of_text|>"],
    "llama-2": ["</s>"],
    "qwen": ["<|im_end|>"],
    "qwen2": ["<|im_end|>"],
    "gemma": ["<end_of_turn>"],
    "gemma-2": ["<end_of_turn>"],
    "phi": ["<|end|>"],
    "phi-3": ["<|end|>"],
    "mistral": ["</s>"],
    "mixtral": ["</s>"],
    "chatml": ["<|im_end|>"],
    "default": [],
}


def detect(model: Column) -> Column:
    """The template of a model's name; the first pattern that it has decides."""
    low = F.lower(model)
    first, *rest = FAMILIES
    return reduce(lambda w, f: w.when(low.rlike(f[0]), F.lit(f[1])), rest, F.when(low.rlike(first[0]), F.lit(first[1]))).otherwise("default")


def _fill(form: str, content: Column) -> Column:
    before, _, after = form.partition("{content}")
    return F.concat(F.lit(before), content, F.lit(after))


def chat(messages: Column, template: str = "default", generation_prompt: bool = True, system_in_user: bool = False) -> Column:
    """array<struct(role, content)> as one prompt: system first, then turns, then the opening of an answer."""
    forms = TEMPLATES[template]
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n")
    turns = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))

    def turn(m: Column, i: Column) -> Column:
        content = m["content"]
        if system_in_user:
            content = F.when((i == 0) & (m["role"] == "user") & (system != ""), F.concat(system, F.lit("\n\n"), content)).otherwise(content)
        return F.when(m["role"] == "user", _fill(forms["user"], content)).otherwise(_fill(forms["assistant"], content))

    body = F.array_join(F.transform(turns, turn), "")
    opening = F.lit(forms["assistant"].partition("{content}")[0] if generation_prompt else "")
    head = F.lit("") if system_in_user else F.when(system != "", _fill(forms["system"], system)).otherwise("")
    return F.concat(head, body, opening)


def one_shot(model: Column, prompt: Column, system: Column | None = None, generation_prompt: bool = True) -> Column:
    """A prompt, after a system message if there is one, in the form of the model's family, which its name tells."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    user = F.array(turn("user", prompt))
    messages = user if system is None else F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.array(turn("system", system)), user)).otherwise(user)
    family = detect(model)
    names = list(dict.fromkeys([name for _, name in FAMILIES]))
    first, *rest = names
    chain = F.when(family == first, chat(messages, first, generation_prompt))
    return reduce(lambda w, n: w.when(family == n, chat(messages, n, generation_prompt)), rest, chain).otherwise(chat(messages, "default", generation_prompt))


#: Entries of a history that an assistant is told of.
HISTORY = 8


def history(messages: Column, last: int = HISTORY) -> Column:
    """The last entries of array<struct(role, content)>, and of those the users' and assistants' turns with a text, which is stripped: the cut comes before the filter."""
    tail = F.slice(messages, F.greatest(F.size(messages) - last + 1, F.lit(1)), F.lit(last))
    bare = F.transform(tail, lambda m: F.struct(m["role"].alias("role"), F.regexp_replace(F.coalesce(m["content"], F.lit("")), r"(?U)^\s+|\s+$", "").alias("content")))
    return F.filter(bare, lambda m: m["role"].isin("user", "assistant") & (m["content"] != ""))


def until_stop(text: Column, template: str) -> Column:
    """A text up to the first of the template's stops."""
    places = [F.nullif(F.position(F.lit(s), text), F.lit(0)) for s in STOPS.get(template, [])]
    if not places:
        return text
    at = places[0] if len(places) == 1 else F.least(*places)
    return F.when(at.isNull(), text).otherwise(F.left(text, at - 1))


def render(template: str, prompt: Column) -> Column:
    """A task's template; only {prompt} is replaced."""
    return F.replace(F.lit(template), F.lit("{prompt}"), prompt)


def choice_prompt(context: Column, endings: Column) -> Column:
    """A context with four lettered endings; a missing one is N/A."""
    lines = [F.concat(F.lit(f"{x}. "), F.coalesce(F.get(endings, F.lit(i)), F.lit("N/A"))) for i, x in enumerate("ABCD")]
    return F.concat_ws("\n", F.concat(F.lit("Context: "), context), F.lit(""), F.lit("Which ending makes the most sense?"), *lines)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _indented(s: pd.Series) -> pd.Series:
    """JSON texts over several lines, two spaces a level; what is no JSON stays."""

    def one(x: str) -> str:
        try:
            return json.dumps(json.loads(x), indent=2)
        except (TypeError, ValueError):
            return x

    return s.map(lambda xs: None if xs is None else [one(x) for x in xs])


#: The parts of a prompt for function calls.
CALL_HEAD = "You are a helpful assistant with access to functions. \n\nAvailable functions:\n"
CALL_QUERY = "\n\nUser query: "
CALL_FOOT = """\n\nRespond with a JSON array of function calls in the format:\n[{"name": "function_name", "arguments": {"arg1": "value1"}}]\n\nResponse:"""


def function_prompt(question: Column, functions: Column) -> Column:
    """A question with one block for each function: its name, description and parameters, which are written over several lines."""
    parameters = _indented(F.transform(functions, lambda f: F.coalesce(f["parameters"], F.lit("{}"))))
    each = F.zip_with(functions, parameters, lambda f, p: F.concat(F.lit("Function: "), f["name"], F.lit("\nDescription: "), F.coalesce(f["description"], F.lit("")), F.lit("\nParameters: "), p, F.lit("\n")))
    return F.concat(F.lit(CALL_HEAD), F.array_join(each, "\n"), F.lit(CALL_QUERY), question, F.lit(CALL_FOOT))


def register(name: str, forms: dict[str, str]) -> None:
    """A template of a user's own: a text with {content} for system, user and assistant."""
    missing = [r for r in ("system", "user", "assistant") if "{content}" not in forms.get(r, "")]
    if missing:
        raise ValueError(f"template {name} lacks {{content}} for {', '.join(missing)}")
    TEMPLATES[name] = dict(forms)


def listed() -> list[str]:
    return sorted(TEMPLATES)
