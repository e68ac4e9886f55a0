"""Prompts per dataset, language and answer type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.answers import ANSWER_PREFIXES

# The wording of the prompts.
_MATH_STEPS = (
    'Solve this math problem. Give the reasoning steps before giving the final answer on the last line by itself in the format of "Answer:". '
    'Do not add anything other than the integer answer after "Answer:".\n\nQuestion:\n{question}\n'
)
TEMPLATES = {
    "gsm8k": _MATH_STEPS,
    "mgsm": _MATH_STEPS,
    "math": "Question: {question}\nPlease reason step by step, and put your final answer within \\boxed{{}}.\n",
    "mmlu": (
        "Answer the following multiple choice question. The last line of your response should be of the following format: "
        "'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Think step by step before answering.\n\nQuestion:\n{question}\n"
    ),
    "belebele": (
        "Answer the following multiple choice reading-comprehension question. The last line of your response should be of the following format: "
        "'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Please fully understand the passage and give explanations step by step "
        "before answering.\n\n{question}\n"
    ),
    "commonsenseqa": (
        "Answer the following multiple choice common-sense reasoning question. The last line of your response should be of the following format: "
        "'Answer: $LETTER' (without quotes) where LETTER is one of ABCDE. Think step by step and output the reasoning process before answering."
        "\n\n{question}"
    ),
    "hotpotqa": (
        "Answer the following multi-hop reasoning question. Think step by step and provide your reasoning process. The last line of your response "
        "should be of the following format: 'Answer: $ANSWER' (without quotes) where ANSWER is the final answer.\n\nQuestion:\n{question}"
    ),
    "theoremqa": (
        "Below is an instruction that describes a task, paired with an input that provides further context.\n"
        "Write a response that appropriately completes the request.\n\n"
        "### Instruction:\n"
        "Please read a math problem, and then think step by step to derive the answer. The answer is decided by Answer Type.\n"
        "If the Answer type in [bool], the answer needs to be True or False.\n"
        "Else if the Answer type in [integer, float], The answer needs to be in numerical form.\n"
        "Else if the Answer type in [list of integer, list of float], the answer needs to be a list of number like [2, 3, 4].\n"
        "Else if the Answer type in [option], the answer needs to be an option like (a), (b), (c), (d).\n"
        "You need to output the answer in your final sentence like 'Therefore, the answer is ...'.\n\n"
        "### Question: \n{question}\n\n"
        "### Answer_type: {answer_type}\n\n"
        "### Response:"
    ),
}


def template(dataset: Column, language: Column) -> Column:
    """The template of a dataset; for mgsm in a known language its answer prefix is localised."""
    name = F.lower(dataset)
    local = F.create_map(*(F.lit(x) for lang, word in ANSWER_PREFIXES.items() if lang != "en" for x in (lang, TEMPLATES["mgsm"].replace("Answer:", f"{word}:"))))
    plain = reduce(lambda acc, kv: acc.when(name == kv[0], F.lit(kv[1])), list(TEMPLATES.items())[1:], F.when(name == "gsm8k", F.lit(TEMPLATES["gsm8k"])))
    return F.coalesce(F.when(name == "mgsm", local[language]), plain, F.lit("{question}"))


def render(dataset: Column, question: Column, answer_type: Column, language: Column) -> Column:
    """The prompt. The answer type goes in after the question; without one its placeholder stays."""
    prompt = F.replace(template(dataset, language), F.lit("{question}"), question)
    given = F.coalesce(answer_type, F.lit("")) != ""
    return F.when(given, F.replace(prompt, F.lit("{answer_type}"), answer_type)).otherwise(prompt)
