"""Prompts of all model steps, as templates that columns fill; the wording is ours, the fields are those of the steps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = {
    "describe": "Describe this document by short labels, each as 'label; explanation'. Answer as JSON with the keys general and descriptors.\n\n{document}",
    "describe_specific": "Describe this document by labels of its kind and of its subject. Answer as JSON with the keys general, descriptors and specifics.\n\n{document}",
    "describe_with_vocabulary": "Labels in use: {vocabulary}\nDescribe this document, by labels in use where they fit.\n\n{document}",
    "rewrite": "Write a document that these labels describe.\nGeneral: {general}\nLabels: {descriptors}\n",
    "revise": "Original:\n{document}\n\nWritten from the labels:\n{rewrite}\n\nLabels: {descriptors}\nChange the labels so that the second text would come nearer to the first. Answer as JSON.",
    "reformat": "Give this answer as valid JSON and nothing else:\n{answer}",
    "group": "Group the meanings of: {descriptor}\n{roster}\nAnswer as JSON: a list of groups with the indices of their lines and one explanation.",
    "synonym": "Do these two labels mean the same?\nA: {a}\nB: {b}\nAnswer as JSON: {\"is_synonym\": true or false, \"keep_id\": \"A\" or \"B\"}",
    "keep": "These explanations share the label {descriptor}. Which is the clearest? Answer with its index.\n{roster}",
    "harmonize": "Label: {label}\nWhich of these labels means the same? Answer with its index, or none.\n{roster}",
    "judge_query_descriptor": "Query: {query}\nLabel: {descriptor}\nDoes the label fit the query? End with ANSWER: yes or no.",
    "judge_query_document": "Query: {query}\nDocument: {document}\nDoes the document fit the query? End with ANSWER: yes or no.",
    "judge_accuracy": "Document: {document}\nLabel: {descriptor}\nHow accurate is the label? End with ANSWER: and one of the five degrees.",
    "good_or_bad": "Is this a good label for documents? Answer yes or no.\n{label}",
}


def render(name: str, **fields: Column) -> Column:
    """A template with its fields filled; a null counts as empty. A field that is not given raises KeyError."""
    parts = re.split(r"\{([a-z_]+)\}", TEMPLATES[name])
    return F.concat(*[F.coalesce(fields[x].cast("string"), F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def roster(items: Column) -> Column:
    """Items on lines of their own behind their index, from 0."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x)), "\n")
