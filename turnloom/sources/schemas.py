"""Explicit schemas of the input tables."""

from __future__ import annotations

SAMPLE = """
    idx bigint, dialog string, response string, goal string, query string,
    predicted_goal array<string>, topic string, predicted_topic array<string>,
    predicted_topic_confidence array<double>, selected_topic string, user_profile string,
    target_knowledge string, gpt_selection string, candidate_knowledges_gpt array<string>,
    topic_cot string, passage_cot string
"""
KNOWLEDGE = "idx bigint, predicted_know array<array<string>>"
KNOWLEDGE_ARRAY = "array<struct<predicted_know: array<array<string>>>>"
GENERATION = "idx bigint, task string, beams array<string>, sequence_scores array<double>"
TEMPLATE = "prompt_input string, prompt_no_input string, response_split string"
KNOWLEDGE_RECORD = "struct<predicted_know: array<array<string>>>"
