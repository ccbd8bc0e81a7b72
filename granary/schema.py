"""The record schemas."""

from __future__ import annotations

CORPUS = """id string, pair string, split string, source_file string, question string, answer string, full_text string,
  is_mcq boolean, is_paired boolean, is_document boolean, has_think_block boolean, parse_failed boolean, raw string,
  vote string, country string, organization string, working_group string, mcq_label string, guideline_source string, url string"""
CONVERSATION = "id string, conversation_id string, conversations array<struct<from: string, value: string>>, label_letter string, is_labeled boolean"
RUBRIC = "prompt_id string, prompt array<struct<role: string, content: string>>, rubrics array<struct<criterion: string, points: double, tags: array<string>>>, example_tags array<string>"
METADATA = "struct<specialty: string, level_of_care: string, severity: string, geography: string, question_type: string, age_group: string, difficulty: int, _parse_ok: boolean, _raw_preview: string>"
