"""Schemas of every table the engine reads or writes, as DDL; unknown keys of JSON records are ignored."""

from __future__ import annotations

from pyspark.sql import types as T

CLAIM = "struct<q: string, category: string, text: string, rating: int>"
LEDGER_CLAIM = "struct<claim: string, context: string, time_frame: string, time_anchor: string, epistemic: string, claimed_by: string, state_change: boolean>"

DDL = {
    "chapters": "book_id string, chapter_index int, chapter_text_normalized string, chapter_header string, main_character_labels array<string>, split string",
    "examples": "story_id string, chapter_index int, chunk_index int, next_chapter string, next_chapter_header string, chapter_prefix string, character_sheets map<string, string>, prior_plot_summary string, story_text string, next_chapter_synopsis string",
    "aliases": "principals map<string, array<string>>, ambiguous array<string>, drop_if_present array<string>, notes string",
    "snippets": "snippet_id string, book string, chapter_index int, idx int, split string, words int, text string",
    "items": "item_id string, book string, chapter_index int, chunk_index int, labels array<string>, answer map<string, int>, mentions map<string, int>, masked string, original string",
    "claims": f"item_id string, snippet_id string, book string, chapter_index int, idx int, label string, name string, present boolean, claims array<{CLAIM}>",
    "chapter_notes": "book string, chapter_index int, label string, name string, answers map<string, string>",
    "extracted": "book string, chapter_index int, label string, name string, q string, answer string",
    "rated": "book string, chapter_index int, label string, name string, rated map<string, array<struct<s: string, r: int>>>",
    "simplified": "book string, chapter_index int, label string, name string, q string, sentences array<struct<source: string, statement: string, rating: int>>",
    "ledgers": f"book_id string, chapter_index int, chapter_label string, principal_characters array<struct<character: string, presence: string, sections: map<string, array<{LEDGER_CLAIM}>>>>",
    "narrators": "book string, chapter_index int, first_person boolean, narrator string",
    "summaries": "book string, label string, boundary int, name string, summary string, words int, compressed_from int",
    "plots": "condition string, book string, boundary int, text string, words int",
    "reps": "condition string, book string, boundary int, label string, text string, words int",
    "item_reps": "condition string, item_id string, label string, text string",
    "eval_rows": "item_id string, book string, boundary int, order array<string>, target string, answer int, logprobs map<string, double>, top_token string, prompt_tokens int, invalid boolean, completion_tokens int, attempts int, reasoning_chars int, reasoning string",
    "errors": "item_id string, order array<string>, target string, error string",
    "ppl_rows": "item_id string, book string, nll double, tokens int",
    "ruler_rows": "example_id string, split string, book string, scores map<string, double>, target_tokens int, prompt_tokens map<string, int>, skipped string",
    "memo_rows": "book string, overlap13 double, longest_run int, flag boolean, prefix_tail string, generated string, reference string",
}


def schema(table: str) -> T.StructType:
    """The StructType of a table."""
    return T.StructType.fromDDL(DDL[table])
