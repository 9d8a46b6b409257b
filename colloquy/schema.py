"""Explicit schemas; every reader fails fast against them."""

TURN_JSON = (
    "turn_id: STRING, ordinal: INT, text: STRING, timestamp: STRING, speaker_id: STRING, speaker_name: STRING, speaker_role: STRING, "
    "image_id: STRING, image_ids: ARRAY<STRING>, image_caption: STRING, image_captions: STRING, "
    "images: ARRAY<STRUCT<image_id: STRING, id: STRING, caption: STRING, path: STRING>>, "
    "audio_ref: STRING, audio_path: STRING, audio_file: STRING, reply_to_turn_id: STRING"
)

CASE_JSON = (
    "case_id STRING, session_dates MAP<STRING, STRING>, sessions ARRAY<STRUCT<session_id: STRING, date: STRING>>, "
    f"dialogues MAP<STRING, ARRAY<STRUCT<{TURN_JSON}>>>, qa STRING, qa_pairs STRING"
)

QA_JSON = (
    "ARRAY<STRUCT<qa_id: STRING, question: STRING, question_text: STRING, query: STRING, answer: STRING, "
    "evidence_ids: ARRAY<STRING>, evidence: ARRAY<STRING>, gold_evidence_ids: ARRAY<STRING>, "
    "gold_evidence: ARRAY<STRING>, fine_category: STRING, four_way_category: STRING>>"
)

ROUTE = "STRUCT<layer: STRING, retrievers: ARRAY<STRING>, query: STRING>"

PLAN = (
    "STRUCT<strategy: STRING, intent: STRING, rewritten_query: STRING, "
    f"routes: ARRAY<{ROUTE}>, sub_questions: ARRAY<STRING>, time_range: STRING, speaker_hint: STRING, "
    "sort_by: STRING, model_needs_visual_memory: BOOLEAN, model_needs_event_scope: BOOLEAN, "
    "model_needs_temporal_reasoning: BOOLEAN, known_asker: STRING, speaker_scope: STRING>"
)

RANKED = "query_id STRING, channel STRING, weight DOUBLE, variant INT, rank INT, node_id STRING, score DOUBLE"

RAW_NODE = (
    "case_id STRING, node_id STRING, layer STRING, pos BIGINT, text STRING, retrieval_text STRING, speaker STRING, "
    "speaker_ref STRING, session_id STRING, source_turn_idx INT, ordinal INT, date STRING, timestamp STRING, "
    "image_ids ARRAY<STRING>, images ARRAY<STRUCT<image_id: STRING, caption: STRING, path: STRING>>, audio_ref STRING, "
    "reply_to_turn_id STRING, refer_ids ARRAY<STRING>"
)
