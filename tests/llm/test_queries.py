"""Registered queries against their SQL on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry
from colloquy.llm.queries import ORACLES, QUERIES


def test_all_are_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, name):
    got = oracle.compare(spark, name, small)
    assert got["match"], got


def test_columns(spark, small):
    want = {
        "op1_language_id": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
        "op3_quality": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
        "op4_html": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
        "op5_context_tree": [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")],
        "op6_substring_dedup": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")],
        "op7_mixing": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
        "op8_cover_tree": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")],
        "op9_minhash": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
        "op10_decontaminate": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")],
        "op11_conversation_repair": [("conv_id", "bigint"), *[(c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", "string"), ("repaired_sha256", "string")],
        "op12_simhash": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")],
        "op13_resampling": [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")],
    }
    for name, columns in want.items():
        got = entry.queries()[name](spark, small)
        assert got.dtypes[: len(columns)] == columns, name
        assert got.count() > 0
