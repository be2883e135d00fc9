"""The registered queries on the smallest driver tables: contract columns, whole tables, oracle SQL where there is one."""

import os

import pytest

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")
pytest.importorskip("public_tokenizers")
pytest.importorskip("duckdb")

from check_oracle import compare, connect  # noqa: E402

from tallyward.llm.queries import QUERIES  # noqa: E402

CONTRACTS = {
    "op1": ("embeddings", "vec_id n_links component_id kept"),
    "op3": ("documents", "doc_id n_words n_base first_word last_word base_labels labels score"),
    "op4": ("pages", "page_id host path rule verdict"),
    "op5": ("documents", "doc_id held_out score predicted"),
    "op6": (None, "doc_id start length ids_crc32 doc_tokens sequence_id offset"),
    "op7": ("documents", "doc_id n_email n_ip n_card n_phone base_sha256 spans"),
    "op8": ("documents", "doc_id class_id kept"),
    "op9": (None, "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"),
    "op10": ("documents", "doc_id n_bytes n_tokens over_limit"),
    "op11": ("documents", "doc_id size source_size target taken"),
    "op12": ("documents", "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"),
    "op13": (None, "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"),
}


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted({n.split("_")[0] for n in QUERIES}) == sorted([*(f"op{k}" for k in range(1, 14)), "pipeline"])


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] in CONTRACTS])
def test_contract(spark, name):
    table, columns = CONTRACTS[name.split("_")[0]]
    query, sql = QUERIES[name]
    df = query(spark, SF_DIR)
    assert df.columns[:len(columns.split())] == columns.split()
    if sql:
        ok, note = compare(connect(SF_DIR), df, sql)
        assert ok, note
    elif table:
        ids = df.select(df.columns[0]).collect()
        assert sorted(r[0] for r in ids) == sorted(
            r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(df.columns[0]).collect())
    else:
        assert df.count() > 0
