"""The registered queries: columns and types, and equality with their SQL."""

import pytest

from gatewise.llm import queries

DATA = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op2_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op3_license_scan": "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string labels:string score:double",
    "op4_top_k": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op5_chat_format": "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint valid:boolean",
    "op6_html_text": "page_id:bigint url:string text:string n_chars:bigint",
    "op7_packing": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op8_line_dedup": "doc_id:bigint n_lines:bigint n_dropped:bigint kept_sha256:string",
    "op9_decontamination": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op10_near_dedup": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op11_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
    "op12_vector_codes": "vec_id:bigint code:string error:bigint label_error:bigint codebooks_sha256:string",
    "op13_ranked_search": "item_id:bigint rank:int doc_id:bigint score:bigint",
    "license_base_places": "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string",
}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


def test_every_operator_is_registered():
    assert set(queries.queries()) == set(COLUMNS)
    assert set(queries.oracle_sql()) <= set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    assert [f"{c}:{t}" for c, t in df.dtypes] == COLUMNS[name].split()
    rows = [tuple(r) for r in df.collect()]
    assert rows
    sql = queries.oracle_sql().get(name)
    if sql:
        cursor = duck.execute(sql)
        assert as_rows(df.columns, rows) == as_rows([c[0] for c in cursor.description], cursor.fetchall())
