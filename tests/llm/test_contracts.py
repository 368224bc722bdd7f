"""Names and types of the query results."""

import pytest

import corpus_pipeline
from shoptrail.llm import queries

SF_DIR = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_mtree": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op3_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int,"
    " slot bigint, grown_shard int",
    "op5_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint,"
    " last_word bigint, base_labels string, labels string, score double",
    "op6_warc": "page_id bigint, payload_bytes bigint, payload_digest string,"
    " record_type string, refers_to bigint",
    "op7_near_vectors": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint,"
    " sequence_id bigint, offset bigint",
    "op10_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op11_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint,"
    " n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op12_phrases": "lang string, rank int, phrase string, a bigint, l bigint, r bigint,"
    " n bigint, score bigint",
    "op13_lexical": "item_id bigint, rank int, doc_id bigint, score bigint",
}


def test_all_operators_are_registered():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and queries.QUERIES.keys() == COLUMNS.keys()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    assert df.count() > 0
