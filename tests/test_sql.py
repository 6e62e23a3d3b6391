"""Queries beside their SQL on the smallest data."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lexigrid.plans import registry
from tools.compare import plain

ROOT = Path("/root/testdata/sf0.001")
NAMES = """p1_found p1_loaded p4_found p4_key_counts p4_join_sums p4_join_by_order lm_gsb_2 lm_kn_table lm_mkn_std_3 ppl_gsb ppl_gt ppl_mkn scan_bitext sink_encoded_bitext dict_lm dict_decode corpus_split
truecase_model join_lean_left join_block_right join_star except_keys phrase_extract phrase_best_align phrase_table phrase_gt phrase_mkn lex_prob_e2c dep_span_type ner_chunks ibm1_em_3 norm_ntable cls_best_move sym_union p1_rejects p1_reasons lm_kn_std_5 lm_mkn_table_5 ppl_kn ibm2_em_2 hmm_em_2 hmm_jumps_2 wam_best_links norm_d4table
rule_extract_1 rule_fractional phrase_syntax_columns phrase_table_syntax presort_phrases truecase_apply clean_rejects dep_yield dep_path dep_stanford_parse rule_decode split_holdout sample_rows join_bloom cogroup_lists dict_encode_docs pair_pack""".split()


@pytest.fixture(scope="module")
def con():
    if not ROOT.exists():
        pytest.skip("no test data here")
    c = duckdb.connect()
    for p in ROOT.iterdir():
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    df = registry.queries()[name](spark, str(ROOT))
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(registry.oracle_sql()[name])
    have = [x[0] for x in cur.description]
    assert sorted(have) == cols
    assert got == Counter(tuple(plain(r[have.index(c)]) for c in cols) for r in cur.fetchall())


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
