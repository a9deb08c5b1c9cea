import __spark_entry__ as entry_module


def test_one_query_per_operator_and_the_pipeline():
    names = list(entry_module.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert {"op1_chat_format", "op4_exact_dedup", "op11_minhash_near_dedup", "op12_phrases"} <= set(entry_module.oracle_sql())
