"""The registered queries of the training-data operators."""

from millrace.llm import catalogue


def test_every_problem_has_a_query_and_every_check_a_query():
    names = catalogue.queries()
    assert {n.split("_")[0] for n in names} == {f"p{k}" for k in range(1, 10)}
    assert {"p1_found", "p2_found", "p3_found", "p6_found", "p7_ids", "p8_found", "p9_found"} <= set(names)
    assert set(catalogue.oracle_sql()) <= set(names)
