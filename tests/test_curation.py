"""Deduplication and the funnel against brute force on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup, funnel
from millrace.plans import curation

WORDS = "the study of data shows that a process model helps because research on any system needs an example of each method and result"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_exact_classes_and_first_copies(spark):
    df = docs(spark, [(3, "a"), (1, "b"), (2, "a"), (5, None), (4, None), (6, "")])
    got = {r.doc_id: (r.class_id, r.copies) for r in dedup.exact_classes(df).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (2, 2), 4: (4, 2), 5: (4, 2), 6: (6, 1)}
    assert sorted(r.doc_id for r in dedup.drop_copies(df).collect()) == [1, 2, 4, 6]


def test_bands_follow_the_threshold():
    assert dedup.bands_for(0.9) == (5, 25)


def test_near_duplicates_match_greedy_order(spark):
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(1, base), (2, base + " tail"), (3, "head " + base), (4, " ".join(f"v{k}" for k in range(80))), (5, ""), (6, None), (7, "two words")]
    df = docs(spark, rows)
    got = {r.doc_id: (r.kept, r.class_id) for r in dedup.near_duplicates(df).collect()}
    buckets = {}
    for r in dedup.buckets(dedup.signatures(df), "doc_id", *dedup.bands_for(dedup.THRESHOLD)).collect():
        buckets.setdefault(r.doc_id, set()).add(r.bucket)
    kept, want = [], {}
    for i in sorted(buckets):
        owner = next((k for k in kept if buckets[k] & buckets[i]), None)
        want[i] = (owner is None, owner or i)
        if owner is None:
            kept.append(i)
    # Rows without shingles are like no other.
    assert got == want | {5: (True, 5), 6: (True, 6)}
    assert got[2] == (False, 1) and got[4] == (True, 4)


def test_near_duplicates_are_those_of_all_pairs(spark):
    """Pairs just above and below 0.8, chains, and different rows that share much."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = [f"w{k}x{j}" for j in range(84)]
        rows += [(4 * k, " ".join(base)), (4 * k + 1, " ".join(base[:-8] + [f"o{k}x{j}" for j in range(8)])), (4 * k + 2, " ".join(base[:-9] + [f"p{k}x{j}" for j in range(9)])), (4 * k + 3, " ".join(base[8:] + [f"q{k}x{j}" for j in range(8)]))]
    common = [f"c{j}" for j in range(70)]
    rows += [(1000 + k, " ".join(common + [f"z{k}x{j}" for j in range(rng.randint(5, 30))])) for k in range(60)]
    rows += [(2000 + k, text.upper() + "!") for k, (_, text) in enumerate(rows[:20])]
    sets = {i: {tuple(t.lower().strip("!").split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    kept, want = [], {}
    for i in sorted(sets):
        owner = next((k for k in kept if len(sets[k] & sets[i]) / len(sets[k] | sets[i]) >= 0.8), None)
        want[i] = (owner is None, i if owner is None else owner)
        if owner is None:
            kept.append(i)
    got = {r.doc_id: (r.kept, r.class_id) for r in dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == want
    assert want[1] == (False, 0) and want[2] == (True, 2)


def test_the_full_funnel_drops_at_the_default_threshold(spark):
    rows = [(k, " ".join(f"{WORDS.split()[j % 22]}{k if j % 3 else ''}{chr(97 + j % 26)}" for j in range(84))) for k in range(8)]
    rows += [(100 + k, " ".join(t.split()[:-8] + [f"other{j}" for j in range(8)])) for k, t in rows]
    got = {r.doc_id: r.drop_stage for r in funnel.curate(docs(spark, rows), near=True).collect()}
    assert all((got[i] == "near_dedup_minhash") == (i >= 100) for i in got), got


def test_near_duplicates_of_an_empty_table(spark):
    assert dedup.near_duplicates(docs(spark, [])).count() == 0


def test_first_failed_test_counts(spark):
    rows = [(1, "short"), (2, WORDS), (3, WORDS), (4, "नमस्ते " * 30), (5, "aaa " * 30), (6, None)]
    got = {r.doc_id: r.drop_stage for r in funnel.curate(docs(spark, rows)).collect()}
    assert got == {1: "language_filter", 2: None, 3: "exact_dedup", 4: "language_filter", 5: "fineweb_ml_quality", 6: "language_filter"}
    row = funnel.summary(funnel.curate(docs(spark, rows))).first()
    assert (row.total_input_docs, row.retained_docs, row.yield_percentage, row.language_filter) == (6, 1, pytest.approx(16.67), 3)


def test_summary_of_an_empty_table(spark):
    row = funnel.summary(funnel.curate(docs(spark, []))).first()
    assert (row.total_input_docs, row.retained_docs, row.yield_percentage) == (1, 0, 0.0)


def test_registered_funnel_has_all_stages(spark, tmp_path):
    """A near copy goes before the tests, and markup is taken out before they count."""
    good = " ".join(f"{w} study{k}" for k, w in enumerate(WORDS.split() * 2))
    rows = [(1, good), (2, good + " tail"), (3, "<p>" + WORDS.replace("study", "theory") + "</p>"), (4, "short")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in curation.funnel_drops(spark, str(tmp_path)).collect()}
    assert {i: r.drop_stage for i, r in got.items()} == {1: None, 2: "near_dedup_minhash", 3: None, 4: "language_filter"}
    assert got[3].char_count == len(WORDS) + 1
    row = curation.funnel_summary(spark, str(tmp_path)).first()
    assert (row.total_input_docs, row.retained_docs, row.near_dedup_minhash) == (4, 2, 1)
    assert sum(r.documents for r in curation.domain_pools(spark, str(tmp_path)).collect()) == 2


def test_domain_of_the_whole_text(spark, tmp_path):
    docs(spark, [(1, "plain words " * 100 + "theorem"), (2, "plain words")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.domain for r in curation.domain_tag_whole(spark, str(tmp_path)).collect()}
    assert got == {1: "D2 Code and Mathematics", 2: "D3 General Web"}


def test_rows_without_shingles_are_kept(spark):
    got = {r.doc_id: (r.kept, r.class_id) for r in dedup.near_duplicates(docs(spark, [(1, None), (2, ""), (3, "..."), (4, "a b c d e f"), (5, "a b c d e f")])).collect()}
    assert got == {1: (True, 1), 2: (True, 2), 3: (True, 3), 4: (True, 4), 5: (False, 4)}


def test_hot_texts_are_classed_alike(spark, monkeypatch):
    rows = docs(spark, [(k, None if k % 2 else f"t{k % 8}") for k in range(40)])
    plain = sorted(map(tuple, dedup.exact_classes(rows).collect()))
    monkeypatch.setattr(dedup, "HOT", 6)
    assert sorted(map(tuple, dedup.exact_classes(rows).collect())) == plain and len(plain) == 40


def test_wrong_decoding_is_repaired(spark):
    from millrace.functions import normalize

    for text in ("naïve café – “so”", "नमस्ते", "plain", "à la carte, déjà vu", "¿Qué?", "100 €"):
        wrong = text.encode().decode("cp1252", "ignore") if text != "नमस्ते" else text.encode().decode("latin-1")
        assert normalize.repair(text) == text
        if all(b not in text.encode() for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)):
            assert normalize.repair(wrong) == text and normalize.repair(wrong.encode().decode("cp1252", "ignore")) in (text, wrong.encode().decode("cp1252", "ignore"))
    assert spark.createDataFrame([("cafÃ©",)], "t string").select(normalize.normalize(F.col("t")).alias("n")).first().n == "café"


def test_a_labeller_takes_the_place_of_the_rules(spark):
    from millrace.functions import scoring

    scoring.register_labeller("test", lambda t: F.when(F.contains(t, F.lit("poem")), F.struct(F.lit("D2 Literature (novels)").alias("label"), F.lit(0.9).alias("score"))))
    rows = spark.createDataFrame([("a poem",), ("def f",), (None,)], "t string")
    assert [r.d.domain for r in rows.select(scoring.domain_of(F.col("t"), "test").alias("d")).collect()] == ["D2 Literature", "D2 Code and Mathematics", "D3 General Web"]
    with pytest.raises(ValueError):
        scoring.domain_of(F.col("t"), "other")


def test_the_command_lists_and_runs(spark, tmp_path, capsys):
    from millrace import __main__ as command

    assert command.main([]) == 0 and "exact_dedup" in capsys.readouterr().out
    spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert command.main(["exact_dedup", "--folder", str(tmp_path), "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and '"event": "ended"' in capsys.readouterr().err
    with pytest.raises(SystemExit):
        command.main(["no_such_query"])
