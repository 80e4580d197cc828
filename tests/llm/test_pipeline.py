"""run() of the pipeline against its stages done plainly on a small table."""

import random

from corpus_pipeline import COLUMNS, STAGES, run
from docql.llm import decontaminate
from docql.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import brute_contamination, every_pair, plain_simhash, union


def test_registered():
    assert [n for n, _ in STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline(spark, tmp_path):
    r = random.Random(1)
    line = lambda n=9: " ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    leak = line(30)
    rows = [(i, "\n".join(line() for _ in range(5)), "en", "s", 0) for i in range(40)]
    rows += [(50, rows[3][1], "en", "s", 0), (51, rows[4][1] + "\n" + line(), "en", "s", 0), (52, line() + " " + leak, "en", "s", 0), (53, "12 34", None, "s", 0), (54, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, leak), (2, line(30))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in run(spark, str(tmp_path)).collect()}

    texts = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    cut = every_pair(texts)
    cut = {i: t for i, t in cut.items() if t.split()}
    prints = {i: plain_simhash(t) for i, t in cut.items()}
    ids = sorted(prints)
    roots = union(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    kept = {i for i in ids if roots[i] == i}
    bad = {i for i, x in brute_contamination([(i, cut[i]) for i in kept], bench, decontaminate.WINDOW).items() if x[2]}
    assert set(got) == kept - bad and 52 not in got and 53 not in got
    assert all(x.n_tokens for x in got.values()) and 50 not in got
    assert all(len(x.token_ids) == x.n_tokens for x in got.values())
    assert all(list(f(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).columns) == COLUMNS for _, f in STAGES[:-1])


def test_pipeline_of_empty_tables_null_ids_and_repeats(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    tables = {"none": [], "some": [(None, f"{words} one", "en", "s", 0), (None, None, None, None, None), (1, f"two {words[::-1]}", "en", "s", 0), (1, f"two {words[::-1]}", "en", "s", 0), (2, "", "en", "s", 0)]}
    for name, rows in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert run(spark, f"{tmp_path}/none").count() == 0
    assert sorted((x.doc_id or 0, x.n_tokens > 10) for x in run(spark, f"{tmp_path}/some").collect()) == [(0, True), (1, True)]
