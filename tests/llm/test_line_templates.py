"""Line templates against their SQL."""

import random

import duckdb
import pytest
from oracle_check import compare, duck

from tillbook.llm import line_templates as lt
from tillbook.llm.oracle import OP8
from tillbook.llm.queries import QUERIES


def run_both(spark, d):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    return compare(spark, con, "op8", QUERIES["op8_line_templates"], OP8, d)


def test_given_tables(spark):
    res = compare(spark, duck("/root/testdata/sf0.01"), "op8", QUERIES["op8_line_templates"], OP8, "/root/testdata/sf0.01")
    assert res["values_match"], res


def test_templates(spark, make_docs, write_tables):
    rows = [(i, f"own text {i} first\nUser name{i % 3} logged in at {i}:00\nposted by anna in group {'abcdefgh'[i % 8]} today\n\n \nlast own line of {'x' * i}")
            for i in range(12)]
    rows += [(50, "user only words here"), (51, None), (None, "posted by anna in group q today"), (52, ""), (53, "\n"), (54, "copied line stays here\nyes")] * 6
    rows += [(60 + i, "<*> odd <*>\n" + "w " * 3000 + str(i)) for i in range(6)]
    d = write_tables(documents=make_docs(rows))
    res = run_both(spark, d)
    assert res["values_match"], res
    got = {r.doc_id: r for r in QUERIES["op8_line_templates"](spark, d).collect()}
    assert got[3].text == "\n \nlast own line of xxx" and got[3].n_dropped == 3  # two fields and a number vary
    assert "posted by anna" not in got[3].text and got[None].n_dropped == 1  # a variable field is generalised
    assert got[54].text == "copied line stays here\nyes"  # copies of one text count once
    assert got[51].text is None and got[51].n_lines == 0
    assert got[50].text == "user only words here" and got[53].text == "\n"


FIELDS = [a + b + c for a in "abcdefg" for b in "hijklmn" for c in "opqrstu"]


def logs(n, seed=3):
    """n texts with a line of one template, three fields of 343 values each, and a line of their own."""
    rng = random.Random(seed)
    pick = lambda: rng.choice(FIELDS)
    return [(i, f"own {pick()} {pick()} {pick()} {pick()} {pick()} {pick()} {i}\nthis was posted by {pick()} in group {pick()} under topic {pick()}")
            for i in range(n)]


@pytest.mark.parametrize("n", [30, 300, 3000])
def test_fields_stay_fields_as_the_corpus_grows(spark, make_docs, write_tables, n):
    out = lt.drop_recurring(make_docs(logs(n), clash=False))
    assert out.filter("n_dropped <> 1 OR text LIKE '%posted by%'").count() == 0 and out.count() == n


@pytest.mark.parametrize("n", [5, 500])
def test_lines_with_a_common_opening_stay(spark, make_docs, n):
    rng = random.Random(1)
    ends = ["Paris last summer", "bed rather early", "school by bus", "work without lunch", "sleep after noon"]
    rows = [(i, f"She went to {ends[i] if n == 5 else ' '.join(rng.sample(FIELDS, 3))}") for i in range(n)]
    assert lt.drop_recurring(make_docs(rows)).filter("n_dropped <> 0").count() == 0


def test_rare_line_of_a_hot_leaf(spark, make_docs, write_tables):
    """A line that recurs by itself goes, however small its share of the leaf; numbers alone don't make a template."""
    rng = random.Random(2)
    rows = [(i, "you can also " + " ".join(rng.sample(FIELDS, 5))) for i in range(400)]
    rows += [(1000 + i, f"body {i} {FIELDS[i]}\nyou can also follow us on our page\n{i} {i + 1} {i + 2}\n{i}") for i in range(6)]
    d = write_tables(documents=make_docs(rows))
    res = run_both(spark, d)
    assert res["values_match"], res
    got = {r.doc_id: r for r in QUERIES["op8_line_templates"](spark, d).collect()}
    assert all(got[i].n_dropped == 0 for i in range(400))
    assert got[1002].text == f"body 2 {FIELDS[2]}\n2 3 4\n2" and got[1002].n_dropped == 1


def test_one_text_does_not_make_a_template(spark, make_docs):
    rows = [(1, "\n".join(f"user {x} logged in from {x}" for x in FIELDS)), (2, "user abc went away again now"), *logs(4)]
    assert lt.drop_recurring(make_docs(rows)).filter("n_dropped <> 0").count() == 0


def test_white_space(spark, make_docs, write_tables):
    rows = [(i, f"  the\tsame  line\x0bin\fodd \r space {i} \nx{'ab'[i % 2]}y own {FIELDS[i]}\n\t\n") for i in range(8)]
    res = run_both(spark, write_tables(documents=make_docs(rows)))
    assert res["values_match"], res


def test_empty_and_clashes(spark, make_docs):
    docs = make_docs([(1, "a b c")])
    out = lt.drop_recurring(docs.withColumn("n_lines", docs.doc_id))
    assert set(docs.columns) <= set(out.columns) and out.first().n_lines == 1
    assert lt.drop_recurring(docs.limit(0)).collect() == []
