"""The corpus pipeline, stage by stage, against SQL and brute force over what the stage before kept."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest

from tillbook.llm.oracle import OP1, OP7

from .test_mixing import brute_targets
from .test_sharding import check as check_shards
from .test_simhash import brute_fingerprint, brute_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "size", "shard", "fp", "_row_h", "words", "_fp"]


def documents():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(24)
    rows = [(i, prose(rng.randint(60, 160)), f"s{i % 4}") for i in range(80)]
    long = prose(9000)
    rows += [(200, long, "s0"), (201, long, "s1"), (199, long, "s9")]  # exact copies, the smallest id stays
    near = rows[5][1].split()
    rows += [(300 + k, " ".join(near[:-1] + [f"end{k}"]), "s2") for k in range(3)]  # perhaps near
    rows += [(400, f"{prose(60)} {item} {prose(40)}", "s1"), (401, f"{item.upper()} {prose(50)}", None)]  # leaks
    rows += [(500, None, "s1"), (501, "", "s1"), (502, "few words", None), (503, "# " * 80 + prose(60), "s3"), (504, "a b c " * 60, "s3"), (505, prose(70).upper(), "s3")]
    rows += [(600, rows[7][1] + " more", "s1"), (600, prose(90), "s2"), (600, prose(90), "s2")]  # three texts under one id
    rows += [(700, prose(70), None)] * 4  # one row, repeated
    rows += [(None, prose(80), "s1"), (None, prose(80), None)]
    return rows, [(1, item), (2, None), (3, "too short")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, items = documents()
    d = tmp_path_factory.mktemp("pipeline")
    full = [(i, t, "en", s, len(t or ""), 7, "x", "x", "x", "x", "x") for i, t, s in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, fp string, "
                                       "_row_h string, words string, _fp string")
    docs.repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def sql(folder, query, benchmark=None):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    if benchmark:
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{benchmark}/*.parquet')")
    return con.sql(query)


def test_stages(spark, tables, tmp_path):
    made = {}
    at = f"{tables}/documents.parquet"
    for name, apply in corpus_pipeline.STAGES:
        apply(spark, spark.read.parquet(at), tables).write.parquet(f"{tmp_path}/{name}")
        made[name] = (spark.read.parquet(at).collect(), spark.read.parquet(f"{tmp_path}/{name}").collect(), at)
        at = f"{tmp_path}/{name}"
        if name != "sharding":
            assert spark.read.parquet(at).columns == COLUMNS

    before, after, folder = made["quality_rules"]
    kept = sql(folder, f"SELECT doc_id, n_words, word_chars FROM ({OP1}) WHERE kept").fetchall()
    size = lambda r: (r.doc_id, len((r.text or "").split()), sum(map(len, (r.text or "").split())))
    assert Counter(map(size, after)) == Counter(kept) and 0 < len(after) < len(before)

    before, after, _ = made["simhash_near_dedup"]
    group = brute_groups(list(range(len(before))), [brute_fingerprint(r.text) for r in before])  # row numbers in place of ids
    members = defaultdict(list)
    for g, r in zip(group, before):
        members[g].append(r)
    want = Counter(min((r.doc_id for r in own if r.doc_id is not None), default=None) for own in members.values())
    assert Counter(r.doc_id for r in after) == want and {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert 199 in want and 200 not in want and want[700] == 1 and want[None] == 2

    before, after, folder = made["benchmark_decontamination"]
    leaks = {r[0] for r in sql(folder, OP7, f"{tables}/benchmark.parquet").fetchall()}
    assert leaks == {400, 401} and Counter(map(tuple, after)) == Counter(tuple(r) for r in before if r.doc_id not in leaks)

    before, after, _ = made["source_mixing"]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += len(r.text.split())
    texts = {(r.doc_id, r.source, r.text) for r in before}
    for r in after:
        taken[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text) and any(i == r.doc_id and s == r.source and t.startswith(r.text) for i, s, t in texts)
    for s, target in brute_targets(sizes).items():
        assert 0 <= target - taken[s] < 1 + 1e-6, s

    before, after, _ = made["sharding"]
    check_shards(after, before, corpus_pipeline.SHARDS)
    run = corpus_pipeline.run(spark, tables)
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, after))


def test_empty_documents(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
